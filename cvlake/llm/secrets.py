"""Secret scanning over an incremental ledger of blobs.

Every version of every file is a row (path, text). Its blob is named by the SHA-256 of the text. The ledger holds which
pairs of a blob and a rule's version were scanned, and what was found. A batch scans only pairs that the ledger lacks, on
one row of each blob; a changed or added rule is run alone. Findings are joined back to every path that ever held the blob.

Only names of blobs are shuffled, counted before they are: what most blobs of a batch lack is a constant, and the blobs
that differ from it (or have several rows) are a list that is broadcast if it is surely small. Beyond that, distinct texts
are shuffled once, after copies are dropped on the map side. A blob with a third of all rows is thus one row anywhere but
in the last join, which has one row for each blob on its other side, so Spark may split it.

Null texts count as empty and have no spans; repeated rows give repeated results; an empty table gives an empty result and
commits an empty batch. A batch that is committed already is not scanned again.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvlake.llm.common import Batches, fresh, is_small, shared_path

SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"
LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: re.Pattern
    least: int  # characters
    group: int  # of this group; shorter matches are dropped after matching
    hints: tuple[str, ...]  # one of these must be in the lower-cased text; none: no such test


#: The three base kinds in the order in which they are listed, then kinds that this scanner adds.
RULES = (
    Rule("assign", 1, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12, 2, ("passw", "secret", "token", "api")),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 18, 0, ("akia",)),
    Rule("hex", 1, re.compile(r"[0-9a-f]{16,}"), 16, 0, ()),  # runs of hex digits are whole either way, so shorter ones need no match
    Rule("pem", 1, re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"), 1, 0, ("private key-----",)),
    Rule("github", 1, re.compile(r"\bgh[oprsu]_[A-Za-z0-9]{36,}"), 40, 0, ("ghp_", "gho_", "ghr_", "ghs_", "ghu_")),
)
BASE = ("assign", "access", "hex")


def find_spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in rules, end, kind) in code points, by start and then kind."""
    out, low = [], text.lower()
    for n, r in enumerate(rules):
        if not r.hints or any(h in low for h in r.hints):
            out += [(m.start(), n, m.end(), r.kind) for m in r.pattern.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
    return sorted(out)


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES, asked: Column | None = None) -> Column:
    """Spans of a text column, by those rules whose bits asked has (all without it); null where text is null.

    Equal texts of a batch are scanned once.
    """

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array, bits: pa.Array) -> pa.Array:
        known: dict[tuple, list] = {}
        out = []
        for t, bit in zip(texts.to_pylist(), bits.to_pylist()):
            if t is not None and (t, bit) not in known:
                own = tuple(r for n, r in enumerate(rules) if bit >> n & 1)
                known[t, bit] = [dict(zip(("start", "ord", "end", "kind"), s)) for s in find_spans(t, own)]
            out.append(None if t is None else known[t, bit])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("ord", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))

    return scan(text, asked if asked is not None else F.lit((1 << len(rules)) - 1))


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rule_name(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _wanted(names: DataFrame, seen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, lead, n, bits) of a batch's blobs: the smallest path, the number of rows, and the rules that the ledger lacks."""
    bit = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (rule_name(r), 1 << n)])
    done = seen.select("blob", F.aggregate("rules", F.lit(0), lambda bits, r: bits.bitwiseOR(F.coalesce(bit[r], F.lit(0)))).alias("done"))
    done = done.groupBy("blob").agg(F.bit_or("done").alias("done"))
    blobs = names.groupBy("blob").agg(F.min("path").alias("lead"), F.count(F.lit(1)).alias("n"))
    every = F.lit((1 << len(rules)) - 1)
    return blobs.join(done, "blob", "left").select("blob", "lead", "n", (every - F.coalesce("done", F.lit(0))).cast("int").alias("bits"))


def _to_scan(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(blob, text, bits) of at least one row of each blob that lacks a rule: one, unless rows repeat blob and path."""
    sizes = wanted.where("n = 1").groupBy("bits").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bits").limit(1).collect()
    usual = sizes[0].bits if sizes else 0
    other = wanted.where((F.col("n") > 1) | (F.col("bits") != usual)).select("blob", "lead", F.col("bits").alias("own_bits"), F.lit(True).alias("listed"))
    if is_small(other):
        rows = named.join(F.broadcast(other), "blob", "left")
        bits = F.when(F.col("listed").isNull(), F.lit(usual)).when(F.col("lead").eqNullSafe(F.col("path")), F.col("own_bits")).otherwise(0)
        return rows.withColumn("bits", bits).where("bits > 0").select("blob", "text", "bits")
    once = named.groupBy("blob").agg(F.first("text").alias("text"))
    return once.join(wanted.where("bits > 0").select("blob", "bits"), "blob")


def scan_blobs(texts: DataFrame, ledger: str, batch: str, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the pairs of blob and rule that the ledger (a folder in shared storage) lacks, commit them as a batch, and return
    (blob, spans) of all blobs with findings of these rules."""
    log = Batches(texts.sparkSession, ledger)
    if batch not in log.committed():
        named = texts.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", blob_name(F.col("text")))
        rows = _to_scan(named, _wanted(named.select("blob", "path"), log.read("scans", LEDGER), rules))
        scanned = rows.select("blob", "bits", spans_of(F.col("text"), rules, F.col("bits")).alias("spans"))
        name = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, rule_name(r))])
        own = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << n) != 0, rule_name(r)) for n, r in enumerate(rules)]), lambda r: r.isNotNull())
        spans = F.transform("spans", lambda s: F.struct(name[s["kind"]].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
        attempt = uuid.uuid4().hex
        log.write("scans", attempt, scanned.select("blob", own.alias("rules"), spans.alias("spans")))
        log.commit(batch, attempt)
    order = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (rule_name(r), n)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (rule_name(r), r.kind)])
    live = F.filter("spans", lambda s: order[s["rule"]].isNotNull())
    found = log.read("scans", LEDGER).select("blob", live.alias("spans")).where(F.size("spans") > 0)
    # a row of a blob for each batch that scanned it, of some rules each
    found = found.groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["rule"]].alias("ord"), s["end"].alias("end"), kind[s["rule"]].alias("kind")))
    return found.select("blob", F.array_sort(F.array_distinct(spans)).alias("spans"))


def scan_versions(versions: DataFrame, ledger: str, batch: str, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """scan_blobs, and its findings joined back to all paths: (path, blob, spans) of every row."""
    found = scan_blobs(versions, ledger, batch, path, text, rules)
    if is_small(found.select(F.explode("spans"))):
        found = F.broadcast(found)
    paths = versions.select(F.col(path).alias("path"), blob_name(F.col(text)).alias("blob"))
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redacted(files: DataFrame, ledger: str, batch: str, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """files with every secret in text replaced by its kind in brackets; other columns, and null texts, as they were.

    The findings of scan_blobs() are joined back by blob at every size, so each pair of blob and rule is scanned once. They are
    broadcast if they are surely small; else texts go through a shuffle by blob, whose partitions adaptive execution splits
    where a blob is that of very many rows (a blob has one row of findings).
    """
    found = scan_blobs(files, ledger, batch, path, text, rules)
    blob, spans = fresh(files, "_blob"), fresh(files, "_spans")
    found = F.broadcast(found.toDF(blob, spans)) if is_small(found.select(F.explode("spans"))) else found.toDF(blob, spans)
    cut = files.withColumn(blob, blob_name(F.col(text))).join(found, blob, "left")
    return cut.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(redact(F.col(text), F.col(spans)))).select(*[f"`{c}`" for c in files.columns])


def new_ledger(spark) -> str:
    return shared_path(spark, "secret-ledger")


def spans_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with every span replaced by [kind]; of overlapping spans the earliest names the whole stretch."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), rows.to_pylist()):
            if t is None or not found:
                out.append(t)
                continue
            parts, at = [], 0
            for s in found:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['kind']}]"]
                at = max(at, s["end"])
            out.append("".join(parts) + t[at:])
        return pa.array(out, pa.string())

    return cut(text, spans)
