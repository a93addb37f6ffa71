"""Jaccard similarity join on word n-grams, with Bayesian pruning of candidates.

1. Each text becomes its set of word n-grams (lower-cased, split at white space; a text with fewer words than n is one
   shingle). Texts with the same set are one class, found by a 128-bit digest of the set; all else works on classes.
2. Classes are candidates where a band of their MinHash values agrees. A bucket is cut into blocks of about BLOCK classes
   and BLOCK_GRAMS n-grams, and each pair of blocks is a cell, so a cell is bounded however long its texts are (a single
   longer text apart). A pair that shares several buckets is looked at in the first of them only.
3. In a cell, MinHash values are compared a few at a time. With m of n equal and a uniform prior, the probability that
   the similarity reaches the threshold is that of at most m successes in n + 1 draws; pairs below TOLERANCE are dropped.
4. What remains is verified on the texts' own n-grams. A cell reports, for each member, its links and the smallest
   member it is connected with, never pairs; connected components over cells give the class ids.

Links between copies are counted and not listed. With ROWS x BANDS = 4 x 20, a pair at exactly 0.8 shares no bucket with
probability 3e-5, and pruning loses one with probability under 1e-4; similarities above that are safer still.

Rows with a null doc_id take no part and come back with nulls. Null texts and texts without a word have no shingles:
they are alone in their class, with no links. Repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvlake.llm.common import is_small, stored

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS, STEP, TOLERANCE = 4, 20, 8, 1e-5
BLOCK, BLOCK_GRAMS = 512, 1_500_000  # of a block; a cell has at most two blocks
SET_GRAMS = 300_000  # n-grams that are held as tuples at a time, of two groups of texts each
KEYS = ROWS * BANDS
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(0, 1 << 63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, KEYS, dtype=np.uint64)
FEATURES = "struct<key:binary,sig:binary,bands:array<bigint>,grams:bigint>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, n: int, known: dict[str, int]) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word n-grams, ascending; empty for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 150_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.full(max(1, len(h) - n + 1), min(n, len(h)), np.uint64)
    for i in range(min(n, len(h))):
        out = _mix(out ^ h[i : i + len(out)])
    return np.unique(out)


def min_hashes(hashes: np.ndarray, rows: int = 4096) -> np.ndarray:
    """KEYS MinHash values of a non-empty set of hashes."""
    least = np.full(KEYS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), rows):
        np.minimum(least, (hashes[at : at + rows, None] * FACTORS + OFFSETS).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One key for each band, for one row of MinHash values or for many."""
    parts = sigs.reshape(*sigs.shape[:-1], BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:-1])
    for i in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) ^ parts[..., i])
    return out.view(np.int64)


def features(text: Column, n: int = SHINGLE) -> Column:
    """Digest of the set of n-grams, MinHash values and band keys of a text column; null without words."""
    known: dict[str, int] = {}

    @F.arrow_udf(FEATURES)
    def shingle_features(texts: pa.Array) -> pa.Array:
        out = []
        for t in (x.as_py() for x in texts):
            h = shingle_hashes(t or "", n, known)
            if not len(h):
                out.append(None)
                continue
            sig = min_hashes(h)
            out.append({"key": hashlib.blake2b(h.tobytes(), digest_size=16).digest(), "sig": sig.tobytes(), "bands": band_keys(sig).tolist(), "grams": len(h)})
        return pa.array(out, pa.struct([("key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64())), ("grams", pa.int64())]))

    return shingle_features(text)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest equal MinHash values with which a pair stays."""
    out = []
    for n in range(STEP, KEYS + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def prune(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows of sigs that no step of the comparison drops."""
    equal = np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        equal += (sigs[a, part] == sigs[b, part]).sum(1)
        stay = equal >= m
        a, b, equal = a[stay], b[stay], equal[stay]
    return a, b


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup batches that are sorted by cell so that no cell is cut."""
    rest: list[pd.DataFrame] = []
    for frame in batches:
        if not len(frame):
            continue
        last = frame["cell"].iloc[-1]
        whole = frame["cell"].ne(last)
        if whole.any() or rest and rest[-1]["cell"].iloc[-1] != last:
            yield pd.concat([*rest, frame[whole]], ignore_index=True)
            rest = []
        rest.append(frame[~whole])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _bounds(cell: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])


def _pairs(starts: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j inside each group, for many groups at once, in portions."""
    a, b, n = [], [], 0
    for s, e in zip(starts[:-1], starts[1:]):
        step = max(1, most // (e - s))
        for at in range(s, e - 1, step):
            i, j = np.meshgrid(np.arange(at, min(at + step, e - 1)), np.arange(at + 1, e), indexing="ij")
            up = j > i
            a.append(i[up])
            b.append(j[up])
            n += len(a[-1])
            if n >= most:
                yield np.concatenate(a), np.concatenate(b)
                a, b, n = [], [], 0
    if n:
        yield np.concatenate(a), np.concatenate(b)


def _survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of cells, with the members (by place in the cell) that pruning left each of them."""
    least = least_matches()
    for frame in _cells(batches):
        starts = _bounds(frame["cell"].to_numpy())
        sigs = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(-1, KEYS)
        band, block, size = frame["band"].to_numpy(), frame["block"].to_numpy(), np.diff(starts)
        first = np.repeat(starts[:-1], size)
        low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
        bands = band_keys(sigs)
        kept_a, kept_b = [], []
        for a, b in _pairs(starts):
            mine = (low[a] == high[a]) | (block[a] != block[b])  # pairs within a block belong to the block's own cell
            a, b = a[mine], b[mine]
            earliest = (bands[a] == bands[b]).argmax(1)
            mine = earliest == band[a]
            a, b = prune(sigs, a[mine], b[mine], least)
            kept_a.append(a)
            kept_b.append(b)
        if not kept_a or not sum(map(len, kept_a)):
            continue
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        members = np.union1d(a, b)
        cut = np.searchsorted(a, members), np.searchsorted(a, members, "right")
        partners = [(b[s:e] - first[m]).astype(np.int32) for m, s, e in zip(members, *cut)]
        yield pd.DataFrame({"cell": frame["cell"].to_numpy()[members], "key": frame["key"].to_numpy()[members], "doc_id": frame["doc_id"].to_numpy()[members], "spot": frame["spot"].to_numpy()[members], "size": frame["size"].to_numpy()[members], "place": (members - first[members]).astype(np.int32), "partners": partners})


def word_shingles(text: str, n: int) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words)} if len(words) < n else set(zip(*(words[i:] for i in range(n))))


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, vocabulary: int, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted arrays."""
    if len(a) < 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    gram = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, vocabulary, width):
        x = np.zeros((len(sets), width), np.float32)
        for i, s in enumerate(sets):
            x[i, s[np.searchsorted(s, at) : np.searchsorted(s, at + width)] - at] = 1
        gram += x @ x.T
    return gram[a, b].astype(np.int64)


def linked_pairs(texts: list[str], a: np.ndarray, b: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """For each pair of texts: whether the exact Jaccard similarity of their n-grams reaches the threshold.

    Texts are cut into groups of about SET_GRAMS n-grams, and the n-grams of two groups are held at a time.
    """
    group = np.cumsum([len(t) // 6 for t in texts]) // SET_GRAMS  # about 6 characters a word
    out = np.zeros(len(a), bool)
    both = group[a] * (group[-1] + 1) + group[b]
    for code in np.unique(both):
        mine = np.flatnonzero(both == code)
        used, place = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
        i, j = place[: len(mine)], place[len(mine) :]
        vocabulary: dict[tuple[str, ...], int] = {}
        sets = [np.sort(np.array([vocabulary.setdefault(s, len(vocabulary)) for s in word_shingles(texts[k], n)], np.int64)) for k in used]
        length = np.array([len(s) for s in sets])
        common = _common(sets, i, j, len(vocabulary))
        # compared in whole numbers, so that a similarity of exactly the threshold counts
        out[mine] = common * 1000 >= round(threshold * 1000) * (length[i] + length[j] - common)
    return out


def _verifier(n: int, threshold: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _cells(batches):
            starts = _bounds(frame["cell"].to_numpy())
            for s, e in zip(starts[:-1], starts[1:]):
                part = frame.iloc[s:e]
                at = {p: i for i, p in enumerate(part["place"])}
                pairs = [(i, at[p]) for i, ps in enumerate(part["partners"]) for p in ps]
                if not pairs:
                    continue
                a, b = np.array(pairs).T
                true = linked_pairs(part["text"].tolist(), a, b, n, threshold)
                a, b, size = a[true], b[true], part["size"].to_numpy()
                if not len(a):
                    continue
                links = np.bincount(a, size[b], len(part)) + np.bincount(b, size[a], len(part))
                root = np.arange(len(part))
                while True:  # the smallest place that a member is connected with
                    low = np.minimum(root[a], root[b])
                    new = root.copy()
                    np.minimum.at(new, a, low)
                    np.minimum.at(new, b, low)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                on = np.flatnonzero(links)
                keys = part["key"].to_numpy()
                yield pd.DataFrame({"key": keys[on], "links": links[on].astype(np.int64), "root": keys[root[on]]})

    return verify


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge list is connected with.

    Large-star and small-star steps: every node sends its neighbours on to the smallest it knows of, which needs only
    grouped minima and joins. Rounds go on until nothing changes (their number grows with the logarithm of the edges).
    Each round is written to the shared folder; only counts come to the driver.
    """
    star = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    star = stored(star, "star")
    mark = None
    while True:
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        star = stored(small.where("u <> v").distinct(), "star")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == now or not now[0]:
            break
        mark = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def jaccard_classes(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of each row.

    class_id is the smallest doc_id of all rows connected with this one by similarities of at least the threshold, and
    n_links the number of other rows that reach it.
    """
    known = row_classes(docs, n, threshold, text).select("doc_id", "class_id", "n_links")
    nulls = docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("bigint").alias("n_links"))
    return known.unionByName(nulls)


def row_classes(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, spot, root, class_id, n_links) of each row with an id, as for jaccard_classes().

    spot is the xxhash64 of the text, which tells rows of one id apart. root names the group of connected rows; two groups
    can have the same class_id where that id is repeated. It is null for a text without words.
    """
    rows = docs.select("doc_id", F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    made = stored(rows.select("doc_id", F.xxhash64("text").alias("spot"), features(F.col("text"), n).alias("f")).select("doc_id", "spot", "f.*"), "shingled")
    # of each class the smallest id, and of its texts, if the id is repeated, one
    classes = made.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("doc_id", "spot")).alias("first"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("grams").alias("grams"))
    classes = stored(classes.select("key", "first.doc_id", "first.spot", "size", "sig", "bands", "grams"), "classes")

    # a bucket's key tells its band, too. Only names go through the two shuffles by bucket; MinHash values follow for the
    # few classes that share one. Sort-merge joins at every size: what is small here is not small there.
    posted = classes.select("key", "grams", F.explode("bands").alias("bucket"))
    full = stored(posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("all_grams")).where("n > 1"), "buckets")
    members = posted.drop("grams").join(full.hint("merge"), "bucket").join(classes.hint("merge"), "key")
    members = members.withColumn("band", F.array_position("bands", F.col("bucket")).cast("int") - 1)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("all_grams") / BLOCK_GRAMS))).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    members = members.withColumn("cell", F.xxhash64("bucket", "low", "high")).drop("n", "all_grams", "grams", "other", "bucket", "bands")
    members = members.repartition("cell").sortWithinPartitions("cell", "key")
    left = stored(members.mapInPandas(_survivors, "cell bigint, key binary, doc_id bigint, spot bigint, size bigint, place int, partners array<int>"), "survivors")

    # only texts of what pruning left, a row of each id and text; copies go before the shuffle
    names = left.select("doc_id", "spot").distinct()
    names = F.broadcast(names) if is_small(names) else names
    once = Window.partitionBy("doc_id", "spot").orderBy(F.length("text"))
    texts = rows.withColumn("spot", F.xxhash64("text")).join(names, ["doc_id", "spot"], "left_semi").withColumn("turn", F.row_number().over(once)).where("turn = 1").drop("turn")
    with_text = left.hint("merge").join(texts, ["doc_id", "spot"]).repartition("cell").sortWithinPartitions("cell", "place")
    links = stored(with_text.mapInPandas(_verifier(n, threshold), "key binary, links bigint, root binary"), "links")

    roots = components(links, "key", "root")
    linked = links.groupBy("key").agg(F.sum("links").alias("links")).join(roots, F.col("key") == F.col("node"), "left").select("key", "links", F.coalesce("root", "key").alias("root"))
    smallest = linked.join(classes.select("key", "doc_id"), "key").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    linked = stored(linked.join(smallest, "root").select("key", "links", "root", "class_id"), "linked")
    info = classes.join(linked, "key", "left").select("key", F.coalesce("root", "key").alias("root"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    info = stored(info, "class-info")

    known = made.select("doc_id", "spot", "key").join(info, "key", "left")
    return known.select("doc_id", "spot", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
