"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvlake.llm import ann, bpe, conversation_trie, decontam, langid, license_scan, ngram_join, secrets, simhash, token_rollup, toxicity, turn_repair, url_filter
from cvlake.llm.common import held_out, may_learn, shared_path, table

#: URL rules (host, then path).
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = url_filter.fit(url_filter.SEED_BLOCK.split(), url_filter.SEED_ALLOW.split(), url_filter.page_words(pages), url_filter.url_sample(pages))
    return url_filter.judge_urls(pages, model, URL_RULES)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from labels of the folds that may be learned from."""
    return toxicity.fit_on(docs, table(spark, sf_dir, "labels").where(may_learn(F.col("doc_id"))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.toxic_score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.read_spec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.digests(spec, F.col("text")).alias("d")).select("doc_id", "d.*")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, toxic ones go, those not in English are counted anew by the second version; a batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    rollup = token_rollup.TokenRollup(spark, shared_path(spark, "token-rollup"))
    rollup.insert("1", docs, "words-1")
    rollup.delete("2", toxic)
    rollup.delete("2", toxic)
    rollup.revise("3", docs.where("lang <> 'en'"), "pieces-2", without=toxic)
    return rollup.totals()


OP4_SQL = r"""
WITH kept AS (
  SELECT *, CASE WHEN lang <> 'en' THEN 'pieces-2' ELSE 'words-1' END AS version
  FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS docs,
  CAST(sum(CASE WHEN version = 'words-1' THEN len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))
      ELSE len(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ɏ]+|[0-9]+|[^A-Za-zÀ-ɏ0-9 \t\n\r]')) END) AS BIGINT) AS tokens,
  CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars
FROM kept GROUP BY ALL
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules are run over all documents, then the whole list of rules, of which the ledger lacks those added."""
    docs, ledger = table(spark, sf_dir, "documents"), secrets.new_ledger(spark)
    secrets.scan_blobs(docs, ledger, "base", "doc_id", rules=tuple(r for r in secrets.RULES if r.kind in secrets.BASE))
    found = secrets.scan_versions(docs, ledger, "all", "doc_id")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = secrets.spans_text(F.col("spans"), secrets.BASE)
    return found.select(F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_on(docs.where(may_learn(F.col("doc_id"))))
    named = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.language(F.col("text"), model, spark).alias("l"))
    return named.select("doc_id", "held_out", "l.lang_pred", "l.score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs, path="doc_id").withColumnRenamed("path", "doc_id")


def op10_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spell = ", ".join(f"{quote(a)}: {quote(b)}" for a, b in license_scan.SPELLINGS.items())
    known = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in license_scan.known_digests().items())
    canon = lambda x: f"list_aggregate(list_transform({x}, lambda w: coalesce(m[w], w)), 'string_agg', ' ')"
    words = lambda x: f"list_filter(string_split_regex(regexp_replace(lower({x}), {quote(license_scan.COPYRIGHT_LINE)}, ' ', 'g'), {quote(license_scan.NOT_WORD)}), lambda w: w <> '')"
    return f"""
WITH known(digest, license) AS (VALUES {known}),
spelling AS (SELECT MAP {{{spell}}} AS m),
units AS (
  SELECT doc_id, 'text' AS unit, {words("coalesce(text, '')")} AS words FROM documents
  UNION ALL
  SELECT doc_id, 'line', {words("line")} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(lower(line), 'licen|permission|warrant')),
found AS (SELECT doc_id, unit, license FROM units, spelling JOIN known ON known.digest = sha256({canon("words")}))
SELECT d.doc_id, (SELECT max(license) FROM found f WHERE f.doc_id = d.doc_id AND unit = 'text') AS license,
  coalesce((SELECT string_agg(DISTINCT license, ',' ORDER BY license) FROM found f WHERE f.doc_id = d.doc_id AND unit = 'line'), '') AS notices
FROM documents d
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: The trie by the hash of each beginning; crc32 is made bit by bit, and sums over subtrees by a join with all beginnings of each.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
head AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h),
lent AS (SELECT conv_id, count(*) AS k FROM head GROUP BY conv_id),
r AS (
  SELECT * FROM head UNION ALL
  SELECT t.conv_id, t.pos - c.h + coalesce(k, 0), role, text FROM t JOIN c ON c.conv_id = t.conv_id LEFT JOIN lent ON lent.conv_id = t.conv_id WHERE t.pos > c.h),
m AS (
  SELECT conv_id, 0 AS depth, 'root' AS node, 0 AS words FROM c UNION ALL
  SELECT conv_id, pos, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM r),
nd AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY node, depth),
up AS (SELECT DISTINCT a.node, b.node AS parent FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
kids AS (SELECT parent AS node, count(*) AS n FROM up GROUP BY parent),
below AS (SELECT DISTINCT a.node AS low, b.node AS top FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth <= a.depth),
sums AS (
  SELECT top AS node, sum((n_convs - 1) * words) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM below JOIN nd ON nd.node = low LEFT JOIN kids ON kids.node = low GROUP BY top),
ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node)
SELECT nd.conv_id, CAST(nd.depth AS BIGINT) AS depth, pn.conv_id AS parent_conv_id, nd.n_convs, coalesce(kids.n, 0) AS n_children,
  sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
FROM nd JOIN sums ON sums.node = nd.node LEFT JOIN up ON up.node = nd.node LEFT JOIN nd pn ON pn.node = up.parent LEFT JOIN kids ON kids.node = nd.node LEFT JOIN ends ON ends.node = nd.node
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_conversations(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_url_filter, op2_toxicity, op3_bpe, op4_token_counts, op5_secrets, op6_ann, op7_decontamination, op8_ngram_join, op9_language, op10_licenses, op11_conversation_trie, op12_simhash, op13_turn_repair, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_token_counts": OP4_SQL, "op10_licenses": op10_sql(), "op11_conversation_trie": OP11_SQL}
