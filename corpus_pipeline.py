"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from cvlake.llm import bpe, decontam, ngram_join, secrets
from cvlake.llm import queries as q
from cvlake.llm import toxicity
from cvlake.llm.common import fresh, is_small, shared_path, stored, table
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Labels come from the table of labels, texts from docs."""
    model = q.toxicity_model(spark, docs, sf_dir)
    return docs.where(toxicity.toxic_score(F.col("text"), model, spark) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram similarity, the row with the smallest id stays (once, if repeated).

    Rows are told apart by id and text, so another text of an id is judged by itself. Documents without an id are in no
    group and stay. Those without a word are in no group, too; one that repeats id and text of another stays once.
    """
    spot, turn = fresh(docs, "_spot"), fresh(docs, "_turn")
    rows = ngram_join.row_classes(docs)
    # of the rows with the group's smallest id, which may have several texts, one stays
    group = F.coalesce("root", F.encode(F.col("spot").cast("string"), "UTF-8"))
    least = rows.where(F.col("class_id") == F.col("doc_id")).groupBy(group.alias("group"), "doc_id").agg(F.min("spot").alias("spot"))
    stay = least.select("doc_id", F.col("spot").alias(spot)).distinct()
    # names decide, so texts are only joined with them: those that go, and those of rows that are there more than once
    names = rows.groupBy("doc_id", F.col("spot").alias(spot)).agg(F.count(F.lit(1)).alias("n")).join(stay.withColumn("stays", F.lit(True)), ["doc_id", spot], "left")
    noted = stored(names.where(F.col("stays").isNull() | (F.col("n") > 1)), "noted")
    noted = noted.select(F.col("doc_id"), F.col(spot), F.col("stays").isNotNull().alias(turn))
    noted = F.broadcast(noted) if is_small(noted) else noted
    told = docs.withColumn(spot, F.xxhash64("text")).join(noted, ["doc_id", spot], "left")
    once = Window.partitionBy("doc_id", spot).orderBy(F.length("text"))
    repeated = told.where(F.col(turn)).withColumn(turn, F.row_number().over(once)).where(F.col(turn) == 1)
    names = [f"`{c}`" for c in docs.columns]
    return told.where(F.col(turn).isNull()).select(*names).unionByName(repeated.select(*names))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; n_chars follows where a text has changed. Every document stays."""
    old = fresh(docs, "_old")
    cut = secrets.redacted(docs.withColumn(old, F.xxhash64("text")), secrets.new_ledger(spark), "documents", "doc_id")
    chars = F.when(F.col(old) == F.xxhash64("text"), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return cut.withColumn("n_chars", chars).select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    spec = bpe.read_spec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", "source", "lang", bpe.digests(spec, F.col("text")).alias("d")).select("doc_id", "source", "lang", "d.*")


STAGES = [("toxicity", toxic), ("ngram_join", near_duplicates), ("decontamination", benchmark_leaks), ("secrets", secret_redaction), ("bpe", tokens)]

#: A learned classifier decides in the first stage, so SQL cannot give run()'s rows; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
