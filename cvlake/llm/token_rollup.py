"""Token counts kept up to date by signed deltas.

A batch of changes - inserts, deletes, revisions, recounts by a new tokenizer version - becomes signed rows, which are
summed to one row for each (source, lang, version) and committed under the batch's id. Totals are sums over all
committed batches, so they are additive and never need the documents again. A batch id that is there already is not
applied twice; ledger and rollup of a batch become visible by one entry, so a batch that failed at any point leaves the
earlier state and is made anew from that state when it is run again.

What a document counted for is kept in a ledger of the same signed rows, so a delete or a revision takes back exactly
what was added, though the text may be gone. Null source or lang is a group of its own; null text counts 0 tokens.
All sums are partial before the shuffle, so one source with a third of all rows costs nothing extra.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvlake.llm import bpe
from cvlake.llm.common import Batches

KEYS = ("source", "lang", "version")
MEASURES = ("docs", "tokens", "chars")
LEDGER = "doc_id bigint, source string, lang string, version string, docs bigint, tokens bigint, chars bigint"
ROLLUP = "source string, lang string, version string, docs bigint, tokens bigint, chars bigint"


def blank_words(text: Column) -> Column:
    """Runs of anything but blanks."""
    return F.regexp_count(text, F.lit("[^ \t\n\r]+")).cast("bigint")


def letter_runs(text: Column) -> Column:
    """Runs of letters (ASCII and U+00C0 to U+024F), or of digits, or single other signs that are not blank."""
    return F.regexp_count(text, F.lit("[A-Za-zÀ-ɏ]+|[0-9]+|[^A-Za-zÀ-ɏ0-9 \t\n\r]")).cast("bigint")


def library_tokens(spec) -> Callable[[Column], Column]:
    """Counts by a vocabulary that bpe.read_spec() gives, to be registered as a version: TokenRollup(..., {"bpe": library_tokens(spec)})."""
    return lambda text: bpe.digests(spec, text)["n_tokens"]


#: Tokenizer versions by name: functions of a text column.
TOKENIZERS = {"words-1": blank_words, "pieces-2": letter_runs}


class TokenRollup:
    """A rollup and its ledger in a folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, Callable[[Column], Column]] | None = None):
        self.log, self.tokenizers = Batches(spark, folder), TOKENIZERS | (tokenizers or {})

    def counted(self, docs: DataFrame, version: str, sign: int = 1) -> DataFrame:
        """Signed ledger rows of documents (doc_id, text, source, lang)."""
        text = F.coalesce(F.col("text"), F.lit(""))
        return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("bigint").alias("docs"), (sign * self.tokenizers[version](text)).cast("bigint").alias("tokens"), (sign * F.length(text)).cast("bigint").alias("chars"))

    def ledger(self) -> DataFrame:
        return self.log.read("ledger", LEDGER)

    def standing(self) -> DataFrame:
        """What each document counts for now: the ledger's rows summed, without those that came to nothing."""
        return self.ledger().groupBy("doc_id", *KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).where(F.col("docs") > 0)

    def taken_back(self, doc_ids: DataFrame) -> DataFrame:
        """Rows that cancel all that the given documents count for."""
        gone = self.standing().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return gone.select("doc_id", *KEYS, *[(-F.col(m)).alias(m) for m in MEASURES])

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch; False, and no change, if it is committed already."""
        if batch in self.log.committed():
            return False
        attempt = uuid.uuid4().hex
        rows = self.log.write("ledger", attempt, signed)
        self.log.write("rollup", attempt, rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).coalesce(1))
        self.log.commit(batch, attempt)
        return True

    def insert(self, batch: str, docs: DataFrame, version: str) -> bool:
        return self.commit(batch, self.counted(docs, version))

    def delete(self, batch: str, doc_ids: DataFrame) -> bool:
        return self.commit(batch, self.taken_back(doc_ids))

    def revise(self, batch: str, docs: DataFrame, version: str, without: DataFrame | None = None) -> bool:
        """New texts, or the same texts counted by another version: what stood before is taken back in the same batch.

        without: ids to leave alone. They are left out after counting, so that no text is shuffled for it.
        """
        counted, ids = self.counted(docs, version), docs.select("doc_id")
        if without is not None:
            gone = without.select("doc_id").distinct()
            counted, ids = counted.join(gone, "doc_id", "left_anti"), ids.join(gone, "doc_id", "left_anti")
        return self.commit(batch, self.taken_back(ids).unionByName(counted))

    def totals(self) -> DataFrame:
        sums = self.log.read("rollup", ROLLUP).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0) | (F.col("chars") != 0))
