"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session in one process that names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/cvlake-shared"
#: Rows that are broadcast at most, of up to about 160 bytes each (32 MB).
BROADCAST_ROWS = 32 * 1024 * 1024 // 160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or LOCAL_SHARED).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """name, or with signs added until it is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has so few (narrow) rows that it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


class Batches:
    """Batches of rows in a folder of shared storage, each counted once.

    An attempt writes its data under a name of its own and is then entered in the table of commits by one small file.
    Data of an attempt that is not entered are never read, so a crash at any point leaves the earlier state, and nothing
    that is read is ever overwritten. Of two attempts that enter the same batch, the first by name counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def committed(self) -> dict[str, str]:
        """Batch to attempt, of all committed batches (one row for each batch)."""
        try:
            rows = self.spark.read.schema("batch string, attempt string").parquet(f"{self.folder}/commits").groupBy("batch").agg(F.min("attempt").alias("attempt")).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r.batch: r.attempt for r in rows}

    def write(self, name: str, attempt: str, df: DataFrame) -> DataFrame:
        """Write a table of an attempt and read it back."""
        path = f"{self.folder}/{name}/{attempt}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, batch: str, attempt: str) -> None:
        self.spark.createDataFrame([(batch, attempt)], "batch string, attempt string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def read(self, name: str, schema: str, but: str | None = None) -> DataFrame:
        """The table of that name of all committed batches (but one)."""
        paths = [f"{self.folder}/{name}/{a}" for b, a in sorted(self.committed().items()) if b != but]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation.

    The files stay as long as the session's shared folder does.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no model learns labels from (false for a null id)."""
    return F.coalesce(crc_fold(doc_id) == 0, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows whose label may be learned; a null id is in no fold and is left out."""
    return F.coalesce(crc_fold(doc_id) != 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, by: str, rows_per_class: int, most_classes: int = 1_000) -> DataFrame:
    """About rows_per_class rows of each of the most_classes most frequent values of by, chosen by a hash of key.

    Only for choosing rows to fit a model on. One small aggregate over two columns, then a filter: no group is gathered. The
    limit is behind an order by that hash, so the same rows give the same sample; a key that very many rows repeat can't
    exceed it.
    """
    sizes = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(most_classes).collect()
    if not sizes:
        return df.limit(0)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[by], min(1.0, rows_per_class / r["n"]))])
    spot = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.where(spot < share[F.col(by)]).orderBy(F.xxhash64(F.col(key)), key, by).limit(2 * rows_per_class * len(sizes))
