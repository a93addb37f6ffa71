"""The candidates table: one partition for each sector, replaced as a whole by upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvlake.config import CONFIG
from cvlake.functions.terms import index_changes, merged_terms
from cvlake.sources.commits import Commits

#: Used only by a session in one process that names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/cvlake-shared"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or LOCAL_SHARED).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back: lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is at path; any other trouble than that it isn't there is raised."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or an empty one
            raise
        return False
    return True


def upsert(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """K2: rows of new replace those of existing with the same key (file_id, if none is named); rows that new lacks stay.

    A key that is twice in new must not differ there. Two shuffles by key, or one broadcast if new is small.
    """
    key = list(key or ("file_id",))
    return existing.join(new.select(*key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row for each key: the last by order. For change logs in which a key occurs more than once."""
    best = rows.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def sync_counters(seen: DataFrame, result: DataFrame, errors: DataFrame) -> DataFrame:
    """K3: (sector, total_files_seen, total_candidates, errors)."""
    count = lambda df, name: df.groupBy("sector").agg(F.count(F.lit(1)).alias(name))
    joined = count(seen, "total_files_seen").join(count(result, "total_candidates"), "sector", "full").join(count(errors, "errors"), "sector", "full")
    return joined.select("sector", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files_seen", "total_candidates", "errors")])


def save_candidates(candidates: DataFrame, path: str) -> None:
    """K1: replaces the partitions of the sectors that candidates has, and no others."""
    candidates.sortWithinPartitions("sector", F.lower("file_name")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sector").parquet(path)


def save_sector_json(candidates: DataFrame, path: str) -> None:
    """K1 as JSON lines, for other readers."""
    candidates.sortWithinPartitions("sector", F.lower("file_name")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sector").json(path)


def load_candidates(spark: SparkSession, path: str, sectors: tuple[str, ...] = CONFIG.sectors) -> DataFrame:
    """Candidates of the given sectors; other partitions are not read. A broken file is an error, not an empty table."""
    return spark.read.parquet(path).where(F.col("sector").isin(*sectors))


def _versions(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the state that counts: of each sector the version of its rows, and the versions of the index."""
    return Commits(spark, path).last()


def _rows(spark: SparkSession, path: str, state: dict, sectors: list[str] | None = None) -> DataFrame | None:
    """Candidates of a state; one read for each version, each of which has whole sectors."""
    by_version: dict[str, list] = {}
    for sector, version in state.get("sectors", []):
        if sectors is None or sector in sectors:
            by_version.setdefault(version, []).append(sector)
    out = None
    for version, mine in sorted(by_version.items()):
        of = F.col("sector").isin(*[s for s in mine if s is not None])
        part = spark.read.parquet(f"{path}/data/{version}").where(F.coalesce(of, F.lit(None in mine)))
        out = part if out is None else out.unionByName(part)
    return out


def synced(spark: SparkSession, path: str, sectors: list[str] | None = None) -> DataFrame | None:
    """The state of a table that sync() keeps, or None before the first sync."""
    return _rows(spark, path, _versions(spark, path)[1], sectors)


def sync(spark: SparkSession, path: str, new: DataFrame, order: str | None = None, index: bool = False) -> DataFrame:
    """O1, K2: upsert parsed candidates (sector, file_id, ...) into the table at path and give its new state.

    Rows with a non-null column error (files that could not be read) change nothing: what was known of such a file stays.
    A row replaces that of the same sector and file_id; with order (a column, such as a time), only if it isn't older, and
    rows may come in any order and any number of calls: of equal ones the greater hash wins, so the result is the same.

    What comes in is written once, its sectors are merged into a new version, and a numbered state puts that in the place of
    their last ones. If another sync was faster, the sectors that it changed are merged again from its result, so overlapping
    syncs keep the changes of both. A crash at any point leaves the earlier state, and a sync that is run again gives the
    same state. index keeps term counts of _search_text up to date in the same state (see TermIndex); a table that has
    them keeps them.
    """
    if "error" in new.columns:
        new = new.where(F.col("error").isNull()).drop("error")
    return _commit(spark, path, new, lambda old, came: _merge(old, came, order), index)


def replace_sectors(spark: SparkSession, path: str, candidates: DataFrame, index: bool = False) -> DataFrame:
    """K1 by the same states as sync(): the sectors that candidates has are replaced as a whole, others stay."""
    return _commit(spark, path, candidates, None, index)


KEY = ["sector", "file_id"]
#: Files that a task writes side by side, one for each sector or part; with more of them it sorts its rows.
OPEN_FILES = 16
#: Rows that a task of a merge sorts, about.
ROWS_OF_A_TASK = 500_000
#: Versions of signed term counts that are kept apart at most.
MOST_CHANGES = 16


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session while something is written."""
    before = {k: spark.conf.get(k) for k in (f"spark.sql.{name.replace('__', '.')}" for name in values)}
    for k, v in zip(before, values.values()):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write_by(column: str, rows: DataFrame, path: str, **options: str) -> None:
    """Write rows in a folder for each value. Rows of a few values aren't sorted for it, which takes longer than counting them."""
    with settings(rows.sparkSession, maxConcurrentOutputFileWriters=str(OPEN_FILES)):
        rows.write.options(**options).partitionBy(column).parquet(path)


def _merge(old: DataFrame | None, came: DataFrame, order: str | None) -> DataFrame:
    if order is None:
        return came if old is None else upsert(old, came, *KEY)
    rows = came if old is None else old.select(*came.columns).unionByName(came)
    n = came.count() + (0 if old is None else old.count())
    if n > ROWS_OF_A_TASK:  # in more tasks, not in larger ones
        rows = rows.repartition(max(-(-n // ROWS_OF_A_TASK), came.sparkSession.sparkContext.defaultParallelism), *KEY)
    return latest(rows, KEY, F.col(order), F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(came.columns)]))


def _commit(spark: SparkSession, path: str, new: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame] | None, index: bool) -> DataFrame:
    """merge: of a sector's rows and what comes in; without it what comes in is a version as it is, and needs no copy before."""
    came_in = uuid.uuid4().hex
    if merge is None:
        write_by("sector", new, f"{path}/data/{came_in}")
        came = spark.read.schema(new.schema).parquet(f"{path}/data/{came_in}")
    else:
        came = written(new, f"{path}/incoming/{came_in}")
    mine = [r.sector for r in came.select("sector").distinct().collect()]
    done: dict = {}
    while mine:
        turn, state = _versions(spark, path)
        before = {s: v for s, v in state.get("sectors", [])}
        seen = [before.get(s) for s in mine]
        if done.get("seen") != seen:  # of another sync that was faster, only one that changed these sectors matters
            changes = uuid.uuid4().hex
            version = came_in if merge is None else changes
            old = _rows(spark, path, state, mine) if merge or index or "terms" in state else None
            if merge is not None:
                write_by("sector", merge(old, came), f"{path}/data/{version}")
            done = {"seen": seen, "version": version, "changes": changes}
            if index or "terms" in state:
                write_by("sector", index_changes(old, spark.read.parquet(f"{path}/data/{version}")), f"{path}/terms/{changes}", compression="zstd")
        after = {"sectors": [*[[s, v] for s, v in before.items() if s not in mine], *[[s, done["version"]] for s in mine]]}
        if index or "terms" in state:
            if before and "terms" not in state:
                raise ValueError("a table gets an index by its first sync or by TermIndex.build")
            terms = [*state.get("terms", []), done["changes"]]
            if len(terms) > MOST_CHANGES:  # one version in place of many, in the same state
                version = uuid.uuid4().hex
                write_by("sector", merged_terms(spark, [f"{path}/terms/{v}" for v in terms]), f"{path}/terms/{version}", compression="zstd")
                terms = [version]
            after["terms"] = terms
        log = Commits(spark, path)
        if log.put(turn + 1, state | after):
            if merge is not None:
                log.drop(f"incoming/{came_in}")
            break
    out = synced(spark, path)
    return came if out is None else out
