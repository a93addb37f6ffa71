"""The registry of sectors as a table: which folder of the store each has, and its candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvlake.config import CONFIG, Config
from cvlake.functions.text import strip
from cvlake.sources import listing, store


def registered(rows: DataFrame) -> DataFrame:
    """O2: (sector, folder, file) of a table (sector, link[, file]), where a link is a folder's address or its bare id.

    file is lower-cased sector and "candidates.json" where none is given. Rows without a sector are left out; a link without
    an id is an error. Of several rows of a sector the least (folder, file) counts, so repeated rows change nothing.
    """
    sector = strip(F.col("sector"))
    file = F.concat(F.lower(sector), F.lit("candidates.json"))
    if "file" in rows.columns:
        file = F.coalesce(F.nullif(strip(F.col("file")), F.lit("")), file)
    named = rows.where(F.coalesce(sector, F.lit("")) != "")
    entry = F.struct(listing.resource_id(F.col("link"), strict=True).alias("folder"), file.alias("file"))
    return named.groupBy(sector.alias("sector")).agg(F.min(entry).alias("_e")).select("sector", "_e.*")


def sector_files(edges: DataFrame, registry: DataFrame, chosen: tuple[str, ...] | None = None, config: Config = CONFIG) -> DataFrame:
    """(sector, id, name, virtual_path) of the résumé files below the folders of all registered sectors, or of the chosen.

    One walk for all sectors, level by level: its jobs grow with the depth of the tree, not with the number of sectors. A file
    below the folders of two sectors is a file of both, with a path in each.
    """
    if chosen is not None:
        registry = registry.where(F.col("sector").isin(*chosen))
    roots = registry.select(F.col("sector").alias("root"), "folder", F.lit("").alias("prefix"))
    return listing.resumes_below(edges, roots, config=config).withColumnRenamed("root", "sector")


def sync_registered(spark: SparkSession, path: str, edges: DataFrame, registry: DataFrame, parse: Callable[[DataFrame], DataFrame], chosen: tuple[str, ...] | None = None) -> DataFrame:
    """O1 for every registered sector (or the chosen) in one sync; K3 of it: (sector, total_files_seen, total_candidates, errors).

    parse makes candidates (sector, file_id, file_name, ..., error) of the files that sector_files() lists, where error is null
    but for files that could not be read. Listing and candidates are written once each, so what is counted is what was
    synced. A sector whose folder has no files keeps its earlier candidates.
    """
    files = store.written(sector_files(edges, registry, chosen), store.scratch(spark, "listed"))
    parsed = store.written(parse(files), store.scratch(spark, "parsed"))
    result = store.sync(spark, path, parsed)
    if chosen is not None:
        result = result.where(F.col("sector").isin(*chosen))
    return store.sync_counters(files, result, parsed.where(F.col("error").isNotNull()))
