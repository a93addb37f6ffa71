"""The registry of sectors."""

from pyspark.sql import functions as F

from cvlake.sources import registry, store


def test_sync_of_all_registered_sectors(spark):
    """Repeated and blank rows of the registry, a file in two sectors, a file that can't be read, and a sector without files."""
    edges = spark.createDataFrame([("folderaaa", "f1", "cv one.pdf", False), ("folderbbb", "f1", "cv one.pdf", False), ("folderbbb", "f2", "cv two.pdf", False)], "parent_id string, id string, name string, is_folder boolean")
    rows = [("A", "https://s.example/folders/folderaaa"), ("A", "folderaaa"), ("B", "folderbbb"), ("C", "folderccc"), (" ", "x"), (None, None)]
    sectors = registry.registered(spark.createDataFrame(rows, "sector string, link string"))
    assert sorted(map(tuple, sectors.collect())) == [("A", "folderaaa", "acandidates.json"), ("B", "folderbbb", "bcandidates.json"), ("C", "folderccc", "ccandidates.json")]
    parse = lambda files: files.select("sector", F.col("id").alias("file_id"), F.col("name").alias("file_name"), F.when(F.col("id") == "f2", "unreadable").alias("error"))
    counters = registry.sync_registered(spark, store.scratch(spark, "registered"), edges, sectors, parse)
    assert sorted(map(tuple, counters.collect())) == [("A", 1, 1, 0), ("B", 2, 1, 1)]
