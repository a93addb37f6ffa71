"""Every query of the reference's operators, against its SQL."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from cvlake import oracle, queries
from cvlake.functions import text
from cvlake.sources import documents, listing, store

@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], oracle.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


def test_entry_points(spark):
    assert set(queries.queries()) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).columns


def test_many_files_and_levels(spark):
    """A deep listing, with a cycle and a folder that two paths reach."""
    deep = [(f"f{i}", f"f{i + 1}", f"d{i}", True) for i in range(20)]
    rows = [("root", "f0", "top", True), *deep, ("f20", "root", "back", True), ("f3", "f5", "a", True), ("f20", "x", "cv.pdf", False), ("f5", "y", "resume.docx", False)]
    found = listing.list_resumes(spark.createDataFrame(rows, "parent_id string, id string, name string, is_folder boolean"), "root").collect()
    assert {(r.id, r.virtual_path) for r in found} == {("y", "top/d0/d1/d2/a/resume.docx"), ("x", "top/d0/d1/d2/a/" + "/".join(f"d{i}" for i in range(5, 20)) + "/cv.pdf")}


def test_long_texts_in_short_time(spark):
    """Spellings and page lines of one row with very many items take no quadratic time."""
    items = [f"Word{i % 20_000}" if i % 3 else f"WORD{i % 20_000}" for i in range(60_000)]
    rows = spark.createDataFrame([(items,)], "items array<string>")
    (got,) = rows.select(text.first_spellings(F.col("items"))).first()
    assert len(got) == 20_000 and got[:3] == ["WORD0", "Word1", "Word2"]
    pages = spark.createDataFrame([([["same", f"line {i}"] for i in range(20_000)],)], "pages array<array<string>>")
    assert pages.select(F.size(F.flatten(documents.drop_repeated_lines(F.col("pages"))))).first()[0] == 20_000


def test_sync_after_a_crash(spark, monkeypatch):
    """A sync that fails after its data are written leaves the earlier state."""
    path = store.scratch(spark, "sync")
    rows = lambda n: spark.createDataFrame([(n, "security", "a"), (n + 1, "warehouse", "b")], "file_id int, sector string, file_name string")
    store.sync(spark, path, rows(1))
    with monkeypatch.context() as m:
        m.setattr(store, "_versions", lambda *_: {"security": 1 / 0})
        with pytest.raises(ZeroDivisionError):
            store.sync(spark, path, rows(5))
    assert sorted(r.file_id for r in store.synced(spark, path).collect()) == [1, 2]
    rows(9).write.partitionBy("sector").parquet(f"{path}/data/not-entered")
    assert sorted(r.file_id for r in store.sync(spark, path, rows(2)).collect()) == [1, 2, 2, 3]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.load_candidates(spark, path + "-none")
