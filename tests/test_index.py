"""The stored index and the syncs that keep it: overlap, crashes, order of changes, and searches that skip blocks."""

import random

import pytest
from pyspark.sql import functions as F

from cvlake.config import CONFIG
from cvlake.plans import parse, search
from cvlake.plans.corpus import cv_corpus
from cvlake.plans.index import TermIndex
from cvlake.sources import store
from cvlake.sources.commits import Commits
from cvlake.streaming import upsert

ROW = "file_id int, sector string, _search_text string, synced_at int"


def rows(spark, *ids, sector="security", text="guard {}", at=1):
    return spark.createDataFrame([(i, sector, text.format(i), at) for i in ids], ROW)


def kept(spark, path):
    return sorted((r.sector, r.file_id, r._search_text) for r in store.synced(spark, path).collect())


def counts(index):
    return sorted(tuple(r) for r in index.counts().collect())


def rebuilt(spark, path):
    return counts(TermIndex.build(spark, store.scratch(spark, "rebuilt"), store.synced(spark, path)))


def test_states_are_numbered_once(spark):
    log = Commits(spark, store.scratch(spark, "log"))
    assert log.last() == (0, {})
    assert log.put(1, {"a": 1}) and not log.put(1, {"a": 2}) and log.put(2, {"a": 3})
    assert log.last() == (2, {"a": 3})


@pytest.mark.parametrize("index", [False, True])
def test_overlapping_syncs_keep_both(spark, monkeypatch, index):
    """A second sync runs from start to end while the first is about to commit; then a third, of another sector."""
    path = store.scratch(spark, "overlap")
    store.sync(spark, path, rows(spark, 0), index=index)
    put, others = Commits.put, [rows(spark, 2, text="porter {}"), rows(spark, 3, sector="warehouse")]

    def late(log, turn, state):
        if others and log.path == path:
            store.sync(spark, path, others.pop(0))
        return put(log, turn, state)

    monkeypatch.setattr(Commits, "put", late)
    store.sync(spark, path, rows(spark, 1))
    assert [r[:2] for r in kept(spark, path)] == [("security", 0), ("security", 1), ("security", 2), ("warehouse", 3)]
    assert Commits(spark, path).last()[0] == 4
    if index:
        assert counts(TermIndex(spark, path)) == rebuilt(spark, path)


def test_index_follows_syncs_and_crashes(spark, monkeypatch):
    """After inserts, replacements, a replaced sector, a crash and a merge of versions it equals one that is made anew."""
    path = store.scratch(spark, "indexed")
    store.sync(spark, path, rows(spark, 1, 2, 3, text="night guard {} and night shift"), index=True)
    store.sync(spark, path, rows(spark, 2, 4, text="forklift driver {}").unionByName(rows(spark, 2, sector="warehouse")))
    store.sync(spark, path, rows(spark, 1, text=""))
    before = counts(TermIndex(spark, path))
    assert before == rebuilt(spark, path)
    with monkeypatch.context() as m:
        m.setattr(Commits, "put", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.sync(spark, path, rows(spark, 9))
    assert counts(TermIndex(spark, path)) == before
    store.replace_sectors(spark, path, rows(spark, 7, 2, sector="warehouse"))
    monkeypatch.setattr(store, "MOST_CHANGES", 3)
    store.sync(spark, path, rows(spark, 3, 5, text="merged {}"))
    assert len(Commits(spark, path).last()[1]["terms"]) == 1
    assert counts(TermIndex(spark, path)) == rebuilt(spark, path)
    plain = store.scratch(spark, "plain")
    store.sync(spark, plain, rows(spark, 1))
    with pytest.raises(ValueError):
        store.sync(spark, plain, rows(spark, 2), index=True)


def test_any_split_of_changes_gives_the_same_table(spark):
    rng = random.Random(4)
    changes = [(rng.randint(1, 4), rng.choice(["security", "warehouse"]), f"text {rng.randint(0, 2)}", rng.choice([None, 1, 2, 3])) for _ in range(24)]
    tables = []
    for split in (1, 3, 6):
        path, source = store.scratch(spark, "streamed"), store.scratch(spark, "changes")
        mixed = rng.sample(changes, len(changes))
        for i in range(split):
            spark.createDataFrame(mixed[i::split], ROW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
        upsert.start_upserts(stream, path, store.scratch(spark, "checkpoint")).awaitTermination()
        tables.append(kept(spark, path))
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == len({c[:2] for c in changes})


@pytest.fixture(scope="module")
def searched(spark, sf_dir):
    path = store.scratch(spark, "searched")
    candidates = parse.candidates(cv_corpus(spark, sf_dir)).withColumn("vector", F.array(F.col("file_id").cast("float") % 7, F.lit(1.0).cast("float")))
    store.sync(spark, path, candidates, index=True)
    return store.synced(spark, path), TermIndex(spark, path)


@pytest.mark.parametrize(
    "query,more",
    [("SIA Door Supervisor, CCTV, 5 years customer service", {}), ("forklift", {"min_score": 0.2}), ("andaa station road", {"top_k": 3}), ("Maria M1 0NU", {}), ("nothing of this zzz", {}), ("forklift night", {"query_vector": [1.0, 2.0]}), ("of the", {})],
)
def test_rank_by_index_is_rank(searched, query, more):
    candidates, index = searched
    plain = search.rank(candidates, query, **more).select("file_id", F.round("score", 8).alias("score"), "explain.years").collect()
    for size in (4, 128):
        found = search.rank(candidates, query, index=index.view(block_docs=size), **more).select("file_id", F.round("score", 8).alias("score"), "explain.years").collect()
        assert found == plain


def test_search_skips_blocks(spark, searched):
    """A search for a name scores the postings of few blocks, and gives what sorting all gives."""
    candidates, index = searched
    view = index.view(block_docs=4)
    query = candidates.select("parsed.personal_information.full_name").orderBy(F.col("file_id").cast("int")).first()[0] + " station road"
    asked = candidates.sparkSession.range(1).select(search.parse_query(F.lit(query)).alias("q"))
    keep = search.best_blocks(candidates, query, 1, asked, CONFIG, None, None, view)
    terms = view.asked(query)
    every, some = view.postings(terms).count(), view.postings(terms, keep).count()
    assert some < every / 2
    assert search.rank(candidates, query, 1, index=view).select("file_id").collect() == search.rank(candidates, query, 1).select("file_id").collect()
    # bounds hold for every candidate
    over = view.scores(terms).withColumn("block", view.block()).join(view.bounds(terms), "block", "left").where("tfidf > coalesce(bound, 0) + 1e-9")
    assert over.count() == 0


def test_search_reads_files_of_its_terms(searched):
    """The scan has the query's terms as partition and data filters; other files are not opened."""
    _, index = searched
    view = index.view(files=16)
    found = view.postings(view.asked("forklift"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,forklift)" in plan
    assert "part" in plan[plan.index("PartitionFilters") :][:200]
    assert len(found.inputFiles()) == 16 > len({r[0] for r in found.select(F.input_file_name()).collect()})
    assert len(view.table("postings").select("part").distinct().collect()) > 8


def test_index_of_nothing(spark):
    path = store.scratch(spark, "empty")
    index = TermIndex.build(spark, path, rows(spark, 1, text="the of"))
    view = index.view()
    assert view.n == 2 and view.scores(view.asked("guard the")).count() == 0 and view.bounds(view.asked("")).count() == 0
