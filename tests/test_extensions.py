"""The paged source and the automaton for large catalogues."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvlake.operators import automaton, catalogue, skills
from cvlake.operators.catalogue import Catalogue
from cvlake.plans.corpus import cv_corpus
from cvlake.sources import listing, paged, store


def item(i, folder=False):
    return {"id": f"i{i}", "type": "folders" if folder else "files", "attributes": {"name": f"cv {i}.pdf"}}


def dump(spark, pages):
    path = store.scratch(spark, "pages")
    spark.createDataFrame(pages, "folder string, offset bigint, body string").repartition("folder", "offset").write.partitionBy("folder", "offset").text(path)
    return path


def test_pages_are_read_as_a_store_gives_them(spark):
    """Until a page says that no more follow; a page that is broken or not there is that page's error."""
    page = lambda items, more=False: json.dumps({"data": items} | ({"links": {"next": "x"}} if more else {}))
    pages = [("root", 0, page([item(1, True), item(2)], True)), ("root", 2, page([item(3), item(4)])), ("root", 4, page([item(5)])), ("root", 9, page([item(6)])), ("i1", 0, page([item(7)])), ("broken", 0, "{no json"), ("short", 0, page([item(8)], True)), ("empty", 0, page([]))]
    path = dump(spark, pages)
    spark.dataSource.register(paged.PagedListing)
    got = {(r.folder, r.offset): (r.has_more, r.error) for r in spark.read.format(paged.FORMAT).option("path", path).option("limit", 2).option("folders_per_task", 2).load().collect()}
    assert set(got) == {("root", 0), ("root", 2), ("root", 4), ("i1", 0), ("broken", 0), ("short", 0), ("short", 1), ("empty", 0)}
    assert {k for k, (_, e) in got.items() if e} == {("broken", 0), ("short", 1)} and got["root", 2] == (True, None) and got["root", 4] == (False, None)
    edges = paged.listed_edges(spark, path, limit=2)
    assert {r.id for r in edges.where("error IS NULL").collect()} == {"i1", "i2", "i3", "i4", "i5", "i7", "i8"} and edges.where("error IS NOT NULL").count() == 2
    found = listing.list_resumes(edges.where("error IS NULL"), "root").collect()
    assert {r.virtual_path for r in found} == {"cv 2.pdf", "cv 3.pdf", "cv 4.pdf", "cv 5.pdf", "cv 1.pdf/cv 7.pdf"}


def test_a_page_is_read_again_once(monkeypatch):
    reader, calls = paged.PageReader({"path": "/nowhere"}), []

    def page(self, store_, base, folder, offset):
        calls.append(offset)
        if len(calls) == 1 or offset == 1:
            raise OSError("slow store")
        return json.dumps({"data": [item(1)], "links": {"next": "more"}})

    monkeypatch.setattr(paged.PageReader, "page", page)
    rows = list(reader.read(paged.Folders(("a",))))
    assert calls == [0, 0, 1, 1] and [r[3:] for r in rows] == [(True, None), (False, "OSError: slow store")]


def test_automaton_finds_what_dictionary_hits_finds(spark, sf_dir):
    built_in = Catalogue()
    docs = cv_corpus(spark, sf_dir)
    found = docs.select("doc_id", automaton.entries_in(F.col("text"), automaton.entry_table(spark, built_in)).alias("a"), F.filter(skills.dictionary_hits(F.col("text"), built_in), lambda m: m["method"] == "dictionary").alias("b"))
    names = {r.ord: (r.text, r.canonical, r.confidence) for r in automaton.entry_table(spark, built_in).collect()}
    rows = found.collect()
    assert sum(len(r.a) for r in rows) > len(rows) and all([names[o] for o in r.a] == [(m.text, m.canonical, m.confidence) for m in r.b] for r in rows)


def test_automaton_of_many_spellings(spark, monkeypatch):
    """50,000 spellings; keys inside other keys, repeated keys, empty and null texts."""
    rows = [(i, f"skill {i}", f"skill {i}", f"C{i}", 0.8, "dictionary") for i in range(50_000)] + [(50_000, "kill 12", "x", "y", 0.8, "dictionary"), (50_001, "skill 7", "again", "z", 0.8, "dictionary"), (50_002, "", "e", "e", 0.8, "dictionary")]
    entries = spark.createDataFrame(rows, "ord int, key string, text string, canonical string, confidence double, method string")
    docs = spark.createDataFrame([(1, "My SKILL 123, skill 7"), (2, ""), (3, None), (4, "none")], "doc_id int, text string")
    got = {r.doc_id: r.o for r in docs.select("doc_id", automaton.entries_in(F.col("text"), entries).alias("o")).collect()}
    assert got == {1: [1, 7, 12, 123, 50_000, 50_001], 2: [], 3: None, 4: []}
    assert {(r.doc_id, r.canonical) for r in automaton.dictionary_matches(docs, entries).collect()} == {(1, "C1"), (1, "C7"), (1, "C12"), (1, "C123"), (1, "y"), (1, "z")}
    assert docs.select(automaton.entries_in(F.col("text"), entries.limit(0)).alias("o")).first().o == []
    monkeypatch.setattr(automaton, "MOST_ENTRIES", 100)
    with pytest.raises(ValueError):
        automaton.entries_in(F.col("text"), entries)


def test_vectors_of_many_entries(spark, monkeypatch):
    """50,000 entries; ties, vectors of other lengths, null, zero and not finite ones; the same as with literals."""
    rng = np.random.default_rng(1)
    table = rng.normal(size=(50_000, 8)).round(3)
    table[49_999] = table[17]
    rows = [(i, f"e{i}", v.tolist()) for i, v in enumerate(table)] + [(50_000, "long", [1.0] * 9), (50_001, "zero", [0.0] * 8), (50_002, "nan", [float("nan")] * 8), (50_003, "none", None)]
    entries = spark.createDataFrame(rows, "ord int, canonical string, vector array<double>")
    asked = [(1, table[17].tolist()), (2, (-table[123]).tolist()), (3, None), (4, [0.0] * 8), (5, [2.0] * 9), (6, [1.0]), (7, [float("inf")] * 8)]
    got = {r.id: r.n for r in spark.createDataFrame(asked, "id int, v array<double>").select("id", catalogue.nearest_in(F.col("v"), entries).alias("n")).collect()}
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    best = int((unit @ -unit[123]).argmax())
    assert got[1].canonical == "e17" and got[1].similarity == pytest.approx(1) and got[2].canonical == f"e{best}" and got[5].canonical == "long"
    assert all(got[i].canonical is None and got[i].similarity == 0 for i in (3, 4, 6, 7))
    few = {f"e{i}": table[i].tolist() for i in range(40)}
    both = spark.createDataFrame([(v.tolist(),) for v in table[1_000:1_050]], "v array<double>").select(catalogue.nearest_entry(F.col("v"), few).alias("a"), catalogue.nearest_in(F.col("v"), entries.where("ord < 40")).alias("b")).collect()
    assert all(r.a.canonical == r.b.canonical and r.a.similarity == pytest.approx(r.b.similarity) for r in both)
    monkeypatch.setattr(catalogue, "MOST_NUMBERS", 10)
    with pytest.raises(ValueError):
        catalogue.nearest_in(F.col("v"), entries)
