"""op12: fingerprints and components against brute force, with large cells, copies and hard cases."""

import numpy as np
import pytest
import re
import xxhash
from pyspark.sql import functions as F

from cvlake.llm import queries, simhash

DOCS = "doc_id bigint, text string, fp string, component_id string"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    """The smallest place that each fingerprint is connected with, by comparing all pairs."""
    prints, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_op12_is_what_all_pairs_give(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(d.text) for d in docs]
    wanted = {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, plain_components(prints))}
    got = queries.op12_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == wanted and len(got) == len(docs)


def test_near_copies_are_linked(spark):
    """A chain of small edits of a long text, and texts that share no shingle."""
    base = [f"word{i * i % 1009}" for i in range(3_000)]
    texts = [(i, " ".join(base[: 500 + i] + ["changed"] + base[501 + i :])) for i in range(8)] + [(100 + i, " ".join(f"x{i}y{j * j % 97}" for j in range(60))) for i in range(20)]
    rows = simhash.simhash_components(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    prints = [plain_print(t) for _, t in texts]
    assert {r.doc_id: r.component_id for r in rows} == {texts[i][0]: texts[r][0] for i, r in enumerate(plain_components(prints))}
    assert sum(r.component_id == 0 for r in rows) > 1


@pytest.mark.parametrize("cell", [3, 64, simhash.CELL])
def test_links_of_crowded_cells(spark, cell):
    """A third of all fingerprints within a few bits of one, so that every probe has a large cell."""
    rng = np.random.default_rng(5)
    hot = int(rng.integers(2**63)) ^ 1 << 63
    prints = {hot ^ sum(1 << int(b) for b in rng.integers(0, 64, k)) for k in range(6) for _ in range(60)}
    prints |= {int(x) for x in rng.integers(0, 2**63, 500)}
    prints |= {p ^ 1 << 63 ^ 1 << int(rng.integers(63)) for p in list(prints)[:100]}
    prints = sorted(prints)
    low = [p - 2**64 if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in low], "fp bigint"), cell=cell).collect()
    root = list(range(len(prints)))
    at = {p: i for i, p in enumerate(low)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = find(at[e.a]), find(at[e.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == plain_components(prints)


def test_thresholds_cover_every_pair():
    """For crowded and empty tables and skewed bits: any two fingerprints within the distance share a probe."""
    rng = np.random.default_rng(7)
    for n, skew in ((2, 0.5), (10**4, 0.5), (10**8, 0.9), (10**13, 0.5)):
        x = (rng.random((4_000, 64)) < np.where(np.arange(64) % 3, 0.5, skew)).astype(float)
        x[:, 1:9] = x[:, :1]  # bits that always agree
        both = x.T @ x * (n / len(x))
        order = simhash.bit_order(n, both)
        assert sorted(order) == list(range(64))
        parts = simhash.allocate(n, both, order)
        assert sum(t + 1 for _, t in parts) == simhash.DISTANCE + 1
        probes = [set(p) for p in simhash.probe_masks(parts)]
        for _ in range(300):
            apart = set(rng.integers(0, 64, 2).tolist())
            assert any(not (apart & p) for p in probes)
            for p in probes[:3]:
                if not (apart & p):
                    assert any(not (apart & set(q)) for q in simhash.finer(list(p), order))


def test_simhash_hard_cases(spark):
    long = " ".join(f"Word{i % 977}" for i in range(200_000))
    texts = [(1, None), (2, ""), (3, " \t\x0b"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (7, long), (7, "other text of the same id"), (None, "one"), (8, "é É x"), (9, "é é x"), (None, None)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in texts], DOCS)
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == {"doc_id", "fp", "component_id"}
    of = {(r.doc_id, r.fp % 2**64): r.component_id for r in rows}
    assert all((i, plain_print(t)) in of for i, t in texts)
    assert of[1, 0] == of[2, 0] == of[3, 0] == of[None, 0] == 1
    assert of[4, plain_print("one")] == of[5, plain_print("one")] == of[None, plain_print("one")] == 4
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert simhash.simhash_components(docs.where("doc_id is null and text is not null")).select(F.col("component_id")).collect()[0][0] is None
