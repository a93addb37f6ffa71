"""Approximate nearest neighbours by a permutation index.

Pivots are a sample of distinct vectors, PIVOTS * sqrt(n) of them. A vector is represented by its pivots in order of
nearness. It is posted in the lists of its first pivots: of all whose inner product with it reaches a level set so that
a vector has POSTED lists on average, and of its LEAST_POSTED nearest in any case; a long vector, which can be near to
many queries, has more. A query looks into the lists of its PROBED * n^(1/3) nearest pivots. In a list, candidates are
ranked by the footrule distance between permutations, as similarity times length; of the NEAR first lists all, of the
others the best RERANK or SHARE, are compared with the query by the true measure, the inner product in double precision.
A list holds about POSTED / PIVOTS * sqrt(n) vectors, so a query meets some n^(5/6) of n, and never all.

Equal vectors are one class, which keeps its k + 1 smallest ids: no query can use more, so a vector that a third of all
rows have is posted and asked once. A pair that meets in several lists is looked at only in the one that is first in the
query's order. Lists are cut into cells of about CELL postings (and CELL_QUERIES queries), so a pivot near a third of all
vectors gives more cells and not a larger one. A task merges what its cells found before it reports k + 1 for a query.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id; vectors of
other lengths count as filled up with zeros. Repeated rows are one row. An id with several vectors gives one result for
each of them, and is a candidate by each of them for other ids, never for itself. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvlake.llm.common import stored

PIVOTS, LEAST_PIVOTS, DEPTH, POSTED, LEAST_POSTED = 8.0, 64, 64, 8, 2
PROBED, LEAST_PROBED, NEAR, RERANK, SHARE = 3.0, 64, 8, 64, 0.25
CELL, CELL_QUERIES, HELD = 1024, 4096, 400_000


class Pivots(NamedTuple):
    vectors: np.ndarray  # unit length, float32
    width: int  # places kept of a permutation
    level: float  # inner product from which a vector is posted with a pivot


class Plan(NamedTuple):
    """Numbers of an index over n classes of vectors."""

    pivots: int
    probed: int
    depth: int

    @staticmethod
    def of(n: int) -> Plan:
        pivots = max(1, min(n, max(LEAST_PIVOTS, round(PIVOTS * math.sqrt(n)))))
        return Plan(pivots, min(pivots, max(LEAST_PROBED, math.ceil(PROBED * n ** (1 / 3)))), min(pivots, DEPTH))


def usable(vector: Column) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(rows: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros to the longest."""
    values, ends = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))
    return padded(np.split(values, ends[:-1])) if len(rows) else np.zeros((0, 0))


def padded(rows: list) -> np.ndarray:
    lengths = {len(r) for r in rows}
    if len(lengths) == 1:
        return np.stack(rows).astype(np.float64)
    out = np.zeros((len(rows), max(lengths)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def nearness(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = min(x.shape[1], pivots.shape[1])
    return x[:, :d].astype(np.float32) @ pivots[:, :d].T


def choose_pivots(classes: DataFrame, n: int, plan: Plan, most: int = 4096) -> Pivots:
    """Pivots, and the level of posting, from a sample chosen by hash: at most 8 sqrt(n) + most vectors reach the driver."""
    wanted = plan.pivots + most
    spot = F.pmod(F.xxhash64("k1", "k2"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = classes.where(spot < min(1.0, 1.5 * wanted / n)).orderBy(F.xxhash64("k1", "k2"), "k1", "k2").select("embedding").limit(wanted)
    x = matrix(rows.toArrow().column("embedding").combine_chunks())
    unit = x[: plan.pivots] / np.linalg.norm(x[: plan.pivots], axis=1, keepdims=True)
    best = []
    for at in range(0, len(x), 1024):  # the sample's own vectors stand for all: how near are their first pivots?
        near = nearness(x[at : at + 1024], unit)
        best.append(-np.partition(-near, min(plan.depth, near.shape[1]) - 1, axis=1)[:, : plan.depth].ravel())
    best = np.concatenate(best)
    count = min(len(best), POSTED * len(x))
    return Pivots(unit.astype(np.float32), max(plan.depth, plan.probed), float(np.partition(best, len(best) - count)[len(best) - count]))


def orders(x: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivots of each vector, nearest first, and how many of them it is posted with."""
    near = nearness(x, pivots.vectors)
    n = min(pivots.width, near.shape[1])
    first = np.argpartition(-near, n - 1, axis=1)[:, :n]
    value = np.take_along_axis(near, first, 1)
    order = np.lexsort((first, -value), axis=1)
    posts = (value >= pivots.level).sum(1).clip(LEAST_POSTED, DEPTH)
    return np.take_along_axis(first, order, 1).astype(np.int32), np.minimum(posts, n).astype(np.int32)


def permutation(vector: Column, pivots: Pivots, spark) -> Column:
    """struct<perm, posts>: a vector column's nearest pivots in order, and the number of lists it is posted in."""
    shared = spark.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<perm:array<int>,posts:int>")
    def nearest(rows: pa.Array) -> pa.Array:
        kind = [pa.list_(pa.int32()), pa.int32()]
        if not len(rows):
            return pa.StructArray.from_arrays([pa.array([], k) for k in kind], ["perm", "posts"])
        perm, posts = (np.concatenate(p) for p in zip(*(orders(matrix(rows.slice(at, 1024)), shared.value) for at in range(0, len(rows), 1024))))
        lists = pa.ListArray.from_arrays(np.arange(0, perm.size + 1, perm.shape[1], dtype=np.int32), pa.array(perm.ravel(), pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(posts, pa.int32())], ["perm", "posts"])

    return nearest(vector)


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(k1, k2, ids, embedding): distinct vectors with their k + 1 smallest ids; (k1, k2) is a hash of 96 bits.

    The window keeps k + 1 rows of a class before it shuffles, so a very frequent vector is no large group.
    """
    once = rows.groupBy("k1", "k2", "vec_id").agg(F.first("embedding").alias("embedding"))
    few = once.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return few.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))


def rank_cell(x: np.ndarray, order: np.ndarray, posts: np.ndarray, v: np.ndarray, asked: np.ndarray, pivot: int, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, posting, score) by place, of the pairs of a cell that the footrule ranking leaves.

    x, order, posts: postings' vectors, their permutations and numbers of lists; v, asked: the queries' likewise.
    """
    n, depth = order.shape
    probed = asked.shape[1]
    long = np.linalg.norm(x, axis=1)
    # a posting keeps depth places of its permutation, stretched to the probed places of a query
    steps = (np.arange(depth, 0, -1) * probed // depth).astype(np.int16)
    not_posted = np.arange(depth) >= posts[:, None]
    least, portion = max(RERANK, math.ceil(n * SHARE)), max(1, min(4_000_000 // n_pivots, 4_000_000 // (n * depth)))
    out = []
    for at in range(0, len(v), portion):
        perm = asked[at : at + portion]
        rows = np.arange(len(perm))[:, None]
        weight = np.zeros((len(perm), n_pivots), np.int16)
        weight[rows, perm] = np.arange(probed, 0, -1, dtype=np.int16)
        here = weight[:, pivot]
        met = weight[:, order.ravel()].reshape(len(perm), n, depth)
        own = np.where(not_posted, 0, met).max(2) == here[:, None]
        # footrule distance of permutations = constant - 2 * the smaller weights' sum
        alike = np.where(own, np.minimum(met, steps).sum(2, dtype=np.int32) * long, -1.0)
        near = here > probed - NEAR
        if n > least and not near.all():
            cut = -np.partition(-alike, least - 1, axis=1)[:, least - 1]
            own &= near[:, None] | (alike >= cut[:, None])
        a, b = np.nonzero(own)
        for s in range(0, len(a), 50_000):
            i, j = a[s : s + 50_000], b[s : s + 50_000]
            out.append((i + at, j, np.einsum("ij,ij->i", v[i + at], x[j])))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 best rows of each query."""
    found = found.sort_values(["k1", "k2", "far", "id"], ignore_index=True)
    return found[found.groupby(["k1", "k2"], sort=False).cumcount() <= k]


def _searcher(n_pivots: int, k: int):
    """Over rows sorted by cell: (k1, k2, found), the k + 1 best of all that a task's cells hold for a query."""

    def search_cell(cell: pd.DataFrame) -> pd.DataFrame | None:
        ask, post = cell[cell["asked"]], cell[~cell["asked"]]
        if not len(ask) or not len(post):
            return None
        both = padded([*ask["embedding"], *post["embedding"]])
        v, x = both[: len(ask)], both[len(ask) :]
        i, j, score = rank_cell(x, np.stack(post["perm"].tolist()), post["posts"].to_numpy(), v, np.stack(ask["perm"].tolist()), int(cell["pivot"].iloc[0]), n_pivots)
        ids = post["ids"].tolist()
        lead = np.array([x[0] for x in ids])
        order = np.lexsort((lead[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        keep = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) <= k
        i, j, score = i[keep], j[keep], score[keep]
        size = np.array([len(x) for x in ids])[j]
        i, score = np.repeat(i, size), np.repeat(score, size)
        return pd.DataFrame({"k1": ask["k1"].to_numpy()[i], "k2": ask["k2"].to_numpy()[i], "far": -score, "id": np.concatenate([ids[x] for x in j]) if len(j) else np.zeros(0, np.int64)})

    def report(found: pd.DataFrame) -> pd.DataFrame:
        rows = [{"k1": key[0], "k2": key[1], "found": list(zip(g["far"], g["id"]))} for key, g in found.groupby(["k1", "k2"], sort=False)]
        return pd.DataFrame(rows, columns=["k1", "k2", "found"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in _cells(batches):
            for _, cell in frame.groupby("cell", sort=False):
                found = search_cell(cell)
                if found is not None and len(found):
                    held.append(found)
                    rows += len(found)
            if rows > HELD:
                held = [_best(pd.concat(held), k)]
                if 2 * len(held[0]) > rows:  # many queries: nothing is gained by waiting
                    yield report(held[0])
                    held = []
                rows = sum(map(len, held))
        if held:
            yield report(_best(pd.concat(held), k))

    return search


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup batches that are sorted by cell so that no cell is cut."""
    rest: list[pd.DataFrame] = []
    for frame in batches:
        if not len(frame):
            continue
        last = frame["cell"].iloc[-1]
        whole = frame["cell"].ne(last)
        if whole.any() or rest and rest[-1]["cell"].iloc[-1] != last:
            yield pd.concat([*rest, frame[whole]], ignore_index=True)
            rest = []
        rest.append(frame[~whole])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by every.

    vectors: (vec_id, embedding).
    """
    spark = vectors.sparkSession
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    good = good.withColumns({"k1": F.xxhash64("embedding"), "k2": F.hash("embedding")})
    queries = good.where(F.col("vec_id") % every == 0).select("k1", "k2", "vec_id").distinct()
    classes = vector_classes(good, k).join(queries.select("k1", "k2").distinct().withColumn("asks", F.lit(True)), ["k1", "k2"], "left")
    classes = stored(classes, "vector-classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    plan = Plan.of(n)
    pivots = choose_pivots(classes, n, plan)
    index = stored(classes.withColumn("p", permutation(F.col("embedding"), pivots, spark)).select("k1", "k2", "ids", "embedding", "asks", "p.perm", "p.posts"), "permutations")

    lists = lambda df, n: df.withColumn("pivot", F.explode(F.slice("perm", 1, n)))
    posted = lists(index.withColumn("perm", F.slice("perm", 1, plan.depth)), F.col("posts"))
    asked = lists(index.where("asks").withColumn("perm", F.slice("perm", 1, plan.probed)), F.lit(plan.probed))
    # one row for each pivot: 8 sqrt(n) rows of two numbers
    count = lambda df, name: df.groupBy("pivot").agg(F.count(F.lit(1)).alias(name))
    sizes = count(posted.select("pivot"), "postings").join(count(asked.select("pivot"), "queries"), "pivot")
    sizes = sizes.select("pivot", F.ceil(F.col("postings") / CELL).alias("cells"), F.ceil(F.col("queries") / CELL_QUERIES).alias("parts"))
    sizes = F.broadcast(stored(sizes, "list-sizes"))
    spot = lambda n: F.pmod(F.xxhash64("k1", "k2", "pivot"), F.col(n))
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posted = posted.join(sizes, "pivot").withColumn("at", spot("cells")).withColumn("part", every_one("parts")).withColumn("asked", F.lit(False))
    asked = asked.join(sizes, "pivot").withColumn("part", spot("parts")).withColumn("at", every_one("cells")).withColumns({"asked": F.lit(True), "ids": F.array().cast("array<bigint>")})
    # exact packing: fewer than 2^20 cells and 2^12 parts of a list
    cell = F.shiftleft(F.col("pivot").cast("bigint"), 32) + F.shiftleft(F.col("at").cast("bigint"), 12) + F.col("part")
    columns = [cell.alias("cell"), "pivot", "asked", "k1", "k2", "ids", "embedding", "perm", "posts"]
    dealt = posted.select(*columns).unionByName(asked.select(*columns)).repartition("cell").sortWithinPartitions("cell")
    found = dealt.mapInPandas(_searcher(plan.pivots, k), "k1 bigint, k2 int, found array<struct<far:double,id:bigint>>")
    # at most k + 1 for each list that a query looked into
    best = found.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("vec_id")), 1, k)
    top = queries.join(best, ["k1", "k2"]).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "n"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.far")).alias("score"))
