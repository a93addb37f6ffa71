"""Near duplicates by SimHash: fingerprints of word shingles that differ in a few bits.

Candidates come from a generalised pigeonhole. The 64 bits are put in an order in which correlated bits are neighbours and cut
into partitions; partition i gets a threshold t_i (-1: unused) such that the t_i + 1 sum to the distance asked for plus one,
so two fingerprints within it agree up to t_i bits in one partition at least. Cuts and thresholds come from one dynamic
program over estimated candidate counts. A partition with threshold t is probed by its value with t bits masked, in every way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvlake.llm.common import is_small, stored
from cvlake.llm.ngram_join import components

BITS, WORDS, DISTANCE, SEED = 64, 3, 2, 42
#: Fingerprints of a cell that are compared with each other; larger cells are split by more bits. 2 ** 10, as a cell whose
#: key leaves ten bits open can't hold more.
CELL = 1_024
#: What comparing a pair inside a cell costs, if a posting that goes through a shuffle costs 1.
PAIR_COST = 0.002
#: Shingles that are hashed at a time.
PORTION = 65_536


def fingerprint_of(text: bytes, n: int = WORDS) -> int:
    """Majority of the bits of the hashes of all shingles, repeats included; 0 if the text has no word."""
    words = text.lower().split()  # of bytes: letters A-Z and the six blanks of ASCII only
    if not words:
        return 0
    count, ones = max(1, len(words) - n + 1), np.zeros(BITS, np.int64)
    for at in range(0, count, PORTION):
        shingles = zip(*(words[at + i : min(at + PORTION, count) + i] for i in range(n))) if len(words) >= n else [words]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, shingles)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a bigint of the same bits; that of a null text is 0."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        prints = np.array([fingerprint_of(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()], np.uint64)
        return pa.array(prints.view(np.int64))

    return of(text)


def bit_moments(prints: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both: counted by the tasks; 64 x 64 sums come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(both.ravel())], ["i", "j", "n"])

    both = np.zeros((BITS, BITS))
    for r in prints.select(column).mapInArrow(count, "i bigint, j bigint, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    return prints.count(), both


def bit_order(n: int, both: np.ndarray) -> list[int]:
    """All bits, each next one the most correlated with the last."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, -1)
    order = [int(near.max(1).argmax())]
    while len(order) < BITS:
        left = np.setdiff1d(np.arange(BITS), order)
        order.append(int(left[near[order[-1], left].argmax()]))
    return order


def allocate(n: int, both: np.ndarray, order: list[int], distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions of the ordered bits, and their thresholds (unused partitions left out), of the least estimated cost.

    How many pairs agree in a partition up to t bits is estimated by a Markov chain along its bits: whether two fingerprints
    agree in the next bit depends on whether they do in the last, by the counts of both bits.
    """
    p = np.clip(np.diag(both) / n, 0, 1)
    agree = p * p + (1 - p) * (1 - p)

    def step(j: int, k: int) -> np.ndarray:
        """[a, b]: chance of agreeing (1) or not (0) in k, if that of j is a."""
        one = both[j, k] / n
        cells = np.array([[1 - p[j] - p[k] + one, p[k] - one], [p[j] - one, one]]).clip(0, 1)
        yes = (cells**2).sum()
        joint = np.array([[1 - agree[j] - agree[k] + yes, agree[k] - yes], [agree[j] - yes, yes]]).clip(0)
        return joint / np.maximum(joint.sum(1, keepdims=True), 1e-12)

    steps = [step(j, k) for j, k in zip(order, order[1:])]
    pairs = n * (n - 1) / 2
    best: list[dict[int, tuple[float, list]]] = [{0: (0.0, [])}] + [{} for _ in range(BITS)]
    for start in range(BITS):
        for used, (cost, cuts) in list(best[start].items()):  # a partition without a threshold: bits left out
            if cost < best[start + 1].get(used, (np.inf,))[0]:
                best[start + 1][used] = (cost, cuts)
        chance = np.zeros((2, distance + 1))  # by agreement in the last bit and number of differing bits
        chance[1, 0], chance[0, 1] = agree[order[start]], 1 - agree[order[start]]
        for end in range(start + 1, BITS + 1):
            if end > start + 1:
                move = steps[end - 2]
                moved = np.zeros_like(chance)
                moved[1] = chance[0] * move[0, 1] + chance[1] * move[1, 1]
                moved[0, 1:] = (chance[0] * move[0, 0] + chance[1] * move[1, 0])[:-1]
                chance = moved
            within = np.cumsum(chance.sum(0))
            for t in range(min(distance, end - start - 1) + 1):
                price = n * len(list(combinations(range(end - start), t))) + PAIR_COST * pairs * within[t]
                for used, (cost, cuts) in list(best[start].items()):
                    now = used + t + 1
                    if now <= distance + 1 and cost + price < best[end].get(now, (np.inf,))[0]:
                        best[end][now] = (cost + price, [*cuts, (order[start:end], t)])
    return best[BITS][distance + 1][1]


def signed(bits: list[int]) -> int:
    """A mask of these bits, as a bigint."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def probe_masks(parts: list[tuple[list[int], int]]) -> list[list[int]]:
    """The bits of each probe: a partition without t of its bits, for every choice of them."""
    return [[b for b in bits if b not in out] for bits, t in parts for out in combinations(bits, t)]


def finer(bits: list[int], order: list[int], distance: int = DISTANCE) -> list[list[int]]:
    """The probes that split a cell: its bits and one of distance + 1 parts of all others."""
    rest = [b for b in order if b not in set(bits)]
    at = [round(i * len(rest) / (distance + 1)) for i in range(distance + 2)]
    return [[*bits, *rest[s:e]] for s, e in zip(at, at[1:])]


def _forest(distance: int):
    """Of each cell (an array of fingerprints) one link from each to the smallest that it is connected with there."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(0)
            ends = cells.offsets.to_numpy()
            prints = cells.values.to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(ends)
            first = ends[:-1][size == 2]
            u, v = prints[first], prints[first + 1]
            near = np.bitwise_count(u ^ v) <= distance
            out = [(u[near], v[near])]
            for s, e in zip(ends[:-1][size > 2], ends[1:][size > 2]):
                x = np.sort(prints[s:e])
                i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x) <= distance, 1))
                root = np.arange(len(x))
                while len(i):
                    low, new = np.minimum(root[i], root[j]), root.copy()
                    np.minimum.at(new, i, low)
                    np.minimum.at(new, j, low)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                on = root != np.arange(len(x))
                out.append((x[on], x[root[on]]))
            a, b = (np.concatenate(c).view(np.int64) for c in zip(*out))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return link


def links(prints: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within the distance, and only such.

    Fingerprints are posted under their probes. Postings of a probe's value are a cell; cells are counted before anything
    is gathered. A cell of at most `cell` fingerprints is compared in one task and gives fewer links than it has members. A
    larger one is posted again under finer probes (its own bits and a third of the others), so that frequent values are
    split by further bits, however many share them; no cell is cut and no pair left out. A cell that leaves as many bits open
    as may differ is never large, so splitting ends.
    """
    cell = max(cell, 2**distance)
    n, both = bit_moments(prints)
    spark = prints.sparkSession
    if not n:
        return spark.createDataFrame([], "a bigint, b bigint")
    order = bit_order(n, both)
    masks = {signed(m): m for m in probe_masks(allocate(n, both, order, distance))}
    posted = prints.select("fp", F.explode(F.lit(list(masks))).alias("mask"))
    found = None
    while True:
        posted = posted.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        large = stored(posted.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("mask", "value"), "large-cells")
        again = [r.mask for r in large.select("mask").distinct().collect()]  # of the plan's probes
        small = posted
        if again:
            large = F.broadcast(large) if is_small(large) else large
            small = posted.join(large, ["mask", "value"], "left_anti")
        cells = small.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        now = cells.mapInArrow(_forest(distance), "a bigint, b bigint")
        found = now if found is None else found.unionByName(now)
        if not again:
            return stored(found, "links")
        split = {m: finer(masks[m], order, distance) for m in again}
        masks = {signed(x): x for xs in split.values() for x in xs}
        table = spark.createDataFrame([(m, signed(x)) for m, xs in split.items() for x in xs], "mask bigint, next bigint")
        posted = posted.join(large, ["mask", "value"], "left_semi").join(F.broadcast(table), "mask").select("fp", F.col("next").alias("mask")).distinct()
        posted = stored(posted, "finer-postings")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of each row.

    fp is the fingerprint (a bigint of its 64 bits); component_id the smallest id of all rows whose fingerprints are connected
    with this one by steps of at most `distance` bits. A null or empty text has the fingerprint 0 and is linked like any
    other; rows of one id with several texts are told apart by their fingerprints; a null id is never the smallest, so a
    component of rows without ids has none. Rows with equal fingerprints count once in all joins but the last.
    """
    made = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    classes = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), distance))
    known = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.join(known.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
