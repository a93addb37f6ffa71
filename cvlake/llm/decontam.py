"""Benchmark decontamination by a BM25 index of test items, walked by block-max WAND.

The index is over the benchmark; every passage of every training text is a query. Passages are windows of words that
overlap by half. Items are put in classes by length, and each class has windows of twice its largest length, so an item
lies whole in a window and the windows depend on the item alone. An item's impacts are divided by the score that it gives
itself, so one threshold serves all items, and every item that reaches it is retrieved, not the best few.

Items lie in blocks. A posting list has, besides its impacts, its largest one in each block that it occurs in, and the
largest of all. The threshold is fixed, so block-max WAND is done for many passages at once in arrays, without cursors that
skip along the lists: list maxima part a passage's terms into strong ones, of which an item must have one to reach the
threshold, and weak ones, which reach at most WEAK of it together. Only the strong lists' block maxima are walked, and all
of them, into one row of block bounds for each passage. The weak lists, the long ones of common words, are looked up in the
blocks that may still reach the threshold, without being walked, and what still may is scored. A retrieved item is
verified: its question and its answer must both overlap with the passage in word n-grams. The answer is the last sentence,
or of a single sentence the last third of its words.

Statistics are over all items, and postings and impacts are computed as tables. The index is cut into shards of about
SHARD_WORDS words (and never less than an item). A pass over the training texts shuffles nothing, cuts each text into words
once and uses PASS shards, which are broadcast; a benchmark of up to PASS * SHARD_WORDS words needs one pass. The driver
takes one shard at a time, in columns.

Null and empty texts have no passages; items without words cannot be found; items with a null id are reported with a null
id; repeated items and rows give repeated results. Of passages with equal scores the first one's overlaps are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvlake.llm.common import stored

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER = 0.5, 0.6, 0.5
BLOCK, GRAM, HALF = 4, 5, 64
SHARD_WORDS, PASS = 1_000_000, 4
EDGE = 1e-6  # bounds are compared with this much to spare, as sums in another order differ
WEAK = 0.3
SLOTS = 1_000_000  # of the arrays that are held at a time
LEAK = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"
POSTING = pa.schema([("no", pa.int64()), ("term", pa.string()), ("impact", pa.float64())])


class Postings(NamedTuple):
    """Lists of one length class: values of each term, by place; term t has the places from first[t] to first[t + 1]."""

    first: np.ndarray
    place: np.ndarray
    value: np.ndarray


class LengthClass(NamedTuple):
    half: int  # words; windows have twice as many
    items: np.ndarray  # places in the shard's list of items
    by_item: Postings
    by_block: Postings
    most: np.ndarray  # by term: the largest value of its list


class BenchmarkIndex(NamedTuple):
    ids: list
    texts: list[str]
    terms: dict[str, int]
    classes: list[LengthClass]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the answer is the last sentence, or of a single one the last third of its words."""
    sentences = [w for part in re.split(r"(?<=[.!?])\s+", text) if (w := words_of(part))]
    if len(sentences) < 2:
        words = words_of(text)
        cut = max(1, len(words) - len(words) // 3)
        return words[:cut], words[cut:] or words
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def overlap(part: list[str], words: list[str], n: int = GRAM) -> float:
    """Share of a part's distinct n-grams that a list of words has; a shorter part is looked up as a whole."""
    n = min(n, len(part))
    grams = lambda ws: set(zip(*(ws[i:] for i in range(n))))
    mine = grams(part)
    return len(mine & grams(words)) / len(mine)


def half_window(n_words: int, half: int = HALF) -> int:
    """The length class of an item: 64, 256, 1024, ... words."""
    while half < n_words:
        half *= 4
    return half


def _lists(term: np.ndarray, place: np.ndarray, value: np.ndarray, n_terms: int) -> Postings:
    order = np.lexsort((place, term))
    return Postings(np.searchsorted(term[order], np.arange(n_terms + 1)), place[order].astype(np.int32), value[order].astype(np.float64))


def build(items: list[tuple], impacts: pa.Table | list[tuple[int, str, float]]) -> BenchmarkIndex:
    """An index of (no, item_id, text, n_words) rows and of (no, term, impact) rows; impacts of an item sum to 1."""
    if isinstance(impacts, list):
        impacts = pa.table({c: [r[i] for r in impacts] for i, c in enumerate(POSTING.names)}, POSTING)
    items = sorted(items, key=lambda x: (x[3], x[0]))
    nos = np.array([x[0] for x in items], np.int64)
    by_no = np.argsort(nos)
    place = by_no[np.searchsorted(nos[by_no], impacts["no"].to_numpy())]
    coded = impacts["term"].combine_chunks().dictionary_encode()
    terms = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
    term = coded.indices.to_numpy().astype(np.int64)
    value = impacts["impact"].to_numpy()
    halves = np.array([half_window(x[3]) for x in items], np.int64)
    classes = []
    for half in sorted(set(halves.tolist())):
        own = np.flatnonzero(halves == half)
        mine = halves[place] == half
        t, p, v = term[mine], place[mine] - own[0], value[mine]  # items are sorted by length, so a class is one stretch
        n_blocks = -(-len(own) // BLOCK)
        key, at = np.unique(t * n_blocks + p // BLOCK, return_inverse=True)
        best = np.zeros(len(key))
        np.maximum.at(best, at, v)
        blocks = _lists(key // n_blocks, key % n_blocks, best, len(terms))
        most = np.zeros(len(terms))
        np.maximum.at(most, t, v)
        classes.append(LengthClass(half, own, _lists(t, p, v, len(terms)), blocks, most))
    return BenchmarkIndex([x[1] for x in items], [x[2] for x in items], terms, classes)


def _walk(lists: Postings, term: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, value) of all postings of terms."""
    n = lists.first[term + 1] - lists.first[term]
    at = np.repeat(lists.first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(owner, n), lists.place[at], lists.value[at]


def _portions(rows: np.ndarray, cost: np.ndarray) -> Iterator[np.ndarray]:
    """rows in stretches of a cost of about SLOTS each."""
    turn = np.cumsum(cost) // SLOTS
    return iter(np.split(rows, np.flatnonzero(turn[1:] != turn[:-1]) + 1)) if len(rows) else iter(())


def _look_up(lists: Postings, term: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The values of terms at places, 0 where a list lacks the place."""
    if not len(lists.place):
        return np.zeros(len(term))
    low, high = lists.first[term].copy(), lists.first[term + 1].copy()
    end = high.copy()
    while (busy := low < high).any():  # a binary search in each list
        mid = (low + high) >> 1
        less = busy & (lists.place[np.minimum(mid, len(lists.place) - 1)] < place)
        low, high = np.where(less, mid + 1, low), np.where(busy & ~less, mid, high)
    found = (low < end) & (lists.place[np.minimum(low, len(lists.place) - 1)] == place)
    return np.where(found, lists.value[np.minimum(low, len(lists.value) - 1)], 0.0)


def _cross(a: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i: a[i] with each of the count[i] numbers from first[i] on."""
    return np.repeat(a, count), np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def retrieve(lists: LengthClass, window: np.ndarray, term: np.ndarray, n_windows: int, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float]]:
    """(window, place of the item in the class, score) of every item that reaches the threshold.

    window, term: the distinct terms of each window, sorted by window.
    """
    live = lists.most[term] > 0
    window, term = window[live], term[live]
    order = np.lexsort((lists.most[term], window))  # of each window, the weakest lists first
    window, term = window[order], term[order]
    starts = np.searchsorted(window, np.arange(n_windows + 1))
    total = np.concatenate([[0.0], np.cumsum(lists.most[term])])
    upto = total[1:] - total[starts[window]]  # maxima of this list and all weaker ones
    must = upto >= threshold * WEAK
    weak = np.zeros(n_windows)
    np.maximum.at(weak, window[~must], upto[~must])
    n_weak = np.bincount(window[~must], minlength=n_windows)  # they come first in a window
    n_blocks = -(-len(lists.items) // BLOCK)
    live = np.flatnonzero(np.bincount(window[must], minlength=n_windows))
    walked = np.bincount(window[must], (lists.by_block.first[term + 1] - lists.by_block.first[term])[must], n_windows)
    for mine in _portions(live, walked[live] + n_blocks):
        count = starts[mine + 1] - starts[mine] - n_weak[mine]
        row, spot = _cross(np.arange(len(mine)), starts[mine] + n_weak[mine], count)
        row, block, value = _walk(lists.by_block, term[spot], row)
        strong = np.bincount(row * n_blocks + block, value, len(mine) * n_blocks)
        hit = np.flatnonzero(strong + np.repeat(weak[mine], n_blocks) >= threshold - EDGE)
        for part in _portions(hit, n_weak[mine][hit // n_blocks] + 1):
            row, block = part // n_blocks, part % n_blocks
            pair, spot = _cross(np.arange(len(part)), starts[mine[row]], n_weak[mine[row]])
            bound = strong[part] + np.bincount(pair, _look_up(lists.by_block, term[spot], block[pair]), len(part))
            stay = bound >= threshold - EDGE
            row, place = _cross(row[stay], block[stay] * BLOCK, np.minimum(BLOCK, len(lists.items) - block[stay] * BLOCK))
            pair, spot = _cross(np.arange(len(row)), starts[mine[row]], (starts[mine + 1] - starts[mine])[row])
            score = np.bincount(pair, _look_up(lists.by_item, term[spot], place[pair]), len(row))
            for i in np.flatnonzero(score >= threshold - 1e-12):
                yield int(mine[row[i]]), int(place[i]), float(score[i])


def find_leaks(texts: list[str | None], index: BenchmarkIndex, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> list[list[dict]]:
    """For each text, its leaked items, each with the scores of its best passage."""
    return find_in_words([words_of(t) for t in texts], index, threshold, question, answer)


def find_in_words(words: list[list[str]], index: BenchmarkIndex, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> list[list[dict]]:
    """find_leaks() of texts that are cut into words."""
    out: list[list[dict]] = [[] for _ in words]
    get = index.terms.get
    known = [np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)) for ws in words]
    best: dict[tuple[int, int], dict] = {}
    for lists in index.classes:
        half, term, window, owner = lists.half, [], [], []
        # windows of all texts in one sequence: window k of a text covers words k * half to (k + 2) * half
        for d, ids in enumerate(known):
            n = max(1, -(-len(ids) // half) - 1) if len(ids) else 0
            here = np.flatnonzero(ids >= 0)
            for back in (0, 1):
                w = here // half - back
                ok = (w >= 0) & (w < n)
                term.append(ids[here[ok]])
                window.append(w[ok] + len(owner))
            owner += [(d, k) for k in range(n)]
        keys = np.unique((np.concatenate(window) << 32) | np.concatenate(term)) if term else np.zeros(0, np.int64)
        for w, place, score in retrieve(lists, keys >> 32, keys & 0xFFFFFFFF, len(owner), threshold):
            d, at = owner[w]
            item, passage = int(lists.items[place]), words[d][at * half : (at + 2) * half]
            old = best.get((d, item))
            if old is not None and old["score"] >= score:
                continue
            parts = split_item(index.texts[item])
            q, a = (overlap(p, passage) for p in parts)
            if q >= question and a >= answer:
                best[d, item] = {"item_id": index.ids[item], "score": score, "question": q, "answer": a}
    for (d, _), row in sorted(best.items()):
        out[d].append(row)
    return out


def leaks(text: Column, shards: list[Broadcast], batch: int = 64) -> Column:
    """array<struct<item_id, score, question, answer>> of a text column, for some shards of the index."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    @F.arrow_udf(LEAK)
    def search(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), batch):
            words = [words_of(t) for t in texts.slice(at, batch).to_pylist()]
            by_shard = [find_in_words(words, s.value) for s in shards]
            found += [sum(own, []) for own in zip(*by_shard)]
        return pa.array(found, kind)

    return search(text)


def item_table(benchmark: DataFrame) -> DataFrame:
    """(no, item_id, text, words) of the items with words, written once, so that no names a row for good."""

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array([words_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").withColumn("words", tokens("text")).where(F.size("words") > 0)
    return stored(rows.withColumn("no", F.monotonically_increasing_id()), "benchmark-items")


def impact_table(items: DataFrame) -> DataFrame:
    """(no, term, impact): the BM25 weight of each term of each item, divided by the sum of the item's."""
    n, average = items.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    tf = items.select("no", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("no", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(average or 1))))
    rows = stored(tf.join(df, "term").select("no", "term", weight.alias("weight")), "benchmark-weights")
    return rows.join(rows.groupBy("no").agg(F.sum("weight").alias("whole")), "no").select("no", "term", (F.col("weight") / F.col("whole")).alias("impact"))


def indexes(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[BenchmarkIndex]:
    """The shards of the index of benchmark (item_id, text), one after the other; each is a bounded part on the driver."""
    items = item_table(benchmark)
    impacts = stored(impact_table(items), "benchmark-impacts")
    words = items.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    own = F.pmod(F.xxhash64("no"), F.lit(shards))
    for s in range(shards):
        part = items.where(own == s).select("no", "item_id", "text", F.size("words").alias("n")).toArrow()
        yield build(list(zip(*(c.to_pylist() for c in part.columns))), impacts.where(own == s).select(*POSTING.names).toArrow())


def passes(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[list[Broadcast]]:
    """The shards, broadcast, by the passes that use them."""
    shards = (benchmark.sparkSession.sparkContext.broadcast(i) for i in indexes(benchmark, shard_words))
    while own := list(islice(shards, PASS)):
        yield own


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap) of every leak, each item with its best passage."""
    out: list[DataFrame] = []
    for shards in passes(benchmark, shard_words):
        hit = docs.select(F.col(key).alias(key), F.explode(leaks(F.col("text"), shards)).alias("l"))
        # the last pass is left to the caller
        out = [*out[:-1], *(stored(p, "leaks") for p in out[-1:])]
        out.append(hit.select(key, "l.item_id", "l.score", F.col("l.question").alias("question_overlap"), F.col("l.answer").alias("answer_overlap")))
    return reduce(DataFrame.unionByName, out)


def without_leaks(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs whose text has no leak.

    The last pass filters. Of an earlier one only the digests of leaking texts are written, as the text alone decides.
    """
    out, leaking = docs, None
    for shards in passes(benchmark, shard_words):
        if leaking is not None:
            gone = stored(docs.where(leaking > 0).select(F.sha2("text", 256).alias("leaking text")).distinct(), "leaking")
            out = out.join(gone, F.sha2(docs["text"], 256) == gone["leaking text"], "left_anti")
        leaking = F.size(leaks(F.col("text"), shards))
    return out.where(leaking == 0)
