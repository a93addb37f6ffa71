"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at both ends) and itself; each is hashed to a row of an
embedding table. A text is the average over all its words' subwords, and a linear softmax scores the average. A
misspelling the training never saw still shares most n-grams with the word meant. As the model is linear behind the
average, a word's part of the score is two numbers, which workers keep for words they have met.

The softmax is trained on the average of whole texts, where a word counts 1 + ln of its number, so that one word said a
thousand times is no text. For the score, that average is joined by one over windows of up to WINDOW words: a text of n
windows has the mean of its sqrt(n) highest, so a few toxic stretches are not lost in a long text. The weights of the two
are fitted to labels that the training did not see.

A text is cut at white space; a run of over RUN letters, as in languages without blanks, is cut on into pieces of PIECE letters.

Only the number of rows to fit on is bounded: by rows_per_class labels, and of these by as many as have letters_per_class
letters together, chosen by hash whatever the length of their texts (see fit_on). Their texts are learned from whole, as every
text is scored whole; a word of less than LEAST_TEXTS of them is no feature of its own (other words have its n-grams), unless
a text has no other words. The fit doesn't depend on the order of its rows. Null and empty texts, and texts without a letter or
digit, score the model's prior. Rows are scored one by one with no shuffle of texts; repeated rows have the same score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvlake.llm.common import bounded_sample

ROWS_PER_CLASS, LETTERS_PER_CLASS, WINDOW, RUN, PIECE = 1200, 4_000_000, 96, 48, 16
LEAST_TEXTS, BUCKETS, DIM, ALPHA, FOLDS = 2, 1 << 17, 8, 0.5, 3
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class ToxicityModel(NamedTuple):
    weight: np.ndarray  # of each bucket: its embedding times the difference of the softmax's two rows
    scale: np.ndarray  # of the average of the text, and of that of its windows
    bias: float
    prior: float  # score of a text without words


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """For lower-cased words: places of words, and buckets of their character 3- to 5-grams and of the words themselves.

    Bare punctuation has none.
    """
    marked = [f"<{core}>" if (core := EDGES.sub("", w)) else "" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    owner, left = np.repeat(np.arange(len(words)), length), np.repeat(np.cumsum(length), length) - np.arange(len(codes))
    named = np.flatnonzero(length > 0)
    owners = [named]
    hashes = [np.fromiter((zlib.crc32(marked[i].encode("utf-8", "surrogatepass")) for i in named), np.uint64, len(named))]
    for n in (3, 4, 5):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h + codes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        owners.append(owner[at])
        hashes.append(h)
    return np.concatenate(owners).astype(np.int32), (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int32)


def window_edges(n: int) -> np.ndarray:
    """Where the windows of n words begin, and the end: windows of about the same size, of WINDOW words at most."""
    parts = max(1, -(-n // WINDOW))
    return np.arange(parts + 1) * n // parts


def pieces(text: str) -> list[str]:
    """The words of a text in lower case, with long runs cut."""
    out: list[str] = []
    for w in text.lower().split():
        out += [w] if len(w) <= RUN else [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
    return out


class Sample(NamedTuple):
    """What the fit takes from a text."""

    words: list[str]
    weights: np.ndarray
    windows: list[list[str]]


def sample(text: str) -> Sample:
    """The different words of a text with 1 + ln of their number, and its windows."""
    words = pieces(text)
    counts, edges = Counter(words), window_edges(len(words)).tolist()
    weights = 1.0 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    return Sample(list(counts), weights, [words[a:b] for a, b in zip(edges, edges[1:]) if b > a])


def pooled(z: np.ndarray) -> float:
    """The mean of the sqrt(n) highest of n windows' scores."""
    k = math.isqrt(len(z) - 1) + 1
    return float(np.partition(z, len(z) - k)[len(z) - k :].mean())


class _Sparse:
    """A sparse matrix in rows, with what its transposed product needs; numpy only. Without values all are 1."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray | None, shape: tuple[int, int]):
        self.shape = shape
        self.by_row = self._order(rows, cols, values)
        self.by_col = self._order(cols, rows, values)

    @staticmethod
    def _order(key, other, values):
        at = np.argsort(key, kind="stable")
        key = key[at]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        return key[starts] if len(key) else key, np.r_[starts, len(key)], other[at], None if values is None else values[at].astype(np.float32)[:, None]

    def _times(self, part, n: int, x: np.ndarray, most: int = 500_000) -> np.ndarray:
        out = np.zeros((n, x.shape[1]), np.float32)
        key, edges, other, values = part
        first = 0
        while first < len(key):  # in stretches of about most entries
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + most, "right")) - 1)
            a, b = edges[first], edges[last]
            rows = x[other[a:b]]
            if values is not None:
                rows *= values[a:b]
            out[key[first:last]] = np.add.reduceat(rows, edges[first:last] - a, axis=0)
            first = last
        return out

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self._times(self.by_row, self.shape[0], x)

    def t_dot(self, x: np.ndarray) -> np.ndarray:
        return self._times(self.by_col, self.shape[1], x)


def fit(texts: list[str], labels: list[int], base_rate: float | None = None, rounds: int = 50, rate: float = 0.1, seed: int = 7, folds: int = FOLDS) -> ToxicityModel:
    """Train on labelled texts (a bounded sample), in any order. base_rate: share of label 1 among all labelled rows.

    Rows are put in an order of their own. Each of some folds, by a checksum of the text, is scored by a model of the others;
    scales and bias are fitted to these scores of all rows. The model itself is then trained on all.
    """
    rows = sorted(zip(texts, labels), key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r))
    y = np.array([r[1] for r in rows], np.float32)
    if base_rate is None:
        base_rate = float(y.mean()) if len(y) else 0.5
    base_rate = min(max(base_rate, 1e-3), 1 - 1e-3)
    samples = [sample(t) for t, _ in rows]
    training = _Training(samples, y, rounds, rate, seed) if 0 < y.sum() < len(y) else None
    if training is None or not len(training.used):
        prior = base_rate if training or not len(y) else float(y[0])
        return ToxicityModel(np.zeros(BUCKETS, np.float32), np.zeros(2), float(np.log(base_rate / (1 - base_rate))), min(max(prior, 1e-3), 1 - 1e-3))
    fold = np.array([zlib.crc32(r[0].encode("utf-8", "surrogatepass"), 1) % folds for r in rows])
    z = np.full((len(rows), 2), np.nan)
    for f in range(folds):
        out = fold == f
        if len(set(y[out])) == 2 and len(set(y[~out])) == 2:
            z[out] = training.averages(training.line(~out), out)
    line = training.line(np.ones(len(rows), bool))
    if np.isnan(z).all():  # too few rows for folds
        z = training.averages(line, np.ones(len(rows), bool))
    on = ~np.isnan(z).any(1)
    scale, shift = _calibrate(z[on], y[on], base_rate)
    return ToxicityModel(line, scale, shift, base_rate)


class _Training:
    """Labelled samples as sparse matrices, to train on any part of them."""

    def __init__(self, texts: list[Sample], y: np.ndarray, rounds: int, rate: float, seed: int):
        self.texts, self.y, self.rounds, self.rate, self.seed = texts, y, rounds, rate, seed
        vocabulary: dict[str, int] = {}
        word = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t.words), np.int32, len(t.words)) for t in texts]
        count = np.concatenate([np.asarray(t.weights, np.float32) for t in texts])
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in word])
        word = np.concatenate(word)
        often = np.bincount(word, minlength=len(vocabulary)) >= LEAST_TEXTS
        often[word[np.isin(doc, doc[often[word]], invert=True)]] = True
        owner, bucket = subwords([w if o else "" for w, o in zip(vocabulary, often)])
        lengths = np.bincount(owner, minlength=len(vocabulary)).astype(np.float32)
        total = np.maximum(np.bincount(doc, count * lengths[word], len(texts)), 1)
        self.used, flat = np.unique(bucket, return_inverse=True)
        del bucket
        self.of_docs = _Sparse(doc, word, count / total[doc], (len(texts), len(vocabulary)))
        self.of_words = _Sparse(owner, flat.astype(np.int32), None, (len(vocabulary), len(self.used)))
        # a subword's step is the larger the less of the average it makes up, else "the" would outweigh all rare words
        usage = self.of_words.t_dot(self.of_docs.t_dot(np.full((len(texts), 1), 1 / len(texts), np.float32)))
        self.pace = ((usage + usage.mean()) / max(usage.mean(), 1e-12)) ** -ALPHA

    def line(self, on: np.ndarray) -> np.ndarray:
        """The weight of each bucket, by gradient steps on the rows of on."""
        y, rng = self.y, np.random.default_rng(self.seed)
        weight = np.where(y == 1, 0.5 / max(1, (y[on] == 1).sum()), 0.5 / max(1, (y[on] == 0).sum())) * on
        table = rng.normal(0, 0.01, (len(self.used), DIM)).astype(np.float32)
        out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        bias = np.zeros((1, 2), np.float32)
        moments = [np.zeros_like(p) for p in (table, out, bias)]
        target = np.stack([1 - y, y], 1)
        for step in range(1, self.rounds + 1):
            hidden = self.of_docs.dot(self.of_words.dot(table))
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = ((p - target) * weight[:, None]).astype(np.float32)
            grads = self.of_words.t_dot(self.of_docs.t_dot(dz @ out.T)), hidden.T @ dz, dz.sum(0, keepdims=True)
            for param, grad, m, r in zip((table, out, bias), grads, moments, (self.rate * self.pace, self.rate, self.rate)):
                m += 0.2 * (grad - m)
                param -= r * m / (float(np.sqrt(np.square(m).mean())) + 1e-12) * (1 - step / (self.rounds + 1))
        line = np.zeros(BUCKETS, np.float32)
        line[self.used] = table @ (out[:, 1] - out[:, 0])
        return line

    def averages(self, line: np.ndarray, on: np.ndarray) -> np.ndarray:
        """The averages over the text and over its windows, of the rows of on; those of a text without subwords are not a number."""
        scorer, z = Scorer(ToxicityModel(line, np.zeros(2), 0.0, 0.5)), []
        for i in np.flatnonzero(on):
            text = self.texts[i]
            if scorer.letters > scorer.most_letters:
                scorer.clear()
            scorer.learn([w for w in text.words if w not in scorer.spot])
            whole, size = scorer.sums(text.words, text.weights)
            means = [a / n for a, n in (scorer.sums(w, np.ones(len(w))) for w in text.windows) if n]
            z.append((whole / size, pooled(np.array(means))) if means else (np.nan, np.nan))
        return np.array(z).reshape(-1, 2)


def _calibrate(z: np.ndarray, y: np.ndarray, base_rate: float) -> tuple[np.ndarray, float]:
    """Scales and bias of a logistic of the columns of z, with classes weighted as among all labelled rows."""
    w = np.where(y == 1, base_rate / max(1, (y == 1).sum()), (1 - base_rate) / max(1, (y == 0).sum()))
    spread = np.maximum(z.std(0), 1e-6)
    x = np.column_stack([(z - z.mean(0)) / spread, np.ones(len(z))])
    beta, ridge = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
        beta += np.linalg.solve(hess, x.T @ (w * (y - p)) - 1e-3 * np.r_[beta[:-1], 0])
    # the score to part these rows at, which is to be 0.5: the best by precision and recall, precision (clean texts stay) counting double
    line = x @ beta
    order = np.argsort(-line, kind="stable")
    hit, miss = np.cumsum((w * (y == 1))[order]), np.cumsum((w * (y == 0))[order])
    f = 1.25 * hit / (hit + miss + 0.25 * (w * (y == 1)).sum())
    f[:-1][line[order][:-1] == line[order][1:]] = 0  # not between equal scores
    k = int(f.argmax())
    cut = (line[order][k] + line[order][min(k + 1, len(line) - 1)]) / 2
    scale = beta[:-1] / spread
    return scale, float(beta[-1] - scale @ z.mean(0) - cut)


class Scorer:
    """Scores texts by a model, with the parts of words met so far, of about most_letters letters."""

    def __init__(self, model: ToxicityModel, most_letters: int = 2_000_000):
        self.model, self.most_letters = model, most_letters
        self.clear()

    def clear(self) -> None:
        self.spot: dict[str, int] = {}
        self.part, self.size, self.letters = np.zeros(1024), np.zeros(1024), 0

    def learn(self, words: list[str]) -> None:
        """Of each new word its part of the sum and its number of subwords."""
        owner, bucket = subwords(words, len(self.model.weight))
        at = len(self.spot)
        while at + len(words) > len(self.part):
            self.part, self.size = np.resize(self.part, 2 * len(self.part)), np.resize(self.size, 2 * len(self.size))
        self.part[at : at + len(words)] = np.bincount(owner, self.model.weight[bucket], len(words))
        self.size[at : at + len(words)] = np.bincount(owner, minlength=len(words))
        self.spot.update(zip(words, range(at, at + len(words))))
        self.letters += sum(map(len, words))

    def sums(self, words: list[str], weights: np.ndarray) -> tuple[float, float]:
        at = np.fromiter(map(self.spot.__getitem__, words), np.int64, len(words))
        return float(weights @ self.part[at]), float(weights @ self.size[at])

    def scores(self, texts: list[str]) -> list[float]:
        if self.letters > self.most_letters:
            self.clear()
        lists = [pieces(t) for t in texts]
        self.learn(list(set().union(*lists).difference(self.spot)))
        out, m = [], self.model
        for words in lists:
            at = np.fromiter(map(self.spot.__getitem__, words), np.int64, len(words))
            part, size = self.part[at], self.size[at]
            if not size.any():
                out.append(m.prior)
                continue
            starts = window_edges(len(words))[:-1]
            sums, sizes = np.add.reduceat(part, starts), np.add.reduceat(size, starts)
            once, count = np.unique(at, return_counts=True)
            weight = 1.0 + np.log(count)
            whole = weight @ self.part[once] / (weight @ self.size[once])
            z = m.bias + m.scale[0] * whole + m.scale[1] * pooled(sums[sizes > 0] / sizes[sizes > 0])
            out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
        return out


def fit_on(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, letters_per_class: int = LETTERS_PER_CLASS) -> ToxicityModel:
    """Fit on documents (doc_id, text) of a bounded sample of labels (doc_id, toxic); other labels than 0 and 1 are left out.

    The sample is taken from the labels alone; at most 4 * rows_per_class ids are then broadcast to find their texts. Of these,
    in an order by hash, each label has as many as letters_per_class letters hold (the last may go over), and of an id
    with many texts those that come first. Lengths come to the driver first, then the texts of the rows chosen, as Arrow.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    chosen = bounded_sample(usable, "doc_id", "toxic", rows_per_class)
    texts = docs.where(F.length("text") >= 1).select("doc_id", "text", F.xxhash64("text").alias("spot")).join(F.broadcast(chosen), "doc_id")
    spots = texts.select("doc_id", "toxic", "spot", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "spot", "toxic").limit(8 * rows_per_class).toArrow()
    taken, letters = [], {0: 0, 1: 0}
    for r in spots.to_pylist():
        if letters[r["toxic"]] < letters_per_class:
            letters[r["toxic"]] += r["n"]
            taken.append((r["doc_id"], r["spot"], r["toxic"]))
    few = docs.sparkSession.createDataFrame(sorted(set(taken)), "doc_id bigint, spot bigint, toxic int") if taken else None
    rows = texts.join(F.broadcast(few), ["doc_id", "spot", "toxic"]).select("text", "toxic").toArrow().to_pylist() if taken else []
    share = usable.agg(F.avg("toxic")).first()[0]
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], share)


def toxic_score(text: Column, model: ToxicityModel, spark, batch: int = 64) -> Column:
    """Score (0 to 1) of a text column."""
    shared = spark.sparkContext.broadcast(model)
    built: list[Scorer] = []

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Scorer(shared.value))
        out: list[float] = []
        for at in range(0, len(texts), batch):
            out += built[0].scores([t or "" for t in texts.slice(at, batch).to_pylist()])
        return pa.array(out, pa.float64())

    return toxicity(text)
