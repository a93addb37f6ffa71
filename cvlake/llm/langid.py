"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows, the maximum of each filter over the window
goes to a softmax. A text is cut into windows that cover all of it, and its languages' probabilities are the mean over
windows, weighted by their letters. For scoring, embedding and filters are multiplied out into tables by byte pair, so
that a filter's value at a place is one or two look-ups.

Only fitting is bounded: by rows_per_class labelled texts of each of the 1,000 most frequent languages, whatever their
length, and windows_per_text windows of each, drawn from all of it. Null texts and texts without a letter are "und" with
score 0; so is everything if no labelled text was there to learn from. Rows are scored one by one, with no shuffle, and
repeated rows alike; of equal probabilities the language that comes first by name is given.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvlake.llm.common import bounded_sample

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
ROWS_PER_CLASS, WINDOWS_PER_TEXT = 300, 4
PAD = 0x20


class LangModel(NamedTuple):
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # by width: (width, EMBED, FILTERS)
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def windows(data: bytes, length: int = WINDOW) -> np.ndarray:
    """All of data in rows of the given length, the last one padded."""
    rows = -(-len(data) // length)
    return np.frombuffer(data.ljust(rows * length, bytes([PAD])), np.uint8).reshape(rows, length)


def _forward(model: LangModel, x: np.ndarray):
    """Pooled values, and where each filter had its maximum."""
    e = model.embed[x]
    pooled, where = [], []
    for f in model.filters:
        width = len(f)
        stacked = np.concatenate([e[:, i : x.shape[1] - width + 1 + i] for i in range(width)], 2)
        r = stacked @ f.reshape(-1, f.shape[2])
        where.append(r.argmax(1))
        pooled.append(np.take_along_axis(r, where[-1][:, None], 1)[:, 0])
    return np.concatenate(pooled, 1) + model.shift, where


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def drawn_windows(text: str, most: int) -> np.ndarray:
    """The windows of a text, or most of them drawn from all of it."""
    data = text.encode("utf-8", "replace")
    w = windows(data)
    if len(w) > most:
        w = w[np.sort(np.random.default_rng(zlib.crc32(data)).choice(len(w), most, replace=False))]
    return w


def fit(texts: list[str], labels: list[str], **how) -> LangModel:
    """Train on labelled texts."""
    return fit_windows([drawn_windows(t, WINDOWS_PER_TEXT) for t in texts], labels, **how)


def fit_windows(xs: list[np.ndarray], labels: list[str], epochs: int = 4, rate: float = 0.01, batch: int = 64, seed: int = 3) -> LangModel:
    """Train on windows of labelled texts (a bounded sample), with gradients through the maxima only."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    ys = [languages.index(label) for x, label in zip(xs, labels) for _ in x]
    rand = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    model = LangModel(languages, rand(256, EMBED) * 0.5, [rand(w, EMBED, FILTERS) / np.sqrt(w * EMBED) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rand(FILTERS * len(WIDTHS), len(languages)) * 0.1, np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return model
    x, y = np.concatenate(xs), np.array(ys)
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / len(languages) / np.maximum(share, 1)).astype(np.float32)
    params = [model.embed, *model.filters, model.shift, model.out, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            step += 1
            take = order[at : at + batch]
            xb, yb = x[take], y[take]
            raw, where = _forward(model, xb)
            hidden = np.maximum(raw, 0)
            dz = _softmax(hidden @ model.out + model.bias)
            dz[np.arange(len(yb)), yb] -= 1
            dz *= weight[yb][:, None] / len(yb)
            dh = (dz @ model.out.T) * (raw > 0)
            g_embed, g_filters = np.zeros_like(model.embed), []
            for k, (f, spot) in enumerate(zip(model.filters, where)):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(f)
                for i in range(len(f)):
                    seen = np.take_along_axis(xb, spot + i, 1)  # byte under each filter's maximum
                    g[i] = np.einsum("bfe,bf->ef", model.embed[seen], d)
                    np.add.at(g_embed, seen, d[:, :, None] * f[i].T[None])
                g_filters.append(g)
            grads = [g_embed, *g_filters, dh.sum(0), hidden.T @ dz, dz.sum(0)]
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


class Scorer:
    """The network with embedding and filters multiplied out."""

    def __init__(self, model: LangModel, rows: int = 128):
        self.model, self.rows = model, rows
        by_byte = [[model.embed @ part for part in f] for f in model.filters]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.tables = []  # for each width: (offset of a pair, table) or (offset of a byte, table)
        for parts in by_byte:
            steps = [(i, True, pair(parts[i], parts[i + 1])) for i in range(0, len(parts) - 1, 2)]
            self.tables.append(steps + ([(len(parts) - 1, False, parts[-1])] if len(parts) % 2 else []))
        self.letter = np.zeros(256, np.float32)
        self.letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for windows (rows x WINDOW bytes)."""
        out = []
        for at in range(0, len(x), self.rows):
            b = x[at : at + self.rows]
            pairs = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            pooled = []
            for width, steps in zip(WIDTHS, self.tables):
                n = b.shape[1] - width + 1
                r = None
                for i, is_pair, table in steps:
                    part = np.take(table, (pairs if is_pair else b)[:, i : i + n], axis=0)
                    r = part if r is None else np.add(r, part, out=r)
                pooled.append(r.max(1))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.model.shift, 0)
            out.append(_softmax(hidden @ self.model.out + self.model.bias))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        alive = [i for i, t in enumerate(texts) if t and self.model.languages and any(map(str.isalpha, t))]
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for i in alive:
            group.append((i, windows(texts[i].encode("utf-8", "replace"))))
            size += len(group[-1][1])
            if size >= 4096 or i == alive[-1]:
                x = np.concatenate([w for _, w in group])
                weight = self.letter[x].sum(1) + 1e-6
                p = self.probabilities(x) * weight[:, None]
                ends = np.cumsum([len(w) for _, w in group])
                sums = np.add.reduceat(p, np.r_[0, ends[:-1]], axis=0)
                sums /= sums.sum(1, keepdims=True)
                for (j, _), s in zip(group, sums):
                    names[j], scores[j] = self.model.languages[int(s.argmax())], float(s.max())
                group, size = [], 0
        return names, scores


def fit_on(labelled: DataFrame, rows_per_class: int = ROWS_PER_CLASS, windows_per_text: int = WINDOWS_PER_TEXT) -> LangModel:
    """Fit on a bounded sample of (doc_id, text, lang); rows with a null in text or lang are left out."""

    @F.arrow_udf("binary")
    def drawn(texts: pa.Array) -> pa.Array:
        return pa.array([drawn_windows(t, windows_per_text).tobytes() for t in texts.to_pylist()], pa.binary())

    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") >= 1)).select("doc_id", "lang", "text")
    chosen = bounded_sample(usable.select("doc_id", "lang", drawn(F.col("text")).alias("w")), "doc_id", "lang", rows_per_class)
    rows = sorted(chosen.collect(), key=lambda r: (r.doc_id, r.lang, r.w))
    return fit_windows([np.frombuffer(r.w, np.uint8).reshape(-1, WINDOW) for r in rows], [r.lang for r in rows])


def language(text: Column, model: LangModel, spark) -> Column:
    """struct<lang_pred, score> of a text column."""
    shared = spark.sparkContext.broadcast(model)
    built: list[Scorer] = []

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Scorer(shared.value))
        names, scores = built[0].predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return identify(text)
