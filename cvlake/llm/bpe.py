"""Byte-level BPE by speculation: propose greedily, verify neighbouring tokens, merge exactly only what fails.

A sequence of tokens is the BPE result of a word if each token is the result for its own bytes and each two
neighbours are the result for their joint bytes. The second test is answered for all distinct pairs of a batch
at once, with numpy, by undoing merges on both sides of the border. Words that fail go through exact merging.

Texts are processed whole, row by row, with no shuffle. Null counts as empty: no tokens, digests of the empty string.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The splitting pattern of byte-level BPE vocabularies of this kind, for the regex library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the standard library, which is faster: right for texts without the signs in ODD.
FAST_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Numbers that are no decimals, and separators that only one of the two libraries takes for white space.
ODD = frozenset(c for c in map(chr, range(0x1C, 0x20000)) if unicodedata.category(c) in ("Nl", "No") or c <= "\x1f")


NO_LIMIT, NEVER = np.int64(1) << 40, 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free letter from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeVocabulary:
    """Merge tables of one tokenizer file. Tokens are numbered inside by age: bytes first, then merges in order."""

    def __init__(self, spec: str, cache_words: int = 150_000, cache_letters: int = 1_500_000):
        config = json.loads(spec)
        model, letters = config["model"], byte_letters()
        if model["type"] != "BPE" or (config["pre_tokenizer"] or {}).get("type") != "ByteLevel" or config["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer is supported")
        to_bytes = lambda s: bytes(letters[c] for c in s)
        ids = {to_bytes(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.content = [bytes([b]) for b in range(256)]
        self.left, self.right = list(range(256)), list(range(256))
        self.age = {c: i for i, c in enumerate(self.content)}
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in ((to_bytes(x), to_bytes(y)) for x, y in merges):
            if a + b in self.age:
                raise ValueError("a token has two merges")
            pair = self.age[a], self.age[b]
            self.merged[pair] = self.age[a + b] = len(self.content)
            self.content.append(a + b)
            self.left.append(pair[0])
            self.right.append(pair[1])
        self.vocab_id = [ids[c] for c in self.content]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.decoded = dict(zip(self.vocab_id, self.content)) | {i: s.encode() for s, i in self.special.items()}
        self.longest: dict[bytes, int] = {}  # longest token by its first three bytes
        for c in self.content:
            self.longest[c[:3]] = max(self.longest.get(c[:3], 2), len(c))
        self.id_text = [str(i) for i in self.vocab_id]
        self.piece = [self.decoded[i] for i in self.vocab_id]
        self.left_of, self.right_of = np.array(self.left, np.int64), np.array(self.right, np.int64)
        keys = np.array([(a << 32) | b for a, b in self.merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_token = keys[order], np.fromiter(self.merged.values(), np.int64)[order]
        self.sound = np.zeros(len(self.content), np.int8)  # 1: the BPE result of its own bytes; -1: not; 0: not known yet
        self.split, self.fast_split = regex.compile(SPLIT), re.compile(FAST_SPLIT)
        self.cache, self.older, self.cache_words, self.cache_letters, self.letters = {}, {}, cache_words, cache_letters, 0
        self.stats = {"words": 0, "failed": 0}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, age, longest = [], 0, len(word), self.age, self.longest
        while at < n:
            end = min(n, at + longest.get(word[at : at + 3], 2))
            while word[at:end] not in age:
                end -= 1
            out.append(age[word[at:end]])
            at = end
        return out

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or NO_LIMIT."""
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_token[at], NO_LIMIT)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: whether BPE leaves the border between them alone.

        Undo the youngest merge next to the border again and again. If the two pieces then at the border would have
        merged before the merge just undone, BPE would have crossed the border.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), NO_LIMIT)
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            crossed = self.joined(x, y) < lim
            ok[live[crossed]] = False
            # the younger side goes back one merge; a byte has none, so then it is the other side's turn
            x_back, y_back = self.right_of[x], self.left_of[y]
            first = x > y
            can_x, can_y = x_back != x, y_back != y
            undo_x = np.where(first, can_x, ~can_y & can_x)
            undo_y = ~undo_x & can_y
            # a left token merged at age x beats equal or later merges; a right token also yields to its own age
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, lim))
            a[live], b[live] = np.where(undo_x, x_back, x), np.where(undo_y, y_back, y)
            live = live[~crossed & (undo_x | undo_y)]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the oldest merge first, the leftmost of equals; in O(n log n) for long words."""
        n, get = len(word), self.merged.get
        if n <= 48:
            token = list(word)
            rank = [get(p, NEVER) for p in zip(token, token[1:])]
            while rank and (m := min(rank)) < NEVER:
                i = rank.index(m)
                token[i : i + 2] = [m]
                del rank[i]
                if i:
                    rank[i - 1] = get((token[i - 1], m), NEVER)
                if i < len(rank):
                    rank[i] = get((m, token[i + 1]), NEVER)
            return token
        token, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := self.merged.get((word[i], word[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if token[i] >= 0 else n
            if j >= n or self.merged.get((token[i], token[j])) != m:
                continue
            token[i], token[j], after[i] = m, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (k := self.merged.get((m, token[after[j]]))) is not None:
                    heapq.heappush(heap, (k, i))
            if before[i] >= 0 and (k := self.merged.get((token[before[i]], m))) is not None:
                heapq.heappush(heap, (k, before[i]))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self.propose(w) for w in words]
        flat = np.fromiter((t for p in proposed for t in p), np.int64)
        for t in np.unique(flat[self.sound[flat] == 0]):
            self.sound[t] = 1 if self.merge(self.content[t]) == [t] else -1
        owner = np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.zeros(len(words), bool)
        bad[owner[self.sound[flat] < 0]] = True
        if len(inside):
            pairs, back = np.unique((flat[inside] << 32) | flat[inside + 1], return_inverse=True)
            ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            bad[owner[inside[~ok[back]]]] = True
        for i in np.flatnonzero(bad):
            proposed[i] = self.merge(words[i])
        self.stats["words"] += len(words)
        self.stats["failed"] += int(bad.sum())
        return proposed

    def segments(self, text: str) -> Iterable[tuple[str, bool]]:
        """Parts of a text, and whether each is a special token."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [(text, False)]
        return [(p, p in self.special) for p in self.special_split.split(text) if p]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Words of each text; afterwards the cache holds (ids as text, bytes decoded from them) of every word."""
        if len(self.cache) > self.cache_words or self.letters > self.cache_letters:
            self.older, self.cache, self.letters = self.cache, {}, 0
        cache, all_words = self.cache, []
        for text in texts:
            words, split = [], self.fast_split if ODD.isdisjoint(text) else self.split
            for part, special in self.segments(text):
                words.extend(["\0" + part] if special else split.findall(part))
            all_words.append(words)
        new = set().union(*all_words).difference(cache)
        self.letters += sum(map(len, new))
        for w in new.intersection(self.older):
            cache[w] = self.older[w]
            new.discard(w)
        marked = [w for w in new if w[0] == "\0" and w[1:] in self.special]
        plain = list(new.difference(marked))
        id_text, piece = self.id_text, self.piece
        for w, tokens in zip(plain, self.encode_words([w.encode() for w in plain])):
            cache[w] = ",".join([id_text[t] for t in tokens]), b"".join([piece[t] for t in tokens])
        for w in marked:
            cache[w] = str(self.special[w[1:]]), self.decoded[self.special[w[1:]]]
        return all_words

    def encode(self, text: str) -> list[int]:
        (words,) = self.learn([text])
        return [int(i) for w in words for i in self.cache[w][0].split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.decoded[i] for i in ids]).decode("utf-8", "replace")


class _Lazy:
    """The vocabulary, built where it is used and gone with the task, so no worker keeps its tables and words."""

    def __init__(self, spec):
        self.spec, self.built = spec, None

    def __call__(self) -> BpeVocabulary:
        if self.built is None:
            self.built = BpeVocabulary(self.spec.value)
        return self.built


def read_spec(spark: SparkSession, tokenizer_path: str):
    """The tokenizer file, read by the driver and sent to executors once (a vocabulary file: a few MB, whatever the data)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def digests(spec, text: Column, batch: int = 64) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of a text column."""

    vocabulary = _Lazy(spec)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def encode_digests(texts: pa.Array) -> pa.Array:
        v, counts, ids_sha, text_sha = vocabulary(), [], [], []
        for at in range(0, len(texts), batch):
            part = [t or "" for t in texts.slice(at, batch).to_pylist()]
            for words in v.learn(part):
                known = [v.cache[w] for w in words]
                ids = ",".join([k[0] for k in known])
                decoded = b"".join([k[1] for k in known]).decode("utf-8", "replace")
                counts.append(ids.count(",") + 1 if known else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_digests(text)


def token_ids(spec, text: Column) -> Column:
    """array<int> of token ids of a text column."""

    vocabulary = _Lazy(spec)

    @F.arrow_udf("array<int>")
    def encode_ids(texts: pa.Array) -> pa.Array:
        v = vocabulary()
        return pa.array([v.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode_ids(text)


def decoded_text(spec, ids: Column) -> Column:
    """The text of an array<int> of token ids (null: empty); ids that the vocabulary lacks raise KeyError."""

    vocabulary = _Lazy(spec)

    @F.arrow_udf("string")
    def decode_ids(rows: pa.Array) -> pa.Array:
        v = vocabulary()
        return pa.array([v.decode(r or []) for r in rows.to_pylist()], pa.string())

    return decode_ids(ids)
