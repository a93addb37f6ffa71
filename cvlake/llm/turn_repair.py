"""Cheapest repair of damaged conversations, by cost layers of bitsets of grammar states.

A conversation must give role initials `(s?(ua)+)?`. States: start, after the system turn, after a user turn, after an
assistant turn. For each place between turns there are layers of increasing cost: layer k holds the states from which the end
can be reached at a cost of at most k. Sixteen layers of four states are one 64-bit word, moved over a turn by shifts and
masks; since no two states of a place are more than ten apart, a word and the cost of its first layer say all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvlake.llm.common import stored

KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
EACH, FULL = 0x1111111111111111, 0xFFFFFFFFFFFFFFFF
BLANKS = " \t\n\x0b\x0c\r"
#: The state after a turn that is kept, and the only one that an inserted or renamed turn can lead to.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
FORCED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
EDGE = "conv_id bigint, pid int, n bigint, turn bigint, role string, text string, dropped boolean"
#: Rows, and letters of their texts, that a task hands on at a time.
ROWS, LETTERS = 4_096, 1 << 22


def _before(word: int, initial: str) -> int:
    """States from which a turn with that initial leads into the states of a word, in every layer."""
    if initial == "u":
        u = word & USER * EACH
        return u >> 2 | u >> 1 | u << 1
    if initial == "a":
        return (word & ASSISTANT * EACH) >> 1
    return (word & SYSTEM * EACH) >> 1 if initial == "s" else 0


def _inserted(word: int) -> int:
    """With turns inserted: two in a row reach everything."""
    for _ in range(2):
        word |= (_before(word, "u") | _before(word, "a")) << 4 * INSERT & FULL
    return word


#: The end: the empty conversation and one that ends with an assistant's turn are right.
ACCEPTED = _inserted((START | ASSISTANT) * EACH)


def back(word: int, base: int, initial: str, must_go: bool, unended: bool) -> tuple[int, int]:
    """The layers before a turn, from those after it."""
    new = word << 4 * DELETE
    if not must_go:
        more = UNENDED if unended else 0
        new |= _before(word, initial) << 4 * (KEEP + more) | (_before(word, "u") | _before(word, "a")) << 4 * (REROLE + more)
    new = _inserted(new & FULL)
    empty = ((new & -new).bit_length() - 1) // 4
    return (new >> 4 * empty | FULL << 64 - 4 * empty & FULL if empty else new), base + empty


def _can(place: tuple[int, int], state: int, cost: int) -> bool:
    word, base = place
    return cost >= base and (cost - base > 15 or bool(word >> 4 * (cost - base) & state))


class Repair:
    """One conversation, forward, a piece of its turns at a time."""

    def __init__(self):
        self.state, self.left, self.cost, self.audit, self.sha, self.lines = START, None, 0, [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.last_turn = self.last_initial = None

    def faults(self, turns: list[tuple], seen: list[bool]) -> list[tuple[str, bool, bool]]:
        """(initial, must go, unended) of each turn (turn, role, text), while faults are counted."""
        out = []
        for (turn, role, text), again in zip(turns, seen):
            said = text.rstrip(BLANKS)
            unended = bool(said) and not again and said[-1] not in ".!?"
            self.blank += not said
            self.duplicate += bool(said) and again
            self.truncated += unended
            initial = role[:1]
            self.illegal += self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au")
            self.last_initial = initial
            if turn is not None:
                self.distinct += turn != self.last_turn
                self.last_turn = self.most = turn
                self.least = turn if self.least is None else self.least
            out.append((initial, not said or again, unended))
        return out

    def piece(self, turns: list[tuple], seen: list[bool], end: tuple[int, int] = (ACCEPTED, 0), last: bool = True) -> None:
        """Add turns, given the layers after them."""
        faults, places = self.faults(turns, seen), [end]
        for f in reversed(faults):
            places.append(back(*places[-1], *f))
        places.reverse()
        if self.left is None:
            self.left = self.cost = next(c for c in range(places[0][1], places[0][1] + 16) if _can(places[0], START, c))
        i = 0
        while i < len(turns) or (last and self.left):
            initial, must_go, unended = faults[i] if i < len(turns) else ("", True, False)
            more, kept, forced = UNENDED if unended else 0, KEPT.get((initial, self.state)), FORCED[self.state]
            # the bits say which edits are on a cheapest way; of those, the first letter
            if i < len(turns) and _can(places[i + 1], self.state, self.left - DELETE):
                self.edit("D", DELETE, self.state)
                i += 1
            elif _can(places[i], forced, self.left - INSERT):
                self.edit("I", INSERT, forced, ROLE[forced], "")
            elif not must_go and kept and _can(places[i + 1], kept, self.left - KEEP - more):
                self.edit("K", KEEP + more, kept, *turns[i][1:])
                i += 1
            else:
                self.edit("R", REROLE + more, forced, ROLE[forced], turns[i][2])
                i += 1

    def edit(self, letter: str, cost: int, state: int, role: str | None = None, text: str = "") -> None:
        self.audit.append(letter)
        self.left -= cost
        self.state = state
        if role is not None:
            self.sha.update(("\n" * bool(self.lines) + f"{role}:{text}").encode())
            self.lines += 1

    def result(self, conv_id: int | None) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repaired(turns: list[tuple]) -> Repair:
    """A whole conversation of (turn, role, text) in order."""
    seen, again = set(), []
    for _, role, text in turns:
        again.append((role, text) in seen)
        seen.add((role, text))
    out = Repair()
    out.piece(turns, again)
    return out


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [ARROW[c.split()[1]] for c in schema.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], _names(schema))


BOTH = f"{RESULT}, {EDGE.removeprefix('conv_id bigint, ')}"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted part: those inside it are repaired; turns of the first and last, which may go on in other parts, are handed on."""
    from pyspark import TaskContext

    pid, n_result, n_edge = TaskContext.get().partitionId(), len(_names(RESULT)), len(_names(EDGE))
    out, letters, n, first = [], 0, 0, True

    def close(conv_id: int | None, rows: list[tuple], edge: bool) -> None:
        nonlocal letters, n
        if not edge:
            out.append((*repaired([r[:3] for r in rows if not r[3]]).result(conv_id), *[None] * (n_edge - 1)))
            return
        for r in rows:
            out.append((conv_id, *[None] * (n_result - 1), pid, n, *r))
            letters, n = letters + len(r[2]), n + 1

    current, rows = None, []
    for b in batches:
        for conv_id, *row in zip(*(c.to_pylist() for c in b.columns)):
            if rows and conv_id != current:
                close(current, rows, first)
                first, rows = False, []
            elif first and len(rows) >= ROWS:  # a part of one conversation only is never held
                close(current, rows, True)
                rows = []
            current = conv_id
            rows.append(tuple(row))
            if len(out) >= ROWS or letters >= LETTERS:
                yield _batch(out, BOTH)
                out, letters = [], 0
    if rows:
        close(current, rows, True)
    yield _batch(out, BOTH)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Layers at the end of each part of a conversation; turns come last first, and only the layers are held."""
    out, key, pid, place = [], None, None, None
    for b in batches:
        for k, p, initial, must_go, unended, dropped in zip(*(c.to_pylist() for c in b.columns)):
            if k != key:
                key, pid, place = k, None, (ACCEPTED, 0)
            if p != pid:
                pid = p
                out.append((k, p, place[0] - (1 << 64) * (place[0] >> 63), place[1]))
            if not dropped:
                place = back(*place, initial, must_go, unended)
        yield _batch(out, "key string, pid int, word bigint, base bigint")
        out = []


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs conversations whose turns come in order with the layers after their part; one part is held at a time."""
    out, at, rows, repair = [], None, [], None

    def step(last: bool) -> None:
        key, conv_id, _, word, base = at
        keep = [r for r in rows if not r[3]]
        repair.piece([r[:3] for r in keep], [r[4] for r in keep], (word % (1 << 64), base), last)
        if last:
            out.append(repair.result(conv_id))

    for b in batches:
        for key, conv_id, pid, word, base, *row in zip(*(c.to_pylist() for c in b.columns)):
            if at and (key, pid) != (at[0], at[2]):
                step(key != at[0])
                rows = []
            if at is None or key != at[0]:
                repair = Repair()
            at = (key, conv_id, pid, word, base)
            rows.append(tuple(row))
        yield _batch(out, RESULT)
        out = []
    if at:
        step(True)
    yield _batch(out, RESULT)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): faults put in by a checksum of conversation and turn; nulls are one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(some("conv_id"), F.lit(":"), some("turn")), "UTF-8")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = turns.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), kind.alias("kind"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), twice.alias("copy")).drop("copy")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The RESULT columns of each conversation of (conv_id, turn, role, text, dropped).

    Turns are taken by turn (null first), then role, then text; those marked as dropped count for nothing but that their
    conversation is there. A null conv_id is a conversation of its own. A conversation without turns has zeros, an empty audit
    and the hash of nothing.

    One shuffle by range puts a conversation's turns side by side. What lies inside a part is repaired there. The first and
    last conversation of each part may go on in others, so their turns are joined again: layers come from the end (nothing
    but a word is held), repairs from the start (one part of a conversation is held). A conversation of any length is thus
    repaired in bounded memory; its digest, which is of one long string, is made in one task.
    """
    rows = turns.select("conv_id", "turn", "role", "text", "dropped")
    # a row's neighbours by text are in its part: longer texts refine the order of their beginnings
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    made = stored(rows.mapInArrow(_whole, BOTH), "turns")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")
    edges = made.where(F.col("pid").isNotNull()).select(key, *_names(EDGE), F.sha2("text", 256).alias("digest"))
    spot = F.struct("pid", "n")
    first = edges.where(~F.col("dropped")).groupBy("key", "role", "digest").agg(F.min(spot).alias("spot"))
    edges = edges.join(first, ["key", "role", "digest"], "left").withColumn("seen", F.coalesce(spot > F.col("spot"), F.lit(False)))
    said = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    faults = (F.left("role", F.lit(1)).alias("initial"), ((said == "") | F.col("seen")).alias("must_go"), ((said != "") & ~F.col("seen") & ~said.isin(".", "!", "?")).alias("unended"))
    ends = edges.select("key", "pid", *faults, "dropped", "n").repartition("key").sortWithinPartitions("key", F.desc("pid"), F.desc("n")).drop("n")
    ends = stored(ends.mapInArrow(_ends, "key string, pid int, word bigint, base bigint"), "layers")
    parts = edges.join(ends, ["key", "pid"]).repartition("key").sortWithinPartitions("key", "pid", "n")
    spanning = parts.select("key", "conv_id", "pid", "word", "base", "turn", "role", "text", "dropped", "seen").mapInArrow(_forward, RESULT)
    return made.where(F.col("pid").isNull()).select(*_names(RESULT)).unionByName(spanning)
