"""The prefix trie of conversations: what beginnings they share, and how many tokens a cache of beginnings would save.

Turns are dictionary-encoded; conversations become sequences of ids. Equal ones count as one class. A distributed radix pass,
most significant turn first, splits buckets of classes by their next id and emits a node for each large bucket; buckets of few
turns are finished in a task by multikey quicksort, whose recursion emits their nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvlake.llm.common import is_small, stored

#: Turns of a sequence that a row holds, turns of a bucket that a task finishes, and ids that are hashed at a time.
SEGMENT, LOCAL, CHUNK = 256, 4_096, 65_536
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256().hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
TOP = f"{NODE}, path array<bigint>"


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation in a sorted part, from 1."""
    from pyspark import TaskContext

    pid, last, count = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv_id").to_numpy()
        starts = _runs([conv])
        k = np.arange(1, len(conv) + 1) - np.repeat(starts, np.diff([*starts, len(conv)]))
        if conv[0] == last:
            k[: starts[1] if len(starts) > 1 else len(k)] += count
        last, count = conv[-1], int(k[-1])
        yield pa.record_batch([b.column("conv_id"), pa.array(np.full(len(k), pid, np.int32)), pa.array(k), b.column("digest"), b.column("words")], ["conv_id", "pid", "k", "digest", "words"])


def ordered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, words) of turns in order, and (conv_id, n_own). Rows without a conv_id are left out.

    Order is by turn (null first), then role, then the first 32 characters of the text, then a digest of role and text. Rows
    are dealt by ranges of all of these, so a conversation of any length is numbered by many tasks; of what precedes a part in
    its first conversation (a number for each part at most) the numbers follow by a broadcast.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("conv_id", "turn", "role", F.left("text", F.lit(32)).alias("start"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    key = ["conv_id", "turn", "role", "start", "digest"]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", "digest", "words")
    made = stored(rows.mapInArrow(_number, "conv_id bigint, pid int, k bigint, digest binary, words bigint"), "turns")
    parts = made.groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("n"))
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.withColumn("earlier", F.sum("n").over(before)).where("earlier > 0").select("conv_id", "pid", "earlier")
    numbered = made.join(F.broadcast(earlier), ["conv_id", "pid"], "left").select("conv_id", (F.col("k") + F.coalesce("earlier", F.lit(0))).alias("pos"), "digest", "words")
    return numbered, convs


def rebuilt_turns(numbered: DataFrame, convs: DataFrame, family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, words) with borrowed beginnings, and (conv_id, n_turns).

    A conversation c starts with the first h turns of conversation c - c % family (fewer if that has fewer, none if it isn't
    there), h = crc32(c) % (most + 1), and goes on with its own after its first h. A remainder has the sign of c.
    """
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (most + 1)).cast("int")
    lender = F.col("conv_id") - F.col("conv_id") % family
    turn = F.struct("pos", "digest", "words")
    heads = numbered.where((F.col("conv_id") % family == 0) & (F.col("pos") <= most)).groupBy(F.col("conv_id").alias("lender")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    convs = convs.select("conv_id", "n_own", h.alias("h"), lender.alias("lender")).join(heads, "lender", "left")
    convs = convs.withColumn("head", F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(head, 1, 0)"), F.array().cast("array<struct<pos:bigint,digest:binary,words:bigint>>")))
    convs = stored(convs.select("conv_id", "n_own", "h", "head"), "conversations")
    got = F.size("head")
    short = convs.where(got < F.col("h")).select("conv_id", (F.col("h") - got).alias("short"))
    own = numbered.where(F.col("pos") > h).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "digest", "words")
    lent = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.words")
    sizes = convs.select("conv_id", (got + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).cast("bigint").alias("n_turns"))
    return lent.unionByName(own), sizes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members of classes as joined lists of bounded length."""
    key, ids = None, []
    for b in batches:
        out = []
        for *now, c in zip(*(x.to_pylist() for x in b.columns)):
            if now != key or len(ids) >= CHUNK:
                if ids:
                    out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
                key, ids = now, []
            ids.append(c)
        yield _batch(out, CHUNKS)
    yield _batch([(*key, ids[0], len(ids), ",".join(map(str, ids)))] if ids else [], CHUNKS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes from their lists in order; of a list, nothing is kept but the state of the hash."""
    key, first, n, sha = None, None, 0, None
    for b in batches:
        out = []
        for x1, x2, n_turns, least, count, text in zip(*(x.to_pylist() for x in b.columns)):
            if (x1, x2, n_turns) != key:
                if sha:
                    out.append((first, n, key[2], sha.hexdigest()))
                key, first, n, sha = (x1, x2, n_turns), least, 0, hashlib.sha256()
            sha.update(f"{',' * bool(n)}{text}".encode())
            n += count
        yield _batch(out, CLASS)
    yield _batch([(first, n, key[2], sha.hexdigest())] if sha else [], CLASS)


CHUNKS = "x1 bigint, x2 bigint, n_turns bigint, first bigint, n bigint, ids string"
CLASS = "c bigint, w bigint, n bigint, sha string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    return pa.record_batch([pa.array(c, arrow[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], list(names))


def sequence_classes(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """(c, w, n, sha) of each distinct sequence: its smallest conversation, their number, its turns and the digest of their ids.

    Equal sequences have the same length and the same two 64-bit sums over their segments. Members are dealt by ranges that end
    inside a class, too, so a class of any size is listed by many tasks; one task then hashes its lists in a stream, as a
    digest of one string must be made in order.
    """
    sums = segments.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("seg", "ids")).alias("x1"), F.bit_xor(F.xxhash64("ids", F.lit("second"), "seg")).alias("x2"), F.sum(F.size("ids")).cast("bigint").alias("n_turns"))
    sums = sums.select("x1", "x2", "n_turns", "conv_id")
    empty = sizes.where("n_turns = 0").select(F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("x2"), "n_turns", "conv_id")
    sums = sums.unionByName(empty)
    lists = sums.repartitionByRange(*sums.columns).sortWithinPartitions(*sums.columns).mapInArrow(_chunks, CHUNKS)
    lists = lists.repartition("x1", "x2", "n_turns").sortWithinPartitions("x1", "x2", "n_turns", "first")
    return stored(lists.mapInArrow(_digests, CLASS), "sequence-classes")


def quicksort_nodes(members: list[tuple], d: int, bc: int, path: list[int]) -> list[tuple]:
    """Nodes of the classes (c, w, n, sha, ids, words) of a bucket that share their next turn, below the node (bc, depth d).

    Multikey quicksort: classes are parted by the id at a depth into smaller, equal and larger; the equal part is a node and is
    parted at the next depth. Nodes come before those below them, so sums over subtrees go backwards over the list.
    """
    nodes: list[list] = []  # conv, depth, parent's place, n_convs, children, leaves, saved, ends

    def node(eq: list[tuple], depth: int, parent: int) -> int:
        n = sum(m[1] for m in eq)
        nodes.append([min(m[0] for m in eq), depth, parent, n, 0, 0, (n - 1) * eq[0][5][depth - d - 1], NO_ENDS])
        return len(nodes) - 1

    stack = [(members, d, -1)]
    while stack:
        part, depth, parent = stack.pop()
        pivot = part[len(part) // 2]
        if depth == pivot[2]:  # only one class of a part can end here
            nodes[parent][7] = pivot[3]
            rest = [m for m in part if m[2] != depth]
            if rest:
                stack.append((rest, depth, parent))
            continue
        if len(part) == 1:
            while depth < pivot[2]:
                depth += 1
                parent = node(part, depth, parent)
            nodes[parent][7] = pivot[3]
            continue
        at = depth - d
        x = pivot[4][at]
        less, equal, more = [], [], []
        for m in part:
            y = m[4][at] if m[2] > depth else -1
            (equal if y == x else less if y < x else more).append(m)
        stack += [(p, depth, parent) for p in (less, more) if p]
        stack.append((equal, depth + 1, node(equal, depth + 1, parent)))
    for i in range(len(nodes) - 1, -1, -1):
        at, up = nodes[i], nodes[i][2]
        at[5] = at[5] or 1
        if up >= 0:
            nodes[up][4] += 1
            nodes[up][5] += at[5]
            nodes[up][6] += at[6]
    return [(c, depth, nodes[up][0] if up >= 0 else bc, n, kids, leaves, saved, ends, path if up < 0 else None) for c, depth, up, n, kids, leaves, saved, ends in nodes]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all local buckets of a part that is sorted by bucket, class and segment."""
    bucket, members, path = None, [], None
    for b in batches:
        out = []
        for d, bc, digit, way, c, w, n, sha, _, ids, words in zip(*(x.to_pylist() for x in b.columns)):
            if (d, bc, digit) != bucket:
                if members:
                    out += quicksort_nodes(members, *bucket[:2], path)
                bucket, members, path = (d, bc, digit), [], way
            if members and members[-1][0] == c:
                members[-1][4].extend(ids)
                members[-1][5].extend(words)
            else:
                members.append((c, w, n, sha, ids, words))
        yield _batch(out, TOP)
    yield _batch(quicksort_nodes(members, *bucket[:2], path) if members else [], TOP)


MEMBER = ["d", "bc", "digit", "path", "c", "w", "n", "sha", "seg", "ids", "words"]


def trie_nodes(segments: DataFrame, classes: DataFrame, segment: int = SEGMENT, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of classes, whose sequences come in segments of that many turns.

    A round splits all buckets by the id at one depth. Bucket sizes are counted before anything is gathered: a bucket of at most
    `local` turns goes to a task as a whole; a single class of more turns becomes a chain of nodes without being gathered;
    other large buckets get a node and another round. So no task holds more than a bucket's bound, and rounds go on only
    as deep as more than `local` turns have a common beginning. Sums over subtrees of the large buckets' nodes come from
    the nodes below, each of which knows the way to it.
    """
    spark = segments.sparkSession
    class_segments = segments.join(classes, segments.conv_id == classes.c).select("c", "w", "n", "sha", "seg", "ids", "words")
    class_segments = stored(class_segments, "class-segments")
    whole = classes.agg(F.min("c").alias("c"), F.sum("w").alias("n_convs"), F.max(F.when(F.col("n") == 0, F.col("sha"))).alias("ends")).first()
    if whole.c is None:
        return spark.createDataFrame([], NODE)
    big_nodes = spark.createDataFrame([(whole.c, 0, None, whole.n_convs, 0, whole.ends, [])], "c bigint, depth bigint, parent bigint, n_convs bigint, words bigint, ends string, path array<bigint>")
    state = class_segments.where("seg = 0").select(F.lit(whole.c).cast("bigint").alias("bc"), F.array(F.lit(whole.c).cast("bigint")).alias("path"), "*")
    members, singles, d = None, None, 0
    while True:
        at, seg = d % segment, d // segment
        state = state.withColumn("d", F.lit(d).cast("bigint")).withColumn("digit", F.get("ids", F.lit(at)))
        ends = F.max(F.when(F.col("n") == d + 1, F.col("sha"))).alias("ends")
        sizes = state.groupBy("bc", "digit").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("n_convs"), F.sum(F.col("n") - d).alias("turns"), F.min("c").alias("next"), F.min(F.get("words", F.lit(at))).alias("words_here"), ends, F.first("path").alias("way"))
        large = stored(sizes.where(F.col("turns") > local), "large-buckets")
        name = large.select("bc", "digit", "m", "next")
        told = state.join(F.broadcast(name) if is_small(name) else name, ["bc", "digit"], "left")
        mine = told.where(F.col("m").isNull()).select(*MEMBER[:-2], *[F.slice(x, at + 1, segment).alias(x) for x in MEMBER[-2:]])
        more = mine.where(F.col("n") > (seg + 1) * segment).drop("seg", "ids", "words").join(class_segments.where(F.col("seg") > seg).select("c", "seg", "ids", "words"), "c").select(*MEMBER)
        one = told.where("m = 1").select("d", "bc", "path", "c")
        members = mine.unionByName(more) if members is None else members.unionByName(mine).unionByName(more)
        singles = one if singles is None else singles.unionByName(one)
        split = large.where("m > 1")
        if split.isEmpty():
            break
        big_nodes = big_nodes.unionByName(split.select(F.col("next").alias("c"), F.lit(d + 1).cast("bigint").alias("depth"), F.col("bc").alias("parent"), "n_convs", F.col("words_here").alias("words"), "ends", F.col("way").alias("path")))
        on = told.where((F.col("m") > 1) & (F.col("n") > d + 1)).select(F.col("next").alias("bc"), F.concat("path", F.array("next")).alias("path"), "c", "w", "n", "sha", "seg", "ids", "words")
        d += 1
        if d % segment == 0:
            on = on.drop("seg", "ids", "words").join(class_segments.where(F.col("seg") == d // segment).select("c", "seg", "ids", "words"), "c")
        state = stored(on, "buckets")

    members = members.repartition("d", "bc", "digit").sortWithinPartitions("d", "bc", "digit", "c", "seg")
    small = members.select(*MEMBER).mapInArrow(_finish, TOP)
    later = Window.partitionBy("c").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    chain = class_segments.join(singles, "c").withColumn("after", F.coalesce(F.sum(total(F.col("words"))).over(later), F.lit(0)))
    chain = chain.select("*", F.posexplode("words").alias("i", "here")).withColumn("depth", F.col("seg") * segment + F.col("i") + 1).where("depth > d")
    rest = F.col("after") + total(F.expr("slice(words, i + 1, size(words))"))
    top = F.col("depth") == F.col("d") + 1
    long = chain.select(
        F.col("c").alias("conv_id"), "depth", F.when(top, F.col("bc")).otherwise(F.col("c")).alias("parent_conv_id"), F.col("w").alias("n_convs"), (F.col("depth") < F.col("n")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("w") - 1) * rest).alias("saved_tokens"), F.when(F.col("depth") < F.col("n"), NO_ENDS).otherwise(F.col("sha")).alias("ends_sha256"), F.when(top, F.col("path")).alias("path"),
    )
    below = stored(small.unionByName(long), "nodes")

    own = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    told = below.where(F.col("path").isNotNull()).select("path", "n_leaves", F.col("saved_tokens").alias("saved"))
    told = told.unionByName(big_nodes.where("depth > 0").select("path", F.lit(0).cast("bigint").alias("n_leaves"), own))
    ways = told.select("n_leaves", "saved", F.size("path").alias("length"), F.posexplode("path").alias("depth", "c"))
    sums = ways.groupBy("c", "depth").agg(F.sum((F.col("depth") == F.col("length") - 1).cast("bigint")).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
    upper = big_nodes.join(sums, ["c", "depth"], "left").select(
        F.col("c").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        (own + F.coalesce("below", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return upper.unionByName(below.drop("path"))


def conversation_trie(turns: DataFrame, segment: int = SEGMENT, local: int = LOCAL, family: int = 20) -> DataFrame:
    """The NODE columns of every node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Null role or text is empty; rows without a conv_id belong to no conversation. A conversation without turns after rebuilding
    is a member of the root only. A table without conversations has no nodes, not even a root. Equal rows of a
    conversation are turns of their own.
    """
    numbered, convs = ordered_turns(turns)
    rebuilt, sizes = rebuilt_turns(numbered, convs, family)
    ids = stored(numbered.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-ids")
    coded = rebuilt.join(ids, "digest").select("conv_id", ((F.col("pos") - 1) / segment).cast("bigint").alias("seg"), F.struct("pos", "id", "words").alias("t"))
    segments = coded.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", "seg", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))
    segments = stored(segments, "segments")
    return trie_nodes(segments, sequence_classes(segments, sizes), segment, local)
