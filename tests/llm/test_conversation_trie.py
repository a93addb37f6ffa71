"""op11: every node against a plain trie, with buckets of any size, parts of any number, and hard cases."""

import hashlib
import random
import re
import zlib

import pytest

from cvlake.llm import conversation_trie, queries

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_nodes(rows):
    order = sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    own = {}
    for c, _, role, text in order:
        own.setdefault(c, []).append((role, text))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(lender, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children, leaves, saved = {}, {}, {}
    for seq in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        leaves[seq] = leaves.get(seq, 0) or 1
        saved[seq] = saved.get(seq, 0) + (len(members[seq]) - 1) * words
        if seq:
            up = seq[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[seq]
            saved[up] = saved.get(up, 0) + saved[seq]
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
    return {(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children.get(s, 0), leaves[s], saved[s], digest(s)) for s, m in members.items()}


def found(df):
    rows = df.collect()
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_op11_is_the_plain_trie(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_conversation_trie(spark, sf_dir)) == plain_nodes(rows)


def talk(seed, convs):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ua"), rng.choice(["yes", "no no", "", " x\ty "])) for c in range(convs) for t in range(rng.randint(1, 9))]
    rows += [(1_000 + c, t, "u", f"common turn {t}") for c in range(30) for t in range(12 + c // 10)]
    rows += [(2_000, t, "u", f"long {t % 7}") for t in range(400)] + [(2_001, t, "u", f"long {t % 7}") for t in range(400)]
    rows += [(c, 0, "u", "only") for c in range(3_000, 3_060)]
    return rows


@pytest.mark.parametrize("segment,local,parts", [(256, 4_096, 1), (8, 60, 8), (3, 4, 40)])
def test_trie_of_any_bounds(spark, segment, local, parts):
    """Rounds over many depths and segments, long single sequences, and parts that end inside conversations and classes."""
    rows = talk(segment, 80)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts < 40).lower())
    try:
        got = found(conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS), segment, local))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_nodes(rows)


def test_trie_hard_cases(spark):
    rows = [(None, 0, "u", "no id"), (5, None, None, None), (5, None, "u", "a"), (5, 1, "u", "a"), (5, 1, "u", "a"), (-7, 0, "user", "word " * 200_000), (-7, 1, "ab", "c"), (-8, 0, "user", "word " * 200_000), (-8, 1, "a", "bc"), (41, 3, "", "")]
    turns = spark.createDataFrame(rows, TURNS)
    clash = turns.selectExpr("*", "'x' as digest", "'y' as pid", "1 as words", "'z' as start")
    assert found(conversation_trie.conversation_trie(clash)) == plain_nodes(rows)
    assert conversation_trie.conversation_trie(turns.limit(0)).count() == 0
    # only turns that are dropped by rebuilding: nothing but a root
    gone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    (root,) = found(conversation_trie.conversation_trie(spark.createDataFrame([(gone, 0, "u", "x")], TURNS)))
    assert root == (gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())
