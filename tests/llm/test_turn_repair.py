"""op13: repairs against plain search over all edits, in one part and in many, with hard cases."""

import hashlib
import random
import re
import zlib

import pytest

from cvlake.llm import queries, turn_repair

TURNS = "conv_id bigint, turn bigint, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        role, text = name(role), name(text)
        role, text = ("user" if kind == 4 else role), ("" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The result of one conversation's rows after damage, in order: cheapest (cost, audit) for each place and state."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)
    best = [dict.fromkeys(NEXT) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for _ in range(5):
            for state in NEXT:
                ways = [(0, "")] if i == n and state in ("", "a") else []
                goes = [(3, "I", i, NEXT[state])]
                if i < n:
                    goes.append((4, "D", i + 1, state))
                    if faults[i] not in ("blank", "duplicate"):
                        more, mine = 3 * (faults[i] == "truncated"), rows[i][2][:1]
                        goes.append((3 + more, "R", i + 1, NEXT[state]))
                        if mine == NEXT[state] or (state == "" and mine == "s"):
                            goes.append((more, "K", i + 1, mine))
                ways += [(c + best[j][s][0], e + best[j][s][1]) for c, e, j, s in goes if best[j][s]]
                best[i][state] = min(ways, default=None)
    cost, audit = best[0][""]
    state, i, said = "", 0, []
    for e in audit:
        state = state if e == "D" else rows[i][2][:1] if e == "K" else NEXT[state]
        role = rows[i][2] if e == "K" else {"u": "user", "a": "assistant"}.get(state)
        said += [] if e == "D" else [f"{role}:{'' if e == 'I' else rows[i][3]}"]
        i += e != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(s[:1] for s in said))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = lambda f: faults.count(f)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def plain_all(rows):
    order = sorted(plain_damage(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    return {c: plain_repair([r for r in order if r[0] == c]) for c in {r[0] for r in rows}}


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_op13_is_what_plain_search_gives(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_turn_repair(spark, sf_dir)) == plain_all(rows)


def talk(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "Go on!", "é. ", "x. \x0b"]
    return [(c, rng.choice([t, t, t + 1, None]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "User", "", None]), rng.choice([*texts, None, f"Text {t}.", f"Text {t}."])) for c in range(convs) for t in range(rng.randint(0, most))]


@pytest.mark.parametrize("parts", [1, 64])
def test_repairs_in_few_and_many_parts(spark, parts):
    """With 64 parts most conversations go over a part's border."""
    rows = talk(parts, 40, 24) + [(100, t, ["user", "assistant"][t % 2], f"Turn {t}{'.' * (t % 7 > 0)}") for t in range(700)] + [(101, None, "user", "Same.")] * 50
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(turn_repair.repair_conversations(turn_repair.damaged(spark.createDataFrame(rows, TURNS))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_all(rows)


def test_layers_are_exact():
    """Words of sixteen layers hold the cost of every state, for any turns."""
    rng = random.Random(3)
    for _ in range(300):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["", "a", "b.", f"{i}."])) for i in range(rng.randint(0, 30))]
        assert turn_repair.repaired([r[1:] for r in rows]).result(0)[1:] == plain_repair(rows)


def test_repair_hard_cases(spark):
    rows = [(None, 1, "user", "No id."), (None, None, None, None), (5, 1, "user", "a."), (5, 1, "user", "a."), (-7, 0, "user", "word " * 200_000 + "end."), (-7, 1, "assistant", "ok.")]
    turns = spark.createDataFrame(rows, TURNS)
    # extra columns with the operator's own names do no harm
    clash = turns.selectExpr("*", "'x' as kind", "'y' as pid", "'z' as dropped", "1 as word")
    assert found(turn_repair.repair_conversations(turn_repair.damaged(clash))) == plain_all(rows)
    assert turn_repair.repair_conversations(turn_repair.damaged(turns.limit(0))).count() == 0
    # a conversation that loses all its turns is still there
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = turn_repair.repair_conversations(turn_repair.damaged(spark.createDataFrame([(lost, 0, "user", "Gone.")], TURNS))).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
