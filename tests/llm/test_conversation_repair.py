import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from cohortlens.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def by_force(rows, entry=repair.START):
    """(cost, least audit, repaired rows) by a plain search from the last row back."""
    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "", ())] if i == len(rows) and state in (repair.START, repair.ASSISTANT) else []
        follow = repair.FOLLOW[state]
        if inserted < 3:
            c, a, o = best(i, follow, inserted + 1)
            out.append((c + 5, "I" + a, (f"{repair.ROLE[follow]}:", *o)))
        if i < len(rows):
            c, a, o = best(i + 1, state, 0)
            out.append((c + 2, "D" + a, o))
            role, text, fault = rows[i]
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                to = {"s": repair.SYSTEM, "u": repair.USER, "a": repair.ASSISTANT}.get(role[:1])
                legal = {repair.START: (repair.SYSTEM, repair.USER), repair.SYSTEM: (repair.USER,), repair.USER: (repair.ASSISTANT,), repair.ASSISTANT: (repair.USER,)}
                if to in legal[state]:
                    c, a, o = best(i + 1, to, 0)
                    out.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                c, a, o = best(i + 1, follow, 0)
                out.append((c + 1 + more, "R" + a, (f"{repair.ROLE[follow]}:{text}", *o)))
        return min(out) if out else (10 ** 9, "", ())

    return best(0, entry, 0)


def expected(rows, damaged=True):
    """What the query returns for (conv_id, turn, role, text) rows."""
    out, seen = {}, {}
    for conv, turn, role, text in rows:
        seen.setdefault(conv, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        seen[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, own in seen.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        faults = []
        for k, (_, role, text) in enumerate(own):
            bare = text.strip(WHITE)
            faults.append(1 if not bare else 2 if (role, text) in [r[1:] for r in own[:k]] else 3 if bare[-1] not in ".!?" else 0)
        cost, audit, lines = by_force(tuple((r[1], r[2], f) for r, f in zip(own, faults)))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                     sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def random_rows(seed, conversations=60, longest=14):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", None, "Go!", "a b c", "x. ", "é…", "wait.\n"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "unknown"]
    return [(c if c else None, r.choice([None, *range(9)]) if c % 3 else t, r.choice(roles), r.choice(texts))
            for c in range(conversations) for t in range(r.randrange(1, longest))]


def test_lattice_by_force():
    r = random.Random(3)
    for _ in range(3000):
        rows = [(r.choice(["s", "u", "a", "x", ""]), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randrange(9))]
        for entry in range(4):
            cost, audit, end = repair.Lattice(rows, repair.END).repair(entry)
            want = by_force(tuple((i, "t", f) for i, f in rows), entry)
            assert (cost, audit + "I" * (repair.END[end] // 5)) == want[:2]


def test_entry_costs_equal_repairs():
    r = random.Random(4)
    for _ in range(200):
        rows = [(r.choice("suax"), r.choice([0, 0, 1, 3])) for _ in range(r.randrange(1, 8))]
        for state in range(4):
            exits = [0 if q == state else repair.NEVER for q in range(4)]
            costs = repair.Lattice(rows).costs_to(state)
            for entry in range(4):
                assert min(repair.Lattice(rows, exits).repair(entry)[0], repair.NEVER) == costs[entry] if costs[entry] < repair.NEVER else True


@pytest.mark.parametrize("block", [1, 2, 3, 7, 2000])
def test_blocks_give_the_same_repair(spark, block):
    rows = random_rows(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(repair.repair(df, repair.damage(df), block)) == expected(rows)


def test_undamaged_rows_and_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"row {t}.") for t in range(90)]
    rows += [(2, t, "user", "same.") for t in range(40)] + [(3, None, None, None), (4, 5, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(repair.repair(df, block=16))
    assert got == expected(rows, damaged=False)
    assert got[1][5:7] == (0, "K" * 90)


def test_empty_and_other_columns(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, 1, "user", "a."), (7, 2, "assistant", "b.")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA + ", pos long, kind string, copy int")
    assert found(repair.repair(df)) == expected(rows, damaged=False)
    gone = [(c, t, "user", "a.") for c in range(200) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame(gone, SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert gone and set(found(repair.repair(df, repair.damage(df))).values()) == {(0, 0, 0, 0, 0, 0, "", empty)}
