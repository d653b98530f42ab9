"""Conversation repair against a plain program that keeps whole edit strings."""

import hashlib
import random
import zlib
from functools import lru_cache
from itertools import product

import pytest

pytest.importorskip("shoebox.llm.queries")
from shoebox.llm import conversation_repair as R  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, fact string"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain(rows):
    """Suffix by suffix: least (cost, edits), with the roles."""

    @lru_cache(None)
    def best(i, at, room):
        every = []
        if i == len(rows) and at in ("", "a"):
            every.append((0, "", ()))
        for r in "ua" if room else "":
            if (at, r) in GRAMMAR:
                c, e, x = best(i, GRAMMAR[at, r], room - 1)
                every.append((c + 3, "I" + e, ((r, None), *x)))
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, e, x = best(i + 1, at, 2)
            every.append((c + 4, "D" + e, x))
            if not gone:
                for r in "ua":
                    if (at, r) in GRAMMAR:
                        c, e, x = best(i + 1, GRAMMAR[at, r], 2)
                        every.append((c + 3 + 3 * cut, "R" + e, ((r, i), *x)))
                if (at, initial) in GRAMMAR:
                    c, e, x = best(i + 1, GRAMMAR[at, initial], 2)
                    every.append((c + 3 * cut, "K" + e, (("keep", i), *x)))
        return min(every, key=lambda y: y[:2]) if every else (10**9, "", ())

    return best(0, "", 2)


def expected(table, damaged=True):
    seen, out = {}, {}
    sp = lambda x: " " if x is None else str(x)
    for c, t, role, text, *_ in table:
        rows = seen.setdefault(c, [])
        fate = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20 if damaged else 9
        role, text = sp(role), sp(text)
        role = "user" if fate == 4 else role
        text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
        rows += [(t, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for c, rows in seen.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        met, facts, n = set(), [], [0, 0, 0]
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in met else 2 if body[-1] not in ".!?" else 3
            met.add((role, text))
            facts.append((role[:1], fault < 2, fault == 2))
            if fault < 3:
                n[fault] += 1
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, kept = plain(facts)
        lines = [({"u": "user", "a": "assistant"}.get(r, rows[i][1] if i is not None else "")) + ":" + (rows[i][2] if i is not None else "") for r, i in kept]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(11)
    texts = ["yes.", "no", " \t", "", None, "what? ", "a\u0085b", "end!\n", "éé.", "yes. "]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    table = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.", "x") for c in range(120) for t in sorted(rng.sample(range(30), rng.randint(1, 12)))]
    table += [(None, 1, "user", "hello.", None), (None, None, None, None, None), (7, 3, "user", "tie.", "x"), (7, 3, "assistant", "tie.", "x"), (7, 3, "user", "tie.", "x")]
    table += [(2**60 + i, 2**61 + t, "user" if t % 2 else "system", "x" * (10**6 if t == 3 else 1) + ".", None) for i in range(2) for t in range(4)]
    rng.shuffle(table)
    return table


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_equals_plain(spark):
    table = conversations()
    rows = spark.createDataFrame(table, SCHEMA).repartition(5)
    assert got(R.repair(R.damage(rows))) == expected(table)
    assert got(R.repair(R.damage(rows), spill_rows=3)) == expected(table)


def test_every_short_conversation(spark):
    kinds = [("user", "x."), ("assistant", "x."), ("system", "x."), ("tool", "x."), ("user", "x"), ("system", "")]
    table = [(i, j, role, f"{j}{text}" if text else "", None) for i, rows in enumerate(product(kinds, repeat=4)) for j, (role, text) in enumerate(rows)]
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "true as present")
    assert got(R.repair(df)) == expected(table, False)


def test_dropped_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "user", "x.", False), (2, 1, "user", "x.", None)], "conv_id long, turn long, role string, text string, present boolean")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(R.repair(df)) == {1: nothing, 2: nothing}
    assert R.repair(R.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_giant_conversation_keeps_few_states(spark):
    rng = random.Random(5)
    facts = [rng.choice(["user", "assistant", "system", "other"]) for _ in range(20_000)]
    table = [(1, i, role, f"{i}" + "."[: i % 3], None) for i, role in enumerate(facts)]
    one = got(R.repair(spark.createDataFrame(table, SCHEMA).selectExpr("*", "true as present"), spill_rows=1000))[1]
    assert len(one[6].replace("I", "")) == len(table)
    program, state = R.Program(), R.START
    for i, role in enumerate(facts):
        state = program.steps[program.step(state, role[:1], False, i % 3 == 0)][0]
    assert len(program.steps) < 1000


def test_trail_reads_back():
    trail = R.Trail(7)
    for i in range(100):
        trail.add(i)
    assert list(trail.backward()) == list(range(99, -1, -1)) and trail.spilled == 98
    trail.close()
