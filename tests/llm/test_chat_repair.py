import hashlib
import itertools
import random
import re
import zlib

import duckdb
from pyspark.sql import types as T

from kohort.llm import chat_repair
from kohort.llm.chat_repair import SQL, lightest_whole, repair, repair_damaged

SCHEMA = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string").add("place", "string").add("span", "integer")


def brute(turns):
    """All edits with up to two turns put in anywhere: least (cost, audit, initials)."""
    best = None
    for puts in itertools.product(range(3), repeat=len(turns) + 1):
        for edits in itertools.product("KRD", repeat=len(turns)):
            cost, audit, options = 0, "", [""]
            for k, n in enumerate(puts):
                cost += 3 * n
                audit += "I" * n
                for _ in range(n):
                    options = [o + x for o in options for x in "ua"]
                if k == len(turns):
                    break
                (initial, fault), e = turns[k], edits[k]
                audit += e
                if e == "D":
                    cost += 4
                elif fault in (1, 2):
                    break
                else:
                    cost += 3 * (fault == 3) + 3 * (e == "R")
                    options = [o + x for o in options for x in ("ua" if e == "R" else initial)]
            else:
                if any(re.fullmatch("(s?(ua)+)?", o) for o in options) and (best is None or (cost, audit) < best):
                    best = cost, audit
            if k == len(turns) and any(re.fullmatch("(s?(ua)+)?", o) for o in options) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_lightest_equals_all_edits():
    rng = random.Random(2)
    for _ in range(60):
        turns = [(rng.choice("suuaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 3))]
        assert lightest_whole(turns)[:2] == brute(turns)
    assert lightest_whole([("u", 0), ("a", 0)])[:2] == (0, "KK")
    assert lightest_whole([("s", 0)])[:2] == (4, "D")


def whole(rows):
    """The damaged rows of every conversation, repaired one by one."""
    convs = {c: [] for c, *_ in rows}
    sp = lambda v: " " if v is None else v
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", sp(x)) if kind == 2 else sp(x)
        convs[c] += [(t, "user" if kind == 4 else sp(r), text)] * (2 if kind == 3 else 1)
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        seen, faults = set(), []
        for _, r, x in turns:
            end = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not end else 2 if (r, x) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((r, x))
        cost, audit = dp([(r[:1], f) for (_, r, _), f in zip(turns, faults)])
        lines, state, at = [], 0, 0
        for e in audit:
            if e == "I":
                state = 3 if state == 2 else 2
                lines.append(("assistant" if state == 3 else "user") + ":")
                continue
            _, r, x = turns[at]
            at += 1
            if e == "R":
                state = 3 if state == 2 else 2
                lines.append(("assistant" if state == 3 else "user") + ":" + x)
            elif e == "K":
                state = {"s": 1, "u": 2, "a": 3}[r[0]]
                lines.append(f"{r}:{x}")
        numbers = {t for t, _, _ in turns if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def dp(turns):
    """Least (cost, audit) by a table over the states, turn by turn."""
    put = {0: 2, 1: 2, 2: 3, 3: 2}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                new = c + 3, a + "I"
                if put[s] not in states or new < states[put[s]]:
                    states[put[s]] = new
        return states

    states = {0: (0, "")}
    for initial, fault in turns:
        after = {}
        for s, (c, a) in closed(states).items():
            late = 3 * (fault == 3)
            moves = [(s, c + 4, a + "D")]
            if fault in (0, 3):
                moves.append((put[s], c + 3 + late, a + "R"))
                if (s, initial) in step:
                    moves.append((step[s, initial], c + late, a + "K"))
            for t, cost, audit in moves:
                if t not in after or (cost, audit) < after[t]:
                    after[t] = cost, audit
        states = after
    return min(v for s, v in closed(states).items() if s in (0, 3))


def corpus():
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "tool", None, "", "User", "aide"]
    texts = ["Yes.", "no", "", " \t\n", None, "What? ", "long é! " * 30, "Yes."]
    rows = []
    for c in [*range(60), None]:
        rows += [(c, t, rng.choice(roles[: 2 + c % 7 if c else 8]), rng.choice(texts) if rng.random() < 0.4 else f"{t} done{rng.choice('.!? ')}") for t in range(rng.randint(1, 9))]
    rows += [(70, t, rng.choice(roles[:3]), f"n{t % 190}{rng.choice(['.', ''])}") for t in range(700)]
    rows += [(71, 5, "user", "x.")] * 3 + [(71, None, "user", "first."), (71, 5, "assistant", "tie."), (72, None, None, None), (73, -3, "user", "early."), (73, 300, "assistant", "late.")]
    return rows


def test_same_as_one_by_one(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(6)
    want = whole(rows)
    assert sorted((tuple(r) for r in repair_damaged(frame).collect()), key=repr) == want
    monkeypatch.setattr(chat_repair, "SPAN_BITS", 2)  # conversations over many spans
    assert sorted((tuple(r) for r in repair_damaged(frame).collect()), key=repr) == want
    assert repair_damaged(frame.limit(0)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Cut"), (2, 0, "assistant", "Alone."), (3, 0, "user", " ")]
    found, turns = repair(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (7, "KDK"), 2: (3, "IK"), 3: (4, "D")}
    got = [(r.conv_id, r.edit, r.role, r.text) for r in turns.orderBy("conv_id", "place", "step").collect()]
    assert got == [(1, "K", "user", "Hi."), (1, "D", None, None), (1, "K", "assistant", "Cut"), (2, "I", "user", ""), (2, "K", "assistant", "Alone."), (3, "D", None, None)]


def test_query_equals_sql(spark, folder):
    from kohort.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = QUERIES["op13_chat_repair"](spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL})").fetchall())
