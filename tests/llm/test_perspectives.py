import random

import duckdb
import pytest
from pyspark.sql import types as T

from kohort.llm.perspectives import END, SQL, rotate

SCHEMA = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string").add("place", "string").add("n", "integer")


def brute(rows):
    out = []
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, "unknown" if r is None else r, x or ""))
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        for p in sorted({r for _, r, _ in turns} - {"system"}):
            at = 0
            for k, (t, r, x) in enumerate(turns, start=1):
                head = "<|assistant|>\n" if r == p else "<|system|>\n" if r == "system" else f"<|user name={r}|>\n"
                whole = head + x + END
                mask = (at + len(head), at + len(whole)) if r == p else (at, at)
                out.append((c, p, k, t, r, whole, at, *mask))
                at += len(whole)
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    rows = []
    for c in [*range(20), None]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "Ann", None]), rng.choice([None, "", "hi", "long é " * 9, "a|b"])))
    rows += [(50, t, rng.choice(["a", "b", "c"]), f"t{t % 7}") for t in range(900)]
    rows += [(51, 5, "user", "x")] * 3 + [(51, None, "user", "first"), (51, 5, "assistant", "tie"), (52, 0, "system", "alone"), (53, -3, "user", "early"), (53, 300, "user", "late")]
    return rows


def test_same_as_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in rotate(frame).collect()), key=repr) == brute(rows)
    assert rotate(frame.limit(0)).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    from kohort.llm.queries import QUERIES

    got = QUERIES["op2_chat_perspectives"](spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL})").fetchall())
