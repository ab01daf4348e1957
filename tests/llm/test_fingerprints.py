import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F, types as T

from kohort.llm.fingerprints import ALIKE, EQUAL, SQL, WIDTHS, compare_edits, fingerprints, likeness, minus, plus, shown

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("lanes", "string").add("key", "integer").add("copies", "integer")


def brute(text):
    """Lanes of a text, paragraph by paragraph."""
    lanes = [0] * len(WIDTHS)
    for p in (text or "").split("\n"):
        if p:
            lanes[0] += 1
            for h in (0, 1):
                digest = hashlib.sha256(f"{h}{p}".encode()).digest()
                for i in range(EQUAL // 2):
                    lanes[2 + h * EQUAL // 2 + i] += int.from_bytes(digest[4 * i : 4 * i + 4], "big")
            spots = [m.span() for m in re.finditer("[^\\x20\\x09-\\x0D]+", p)]
            for i in range(0, len(spots), 4):
                last = spots[min(i + 3, len(spots) - 1)]
                digest = hashlib.md5(p[spots[i][0] : last[1]].encode()).digest()
                lanes[1] += 1
                for w in range(ALIKE // 32):
                    word = int.from_bytes(digest[4 * w : 4 * w + 4], "big")
                    for j in range(32):
                        lanes[2 + EQUAL + 32 * w + j] += word >> j & 1
    return [x % (1 << w) for x, w in zip(lanes, WIDTHS)]


def near(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * v - lanes[1] for v in lanes[2 + EQUAL :]] for lanes in (a, b))
    both = sum(v * v for v in x + y)
    return max(0.0, min(1.0, 2 * sum(p * q for p, q in zip(x, y)) / both)) if both else 0.0


def hexed(lanes):
    return "".join(f"{v:0{w // 4}x}" for v, w in zip(lanes, WIDTHS))


def brute_edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).digest()))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = brute(t), brute(edited), brute(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c)))
    return sorted(out, key=repr)


def words(rng, n):
    return "".join(rng.choice(["wort", "é", "naïve", "x", "日本"]) + rng.choice([" ", " ", "\t", "\n", "\n\n", ". "]) for _ in range(n))


def corpus():
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(0, 90))) for i in range(40)]
    rows += [(7, rows[7][1])] * 3 + [(None, "a\nb"), (None, None), (None, None), (3, "tie"), (3, "other"), (90, ""), (91, " \n\t"), (92, "one"), (93, words(rng, 6000)), (94, rows[2][1])]
    return rows


def test_same_as_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in compare_edits(docs).collect()), key=repr) == brute_edits(rows)
    for few in ([], [(4, "alone here")], [(4, None), (4, None)]):
        docs = spark.createDataFrame([(*r, None, None, None) for r in few], SCHEMA)
        assert sorted((tuple(r) for r in compare_edits(docs).collect()), key=repr) == brute_edits(few)


def test_sums_of_paragraphs(spark):
    rng = random.Random(4)
    parts = [words(rng, 12).replace("\n", " ") for _ in range(6)]
    texts = {1: "\n".join(parts), 2: "\n".join(parts[::-1]), 3: "\n".join(parts[:4]), 4: "\n".join(parts[4:]), 5: "\n".join(parts[:5])}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = fingerprints(docs)
    by = {i: got.where(F.col("doc_id") == i).select(F.col("lanes").alias(f"l{i}")) for i in texts}
    row = by[1]
    for i in (2, 3, 4, 5):
        row = row.crossJoin(by[i])
    c = {i: F.col(f"l{i}") for i in texts}
    out = row.select(c[1] == c[2], plus(c[3], c[4]) == c[1], minus(c[1], c[4]) == c[3], c[1] == c[5], likeness(c[1], c[2]), likeness(c[1], c[5]), likeness(c[3], c[4]), shown(c[1])).first()
    assert tuple(out)[:5] == (True, True, True, False, 1.0)
    assert out[5] > 0.7 > 0.4 > out[6]
    assert out[7] == hexed(brute(texts[1]))


def test_edited_half_is_nearer_than_the_next(spark, folder):
    got = compare_edits(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()
    assert (got.near_edited >= got.near_next).mean() > 0.97
    assert abs(got.near_edited.mean() - 0.5) < 0.05


def test_query_equals_sql(spark, folder):
    from kohort.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = QUERIES["op11_fingerprints"](spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL})").fetchall())


def test_plan_has_no_python(spark, folder):
    from kohort.llm.queries import QUERIES

    plan = QUERIES["op11_fingerprints"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
