import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F, types as T

from kohort.llm.kneser_ney import BITS, ORDER, SYMBOLS, WHOLE, Numbering, classify, costs, discounts, distinct_ngrams, ngram_costs, ngrams, perplexities

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("keep", "integer").add("bin", "string")
LABELS = T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer")


def symbols(text):
    return [32] * (ORDER - 1) + [48 if c in "123456789" else ord(c) for c in text or ""]


def brute(texts):
    """cost(history + symbol) by the textbook recursion."""
    grams = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        s = symbols(t)
        grams[ORDER].update(tuple(s[i : i + ORDER]) for i in range(len(s) - ORDER + 1))
    for k in range(ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut = [None] + [discounts(*[list(grams[k].values()).count(i) for i in (1, 2, 3, 4)]) for k in range(1, ORDER + 1)]
    total, taken = [defaultdict(float) for _ in grams], [defaultdict(float) for _ in grams]
    for k in range(1, ORDER + 1):
        for g, c in grams[k].items():
            total[k][g[:-1]] += c
            taken[k][g[:-1]] += cut[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / SYMBOLS
        h = g[:-1]
        if not total[k][h]:
            return p(g[1:])
        c = grams[k][g]
        return (c - cut[k][min(c, 3) - 1] if c else 0) / total[k][h] + taken[k][h] / total[k][h] * p(g[1:])

    return p


def prose(rng, n):
    return " ".join(rng.choice(["the", "then", "ring", "stone", "of", "under", "a", "hath", "Ring", "water,", "fire."]) for _ in range(n))


def junk(rng, n):
    return " ".join("".join(rng.choice("qxzvj#%&*") for _ in range(6)) for _ in range(n))


def test_costs_equal_the_textbook_recursion(spark):
    rng = random.Random(2)
    texts = [prose(rng, 30) for _ in range(20)] + ["", None, "élan ünd 42!"]
    model = costs(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = brute(texts)
    wanted = {tuple(s[i : i + ORDER]) for t in [*texts, "the ring", "Žluťoučký 😀", "\x00"] for s in [symbols(t)] for i in range(len(s) - ORDER + 1)}
    packed = [(WHOLE, sum(x << BITS * (ORDER - 2 - k) for k, x in enumerate(g[:-1])), g[-1], 0) for g in wanted]
    found = ngram_costs(spark.createDataFrame(packed, "model int, context long, symbol int, c int"), model, "c").collect()
    got = {(*[r.context >> BITS * (ORDER - 2 - k) & SYMBOLS - 1 for k in range(ORDER - 1)], r.symbol): r.cost for r in found}
    assert set(got) == wanted
    for g, cost in got.items():
        assert math.isclose(cost, -math.log(p(g)), rel_tol=1e-9)
    every = [tuple(s[i : i + ORDER]) for t in texts for s in [symbols(t)] for i in range(len(s) - ORDER + 1)]
    mean = sum(got[g] for g in every) / len(every)
    assert math.isclose(model.means[WHOLE], mean, rel_tol=1e-9)
    rows = perplexities(spark.createDataFrame([(i, t) for i, t in enumerate(["the ring", "жук 😀", "", None])], "i int, text string"), model, 10).orderBy("i").collect()
    for r in rows[:2]:
        s = symbols(r.text)
        cost = sum(-math.log(p(tuple(s[i : i + ORDER]))) for i in range(len(s) - ORDER + 1))
        assert math.isclose(r.perplexity, math.exp((cost + 10 * mean) / (len(r.text) + 10)), rel_tol=1e-9)
        assert r.n_symbols == len(r.text)
    assert [(r.n_symbols, r.perplexity) for r in rows[2:]] == [(0, None), (0, None)]


def test_ngrams_of_any_script_have_numbers_of_their_own():
    rng = random.Random(5)
    for most in (0x7F, 0x4FF, 0xD7FF, 0x10FFFF):
        texts = ["".join(chr(rng.randint(1, most)) for _ in range(n)) for n in (0, 1, 2, 90_000 if most > 0xFFFF else 5_000)]
        texts = [t.encode("utf-8", "ignore").decode() for t in texts]
        raw = [t.encode() for t in texts]
        context, symbol, bounds = ngrams(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        assert symbol.tolist() == [48 if c in "123456789" else ord(c) for t in texts for c in t]
        assert bounds.tolist() == np.cumsum([0, *map(len, texts)]).tolist()
        c, s, n = distinct_ngrams(context, symbol)
        assert Counter(dict(zip(zip(c.tolist(), s.tolist()), n.tolist()))) == Counter(zip(context.tolist(), symbol.tolist()))
        numbering = Numbering(context, symbol)
        assert (numbering.contexts is not None) == (most == 0x10FFFF)
        back = numbering.back(numbering.of(context, symbol))
        assert np.array_equal(back[0], context) and np.array_equal(back[1], symbol)
    # a lead byte whose character is cut off takes nothing from the next row
    raw = np.frombuffer(b"a\xe4\xb8" + b"\x96b", dtype=np.uint8)
    assert ngrams(raw, np.array([0, 3, 5]))[1].tolist() == [97, (4 << 6) | 0x38, 98]


def test_union_holds_little_more_than_the_different_ngrams(monkeypatch):
    from kohort.llm import kneser_ney

    monkeypatch.setattr(kneser_ney, "HELD", 1_000)
    sizes, merge = [], kneser_ney.distinct_ngrams
    monkeypatch.setattr(kneser_ney, "distinct_ngrams", lambda c, s: (sizes.append(len(c)), merge(c, s))[1])
    rng = np.random.default_rng(1)
    parts = [(rng.integers(32, 52, 300).astype(np.int64), rng.integers(32, 52, 300).astype(np.int64)) for _ in range(200)]
    got = kneser_ney.union_ngrams(iter(parts))
    want = {(c, s) for part in parts for c, s in zip(*(x.tolist() for x in part))}
    assert len(got[0]) == len(want) and set(zip(*(x.tolist() for x in got))) == want
    assert max(sizes) <= 2 * len(want) + 1_000 + 300  # 60,000 at once before


def test_junk_in_a_script_without_latin_letters_is_rejected(spark):
    """Folded to classes of bytes, all Cyrillic letters were one symbol, and junk of them looked like prose."""
    rng = random.Random(8)
    words = "кольцо камень под водой огонь тихо горит старый лес и дорога".split()
    letters = sorted(set("".join(words)))
    good = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bad = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) for _ in range(n))
    rows = [(i, good(60) if i % 3 else bad(60), "ru") for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)]
    out = classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS))
    kept = {r.junk: r.kept for r in out.groupBy((F.col("doc_id") % 3 == 0).alias("junk")).agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert kept[True] == 0
    assert kept[False] > 0.97


def test_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 80)) if i % 3 else junk(rng, 40), None if i % 7 == 0 else "en", 1, "x") for i in range(300)]
    rows += [(1000, None, "en", 1, None), (1001, "", None, None, None), (None, prose(rng, 20), "de", 0, None), (5, rows[5][1], "en", 1, "x")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (4, None, 0), (10, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = classify(docs, spark.createDataFrame(labels, LABELS))
    assert out.columns == ["doc_id", "text", "lang", "bin", "n_symbols", "perplexity", "threshold", "keep"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.keep == (r.doc_id is None or r.doc_id >= 300 or r.doc_id % 3 > 0)
    assert classify(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []
    assert all(r.keep for r in classify(docs, spark.createDataFrame([], LABELS)).collect())


def test_held_out_accuracy(spark):
    """Fitted on the labels of even ids, judged on those of odd ids."""
    from kohort.llm.queries import table

    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels")
    out = classify(table(spark, folder, "documents"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    kept = {r.quality: r["avg(k)"] for r in out.selectExpr("quality", "cast(keep as int) as k").groupBy("quality").avg("k").collect()}
    assert kept[1] > 0.98
    assert kept[0] < 0.3


def test_toxic_low_quality_and_clean_rows_held_out(spark):
    """Fitted on the labels of even ids, each class of the odd ids judged by itself."""
    from kohort.llm.queries import table

    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    out = classify(table(spark, folder, "documents"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    share = out.selectExpr("avg(if(quality = 1 and toxic = 0, int(keep), null)) clean", "avg(if(toxic = 1, int(keep), null)) toxic", "avg(if(quality = 0 and toxic = 0, int(keep), null)) low").first()
    assert share.clean > 0.97
    assert share.toxic < 0.5
    assert share.low < 0.1
