import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from kohort.llm.ngram_join import join_tile, link_documents

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("n", "string").add("_id", "integer").add("tile", "string")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """{doc_id: (n, component)} by comparing every pair."""
    sets = [(i, shingles(t)) for i, t in rows]
    least = {i: i for i, _ in rows}
    changed = True
    links = [(i, j) for a, (i, s) in enumerate(sets) for j, t in sets[a + 1 :] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            changed |= least[i] != m or least[j] != m
            least[i] = least[j] = m
    return {i: (len(s), least[i]) for i, s in sets}


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus():
    rng = random.Random(11)
    passage = words(rng, 60)
    texts = [words(rng, rng.randint(0, 120)) for _ in range(60)]
    for t in texts[:30]:
        t[10:10] = passage[: rng.randint(30, 60)]
    for size, many in ((40, 90), (200, 70), (25, 12)):
        base = words(rng, size)
        for _ in range(many):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(99)}"
            texts.append(t[: len(t) - rng.randint(0, size // 6)])
    texts = [" ".join(t) for t in texts]
    texts += [texts[0].upper(), texts[1].replace(" ", "\n\t"), "", None, "  ", "one two", "One  TWO", "É é", "é é", "a b c d e", "a b c d", "x " * 5000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * k, texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("tile", "run_pairs"), [(512, 32), (16, 3)])
def test_same_as_all_pairs(spark, tile, run_pairs):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1, None) for r in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(docs, tile=tile, run_pairs=run_pairs).collect()}
    assert got == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text, None, 1, None), (4, text, None, 1, None), (4, text, None, 1, None), (2, text + " ", None, 1, None), (9, None, None, 1, None)], SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in link_documents(docs).collect())
    assert got == [(-1, 3, None), (2, 3, 2), (4, 3, 2), (4, 3, 2), (9, 0, 9)]
    assert link_documents(docs.limit(0)).collect() == []


def test_tile_joins_what_all_pairs_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(400) < 0.9], rng.integers(0, 1 << 63, 5).astype(np.uint64)))) for _ in range(40)]
    links = join_tile(range(40), [True] * 40, range(40), [len(s) for s in sets], [s.tobytes() for s in sets])
    label = list(range(40))
    for a, b in links:
        assert 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))
        x, y = label[a], label[b]
        assert x != y
        label = [x if v == y else v for v in label]
    for a in range(40):
        for b in range(a):
            if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b])):
                assert label[a] == label[b]


def test_query_equals_brute_force_on_the_small_table(spark, folder):
    from kohort.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_jaccard"](spark, folder).collect()}
    assert got == brute(rows)
