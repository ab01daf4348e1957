import random
import re

import numpy as np
from pyspark.sql import types as T

from kohort.llm.decontam import Items, best_span, find_items, without_items

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("item_id", "string").add("edits", "integer")


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def nearest(item, words):
    """Least word edits between ``item`` and any run of ``words``."""
    cost = [0] * (len(words) + 1)
    for i, w in enumerate(item, start=1):
        new = [i]
        for j, v in enumerate(words, start=1):
            new.append(min(cost[j - 1] + (v != w), cost[j] + 1, new[j - 1] + 1))
        cost = new
    return min(cost)


def brute(docs, items, rate=0.2, least=5):
    out = {}
    for d, text in docs:
        words = tokens(text)
        for i, t in items:
            item = tokens(t)
            if len(item) >= least and (best := nearest(item, words)) <= int(rate * len(item) + 1e-9):
                out[d, i] = best
    return out


def corpus(seed=1, docs=120, items=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 4)))
    bench = [(i, " ".join(word() for _ in range(rng.choice([5, 8, 15, 30, 50])))) for i in range(items)]
    rows = []
    for d in range(docs):
        words = [word() for _ in range(rng.randint(0, 150))]
        if d % 2:
            item = bench[rng.randrange(items)][1].split()
            for _ in range(rng.randint(0, max(1, len(item) // 4))):
                at, kind = rng.randrange(len(item)), rng.randrange(3)
                item[at : at + (kind != 1)] = [] if kind == 2 else [word()]
                item = item or ["x"]
            at = rng.randint(0, len(words))
            words[at:at] = item
        rows.append((d, (", " if d % 3 else " ").join(words).upper() if d % 5 == 0 else " ".join(words)))
    return rows + [(900, ""), (901, None), (902, "w " * 4000)], bench


def test_recall_against_brute_force_and_exact_distances(spark):
    rows, bench = [], []
    want, got = {}, {}
    for seed in (1, 2, 3):
        rows, bench = corpus(seed)
        docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
        found = find_items(docs, spark.createDataFrame([*bench, (99, None), (98, "too short")], "item_id long, text string"), block_bytes=400 if seed == 2 else 1 << 20).collect()
        assert len(found) == len({(r.doc_id, r.item_id) for r in found})
        got |= {(seed, r.doc_id, r.item_id): r.edits for r in found}
        want |= {(seed, *k): v for k, v in brute(rows, bench).items()}
    assert len(want) > 100
    assert set(got) <= set(want)  # nothing but true hits
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.99 * len(want)


def test_verbatim_items_are_always_found(spark):
    rows, bench = corpus(7)
    docs = [(i, f"before {t} after") for i, t in bench]
    left = without_items(spark.createDataFrame([*docs, (77, "nothing here"), (None, None), (None, bench[0][1])], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 77]


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "A, b. c d e f g!")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g")], "item_id long, text string")
    assert sorted((r.doc_id or -1, r.item_id, r.edits, r.start_word, r.end_word) for r in find_items(docs, bench).collect()) == [(-1, 5, 0, 0, 7), (1, 5, 0, 0, 7), (1, 5, 0, 0, 7)]
    assert find_items(docs, bench.limit(0)).collect() == []
    assert find_items(docs.limit(0), bench).collect() == []
    assert without_items(docs, bench.limit(0)).count() == 3


def test_best_span():
    item = np.array([1, 2, 3, 4], dtype=np.uint64)
    assert best_span(item, np.array([9, 1, 2, 3, 4, 9], dtype=np.uint64)) == (0, 1, 5)
    assert best_span(item, np.array([1, 2, 9, 3, 4], dtype=np.uint64)) == (1, 0, 5)
    assert best_span(item, np.zeros(0, dtype=np.uint64))[0] == 4


def test_items_that_share_no_runs_give_no_windows():
    items = Items([1], ["one two three four five six seven eight"], 0.2, 5, 6, 8)
    raw = np.frombuffer(b"eight seven six five four three two one", np.uint8)
    assert items.search(raw, np.array([0, len(raw)])) == {}


def test_query_equals_brute_force_on_the_small_table(spark, folder):
    from kohort.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    runs = {i: {tuple(tokens(t)[k : k + 3]) for k in range(len(tokens(t)) - 2)} for i, t in bench}
    want = {}
    for d, text in docs:  # an item of 10 or more words within the limit shares a run of three words
        words = tokens(text)
        have = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        want |= brute([(d, text)], [(i, t) for i, t in bench if runs[i] & have])
    got = {(r.doc_id, r.item_id): r.edits for r in QUERIES["op8_decontamination"](spark, folder).collect()}
    assert got == want
