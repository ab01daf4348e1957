import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from kohort.llm.suffix_dedup import remove_repeats, suffix_rounds, without_repeats

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("n_bytes", "string").add("_key", "integer")


def brute(texts, length, least_words=0):
    """(n_bytes, n_removed, n_spans, kept) of each text, every string compared with every other; runs of fewer words stay."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for m in re.finditer(b"\1+", bytes(gone)):
            if len(d[m.start() : m.end()].split()) < least_words:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage, other = words(rng, 60), words(rng, 40)
    texts = [words(rng, rng.randint(0, 250)) for _ in range(30)]
    for i in range(0, 30, 3):
        texts[i] = texts[i][: len(texts[i]) // 2] + passage[rng.randint(0, 20) :] + texts[i][len(texts[i]) // 2 :]
    texts += [passage, other * 3, other + passage, "a" * 500, "ab" * 300, "x" * 99, "", None, None]
    near = words(rng, 200)
    for _ in range(12):
        w = near.split(" ")
        w[rng.randrange(200)] = "edit"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[3], words(rng, 3000)]
    return texts


@pytest.mark.parametrize(("length", "max_run"), [(100, 20_000), (100, 3), (64, 20_000)])
def test_same_as_brute_force(spark, length, max_run):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, length, max_run=max_run).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_null_ids_and_repeated_rows_and_empty_table(spark):
    long = "word " * 100
    docs = spark.createDataFrame([(None, long, None, 1), (None, long, None, 1), (7, "short", None, 1), (7, "short", None, 1), (8, None, None, None)], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs).collect())
    assert got == [(-1, 500, 500, 1), (-1, 500, 500, 1), (7, 5, 0, 0), (7, 5, 0, 0), (8, 0, 0, 0)]
    assert remove_repeats(docs.limit(0)).collect() == []


def test_rounds_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, (6, 60)).astype(np.uint16)
    symbols = np.concatenate((base, base, base[:3]))
    for r in range(len(symbols)):
        symbols[r, rng.integers(0, 60, 2)] = 120 + r % 3
    symbols[2, 50:] = 256
    group = np.sort(np.arange(len(symbols)) % 3)
    first, last = suffix_rounds(symbols, group, 20)
    for i in range(len(symbols)):
        starts = [c for c in range(41) if any(j != i and group[i] == group[j] and (symbols[i, c : c + 20] == symbols[j, c : c + 20]).all() and (symbols[i, c : c + 20] < 256).all() for j in range(len(symbols)))]
        assert (first[i], last[i]) == ((starts[0], starts[-1]) if starts else (-1, -1))


def test_query_equals_brute_force_on_the_small_table(spark, folder):
    from kohort.llm.queries import QUERIES

    texts = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").toPandas()
    want = brute(list(texts.text), 400)
    got = QUERIES["op7_suffix_dedup"](spark, folder).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [(int(i), *w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in zip(texts.doc_id, want)]


def test_passages_of_over_fifty_short_words(spark):
    rng = random.Random(9)
    short = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([2, 3, 4]))) for _ in range(n))
    passages = [short(n) for n in range(53, 61)]
    few = short(45)
    texts = [f"{short(60)} {p} {short(40)}" for p in passages for _ in range(2)] + [f"{short(60)} {few} {short(60)}" for _ in range(2)]
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("kept", "string").add("_id", "integer").add("_row", "integer").add("_text", "string")
    docs = spark.createDataFrame([(i, t, "clash", 1, 2, "own") for i, t in enumerate(texts)], schema).repartition(4)
    got = without_repeats(docs, 200, least_words=51).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        assert tuple(r)[2:] == ("clash", 1, 2, "own")
        if i < 16:
            assert passages[i // 2][3:-3] not in r.text and 90 <= len(r.text.split()) <= 102
        else:
            assert r.text == texts[i]


def test_short_texts_that_repeat_themselves(spark):
    """Several anchors of a text may have the whole text around them; that alone repeats no string of the length."""
    rng = random.Random(11)
    texts = []
    for n in range(102, 118, 2):
        unit = "".join(rng.choice("abcdefgh ") for _ in range(20))
        texts += [(unit * 8)[:n], "#".join(((unit * 8)[:n], words(rng, 8)))]
        texts.append((words(rng, 12)[:20] * 12)[: 2 * n])
    alone = "".join(rng.choice("abcdefgh ") for _ in range(20))
    texts += [(alone * 8)[:n] for n in (104, 111)] + [("".join(rng.choice("abcdefgh ") for _ in range(20)) * 8)[:115] for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, 100).collect()}
    assert got == dict(enumerate(brute(texts, 100)))
