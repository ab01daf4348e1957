import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T

from kohort.llm import bpe
from kohort.llm.arrow_text import slices
from kohort.llm.pieces import PieceTable, cut

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BITS = [" ", "  ", "\n", "\t", "a", "bc", "é", "ß", "日本", "😀", "\x1c", "\x1f", "\x85", "\xa0", " ", "​", "　", "1", "23", "٣", "½", "!", "...", "'s", "'ll", "’", "́", "ſ", "İ", "﻿", "𝒳", "👨‍👩", "the", " and", "\r\n", "_", "ª", "ⅷ", "᠎"]
SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("n_tokens", "string").add("token_ids", "integer")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Codec(bpe.read_ranks(PATH), PATTERN)


def texts(seed=1, n=4000):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def encoded(coder, rows, limit=1 << 14):
    out = []
    for _, _, raw, off in slices(pa.array(rows, pa.string()), limit):
        ids, counts = coder.encode(raw, off)
        out += np.split(ids, np.cumsum(counts)[:-1])
    return [x.tolist() for x in out]


def test_same_ids_as_the_library(ours, theirs):
    rows = [*texts(), "a" * 5000, "ab" * 3000, "é" * 3000, " " * 5000, "\n" * 3000 + "x", "=-" * 2000]
    assert encoded(ours, rows) == [theirs.encode_ordinary(t) for t in rows]
    assert encoded(ours, rows, 64) == [theirs.encode_ordinary(t) for t in rows]


def test_decoding_gives_the_text_back(ours, theirs):
    for t in texts(2, 1500):
        ids = np.array(theirs.encode_ordinary(t), dtype=np.int64)
        assert b"".join(ours.decode(ids)) == t.encode()
        for portion in ours.decode(ids):
            portion.decode()  # whole characters only


def test_states_are_made_again_after_the_table_was_emptied():
    fst = bpe.Transducer(bpe.read_ranks(PATH), max_states=40)
    words = sorted({w.strip().encode() for w in texts(3, 400)} | {b"hello", b"helloworld", b"help"} - {b""})
    got = list(fst.encode_sorted(words))
    assert fst.emptied > 2
    assert all(b"".join(fst.bytes_of[i] for i in ids) == w for ids, w in zip(got, words))
    fresh = bpe.Transducer(bpe.read_ranks(PATH))
    assert got == [next(iter(fresh.encode_sorted([w]))) for w in words]


def test_utf8_machine_on_broken_bytes():
    rng = random.Random(5)
    for _ in range(3000):
        data = b"".join(rng.choice([b"a", "é".encode(), "日".encode(), "😀".encode(), b"\x80", b"\xc3", b"\xe6\x97", b"\xf0\x9f", b"\xff", b"\xc0", b"\xed\xa0"]) for _ in range(rng.randint(0, 8)))
        machine, at, out = bpe.Utf8Machine(), 0, []
        while at < len(data):
            step = rng.randint(1, 3)
            out.append(machine.feed(data[at : at + step]))
            at += step
        ready = b"".join(out)
        assert ready + machine.close() == data
        assert len(data) - len(ready) <= 3


def test_pieces_are_cut_only_where_the_pattern_cuts(ours):
    for t in texts(7, 3000):
        raw = np.frombuffer(t.encode(), np.uint8)
        starts, first = cut(raw, np.array([0, len(raw)]))
        bounds = [*starts.tolist(), len(raw)]
        pieces = [raw[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])]
        assert [m for p in pieces for m in ours.pattern.findall(p)] == ours.pattern.findall(t)
        assert first.tolist() == [0, len(starts)]


def test_piece_table_starts_again_when_full():
    table = PieceTable(lambda pieces: (np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32), np.array([len(p) for p in pieces])), limit=6)
    for rows in (["a b c", "d e"], ["f g h i", ""], ["a b c", "f g"]):
        for _, _, raw, off in slices(pa.array(rows)):
            ids, counts = table.ids(raw, off)
            assert bytes(ids.astype(np.uint8)) == "".join(rows).encode()
            assert counts.tolist() == [len(r) for r in rows]


def test_queries_and_columns(spark, theirs):
    rows = [(1, "Hello world", "clash", 7), (None, "x y", None, None), (3, None, None, None), (3, None, None, None), (4, "", "a", 1), (5, " ".join(texts(9, 3000)), "b", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = bpe.encode_texts(docs, PATH, PATTERN)
    assert out.columns == ["doc_id", "text", "token_ids", "n_tokens"]
    got = sorted(((r.doc_id or -1, r.text, list(r.token_ids), r.n_tokens) for r in out.collect()), key=repr)
    want = sorted(((i or -1, t, theirs.encode_ordinary(t or ""), len(theirs.encode_ordinary(t or ""))) for i, t, *_ in rows), key=repr)
    assert got == want
    assert bpe.encode_texts(docs.limit(0), PATH, PATTERN).collect() == []
    digests = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, PATH, PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == sorted((i or -1, len(x := theirs.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t, *_ in rows)


def test_query_equals_the_library_on_the_small_table(spark, folder, theirs):
    from kohort.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op10_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
