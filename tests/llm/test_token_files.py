import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from kohort.llm.token_files import TokenFile, TokenWriter, token_digests, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("file", "string").add("place", "integer")


def want(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_writer_and_reader_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    for n in (0, 1, 31, 32, 33, 100, 1000):
        ids = rng.integers(1, 50_000, n)
        out = TokenWriter(f"file://{tmp_path}/x/{n}.arrow", length=8, rows=4)
        for part in np.array_split(ids, 7):
            out.add(part)
        out.close()
        file = TokenFile(f"{tmp_path}/x/{n}.arrow")
        assert np.array_equal(np.concatenate([np.zeros(0, np.int64), *file.span(0, n)]), ids)
        for a, m in ((0, 1), (n // 3, n // 2), (max(n - 5, 0), 5)):
            if a + m <= n and m:
                assert np.array_equal(np.concatenate(file.span(a, m)), ids[a : a + m])
        for s in range(-(-n // 8)):
            seq, mask = file.sequence(s)
            assert not seq.flags.owndata
            real = ids[s * 8 : s * 8 + 8]
            assert np.array_equal(seq[: len(real)], real)
            assert mask.to_pylist() == [k < len(real) for k in range(8)]
        assert all(file.reader.get_batch(k).num_rows == 4 for k in range(file.batches - 1))
        assert file.reader.schema.field("input_ids").type == pa.list_(pa.uint16(), 8)


def test_same_as_the_tokenizer(spark):
    texts = ["Hello  world", "", None, " lead and  trail ", "a\n\n b\t c", "naïve café — 日本語 テスト 😀😀", "x" * 3000, " " * 50 + "y", "don't we'll <|endoftext|> it's", "1234 56 ٣٤　 z  q", "\x1c \x85   e"]
    rows = [(7 * i % 101, t) for i, t in enumerate(texts * 9)]
    rows = sorted({i: t for i, t in rows}.items())
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    index = write_tokens(docs, PATH, length=16, rows=3)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_digests(index).collect())
    assert got == want(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "first"), (3, "again"), (3, "again"), (5, None)]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_digests(write_tokens(docs, PATH)).collect())
    assert got == [(-1 if i is None else i, *x) for i, *x in want(rows)]
    assert token_digests(write_tokens(docs.limit(0), PATH)).collect() == []


@pytest.mark.parametrize("name", ["op6_token_files"])
def test_query_equals_the_tokenizer_on_the_small_table(spark, folder, name):
    from kohort.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in QUERIES[name](spark, folder).collect()) == want(rows)
