import base64

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from kohort.llm.kneser_ney import classify
from kohort.session import stage_table

from tests.llm.test_decontam import brute as leaks
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_suffix_dedup import brute as repeats


def test_every_stage_equals_brute_force_on_what_the_one_before_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    done = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage_table(stage(spark, docs, folder), f"test-{name}")
        done.append((docs, out))
        docs = out
    rows = [{r.doc_id: r for r in out.collect()} for _, out in done]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(out.columns == columns for _, out in done[:-1])

    first = {r.doc_id: r for r in done[0][0].collect()}
    assert set(rows[0]) == {r.doc_id for r in classify(done[0][0], labels).where("keep").collect()}
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert len(clean - set(rows[0])) <= 0.02 * len(clean)
    assert all(rows[0][i] == first[i] for i in rows[0])

    least = components([(i, r.text) for i, r in rows[0].items()])
    assert set(rows[1]) == {i for i, (_, c) in least.items() if c == i}
    assert all(rows[1][i] == rows[0][i] for i in rows[1])

    order = sorted(rows[1])
    kept = dict(zip(order, [x[3].decode("utf-8", "ignore") for x in repeats([rows[1][i].text for i in order], 200, least_words=51)], strict=True))
    assert {i: r.text for i, r in rows[2].items()} == kept
    assert all(r.n_chars == len(r.text) for r in rows[2].values())

    held = {d for d, _ in leaks([(i, r.text) for i, r in rows[2].items()], bench[:40])}
    assert set(rows[3]) == set(rows[2]) - held
    assert held

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: list(r.token_ids) for i, r in rows[4].items()} == {i: coder.encode_ordinary(r.text) for i, r in rows[3].items()}
    assert all(r.n_tokens == len(r.token_ids) for r in rows[4].values())
    assert corpus_pipeline.run(spark, folder).count() == len(rows[4])


def test_odd_rows_pass_through_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id", None, None, None), (None, None, "en", "s", 0), (10**9, None, "xx", None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "twice", "en", "s", 5), (10**9 + 2, "twice", "en", "s", 5)], docs.schema)
    docs = docs.limit(40).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, folder), f"odd-{name}")
    ids = [r.doc_id for r in docs.where(F.col("doc_id").isNull() | (F.col("doc_id") >= 10**9)).collect()]
    assert sorted(i or 0 for i in ids) == [0, 0, 10**9, 10**9 + 1, 10**9 + 2]
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage_table(stage(spark, empty, folder), f"empty-{name}")
    assert empty.count() == 0
