"""The registered queries of the operators, with production parameters, and the SQL they must equal where SQL can say it."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kohort.llm import chat_repair, fingerprints, perspectives
from kohort.session import shared_folder, stage_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizers():
    """The installed vocabulary files."""
    return importlib.import_module("public_tokenizers")


@query("op10_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizers().path("byte_bpe_50k.tiktoken"), tokenizers().PATTERN)


@query("op7_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.ngram_join import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.kneser_ney import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "keep")


@query("op8_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.decontam import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.token_files import token_digests, write_tokens

    return token_digests(write_tokens(table(spark, sf_dir, "documents"), tokenizers().path("byte_bpe_50k.json")))


@query(
    "op3_block_search",
    """WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT q.vec_id AS query_id, x.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, x.e), lambda z: (z[2] - z[1]) * (z[2] - z[1])), lambda a, b: a + b)) AS score
      FROM v q JOIN v x ON x.vec_id <> q.vec_id AND len(x.e) = len(q.e) WHERE q.vec_id % 100 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
)
def block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.block_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op2_chat_perspectives", perspectives.SQL)
def chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op9_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.url_filter import judge, labelled_urls, train

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")


WORD = "[^\\x20\\x09-\\x0D]+"
SIGN = "[!-/:-@\\[-`{-~]|[^\\x20\\x09-\\x0D!-/:-@\\[-`{-~]+"


@query(
    "op4_token_rollup",
    f"""WITH d AS (SELECT doc_id, source, lang, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words,
        len(regexp_extract_all(coalesce(text, ''), '{SIGN}')) AS signs, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents),
    k AS (SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'signs-1' END AS version, CASE WHEN lang = 'en' THEN words ELSE signs END AS n FROM d WHERE copy = 1)
    SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM k GROUP BY source, lang, version""",
)
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, those in other languages than English are counted again by signs, copies of a text are deleted; two batches are sent twice."""
    from kohort.llm.token_rollup import TokenRollup, change

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(text, 256).alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"), F.regexp_count(text, F.lit(SIGN)).alias("signs"))
    docs = stage_table(docs, "token-counts")
    first = [F.col(c).alias(f"a_{c}") for c in ("source", "lang")] + [F.lit("words-1").alias("a_version"), F.col("words").alias("a_n_tokens")]
    second = [F.col(c).alias(f"b_{c}") for c in ("source", "lang")] + [F.lit("signs-1").alias("b_version"), F.col("signs").alias("b_n_tokens")]
    inserts = docs.select(*first).select(*change(None, "a_"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    revised = docs.where(~english).select(*first, *second).select(*change("a_", "b_"))
    least = docs.groupBy("key").agg(F.min("doc_id").alias("least"))
    gone = docs.join(least, "key").where("doc_id <> least")
    deleted = gone.where(english).select(*first).select(*change("a_", None)).unionByName(gone.where(~english).select(*second).select(*change("b_", None)))
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    for name, changes in (("load", inserts), ("load", inserts), ("recount", revised), ("copies", deleted), ("recount", revised)):
        rollup.commit(name, changes)
    return rollup.totals()


@query("op11_fingerprints", fingerprints.SQL)
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kohort.llm.whitening import whiten

    # null where the exact number leaves the range of bigint
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("op13_chat_repair", chat_repair.SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_damaged(table(spark, sf_dir, "conversations"))
