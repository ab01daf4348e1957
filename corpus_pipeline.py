"""From raw documents to token ids in five stages; each reads what the one before wrote.

Each stage is a function of (session, documents, folder of the tables) and gives the columns of ``documents``; the last one adds
ids and gives no text. Stages are applied to all rows that are left. See the operators for nulls, empty texts, ties and repeats.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from kohort.llm.bpe import encode_texts
from kohort.llm.decontam import without_items
from kohort.llm.kneser_ney import classify
from kohort.llm.ngram_join import link_documents
from kohort.llm.suffix_dedup import without_repeats
from kohort.session import stage_table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the least id. Rows without an id stay.

    Ids name documents: of rows that repeat an id the one whose text has the least hash stays.
    """
    first = link_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(whole, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("row"))
    kept = texts.join(first, "doc_id", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that occur more than once; n_chars follows.

    Strings of 200 bytes are looked for, which 51 words have if they are of three letters on average; what repeats must hold
    51 words to go.
    """
    out = without_repeats(docs, 200, least_words=51)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text. The tables are small, as the workers keep what the stages before left in them."""
    files = importlib.import_module("public_tokenizers")
    return encode_texts(docs, files.path("byte_bpe_50k.tiktoken"), files.PATTERN, keep=["doc_id", "lang", "source"], max_states=20_000, max_pieces=250_000)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
