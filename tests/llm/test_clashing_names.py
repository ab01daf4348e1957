import public_tokenizers
from pyspark.sql import functions as F

from kohort.llm.bpe import encode_texts
from kohort.llm.kneser_ney import classify
from kohort.llm.queries import URL_RULES
from kohort.llm.suffix_dedup import remove_repeats
from kohort.llm.url_filter import judge, labelled_urls, train

NAMES = ["_id", "_text", "_l", "kept", "probability", "_row", "_grams", "_seen", "rawPrediction", "prediction", "_lang", "_trusted", "_key"]


def test_callers_columns_stay_as_they_are(spark, folder):
    own = {n: F.lit(f"own {n}") for n in NAMES}
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).withColumns(own)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").withColumns(own)
    results = {
        "op5": classify(docs, labels),
        "op7": remove_repeats(docs),
        "op9": judge(pages, URL_RULES, train(labelled_urls(spark))),
        "op10": encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    }
    for which, out in results.items():
        for row in out.select(*[n for n in NAMES if not (which == "op7" and n == "kept")]).distinct().collect():
            assert row.asDict() == {n: f"own {n}" for n in row.asDict()}
