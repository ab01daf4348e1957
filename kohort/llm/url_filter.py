"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path goes on up
to ``?``, ``#`` or the end. A rule (a host, a path and a verdict) fits its host and all subdomains if the path starts with the
rule's; the longest that fits decides. All other urls get the model's verdict.

The model sees which of 2**14 hash buckets the runs of 3 to 5 characters of host and path fall into (host and path apart, with
marks at the ends of the host). It is trained with Spark's logistic regression on a small table of labelled urls, of which at most
``MAX_LABELS`` are used, least hash first. Rules and weights have fixed sizes; urls are scored row by row without a shuffle.

Null urls and urls without ``://`` have an empty host and path, no rule, and the model's verdict on nothing, which is to allow;
repeated rows are judged alike; null ids stay; an empty table gives an empty result. Columns of the new names are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kohort.llm.url_labels import ALLOWED, BLOCKED

BUCKETS = 1 << 14
MAX_LABELS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> tuple[Column, Column]:
    """Host and path of a url column."""
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _runs(text: Column, mark: str, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def featured(urls: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``urls`` with the vector column ``_seen``."""
    h, p = F.when(F.col(host) != "", F.concat(F.lit("^"), F.col(host), F.lit("$"))).otherwise(""), F.col(path)
    grams = urls.withColumn("_grams", F.concat(*[_runs(h, "h", n) for n in (3, 4, 5)], *[_runs(p, "p", n) for n in (3, 4, 5)]))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_seen").transform(grams).drop("_grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small table that comes with the operator: url, label (1: to be blocked)."""
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, label int")


def train(labelled: DataFrame, max_labels: int = MAX_LABELS, strength: float = 0.01) -> LogisticRegressionModel:
    host, path = parts("url")
    rows = labelled.where("url is not null and label in (0, 1)").distinct().orderBy(F.xxhash64("url", "label")).limit(max_labels).coalesce(1)
    rows = featured(rows.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")))
    return LogisticRegression(featuresCol="_seen", labelCol="label", regParam=strength, maxIter=100, standardization=False).fit(rows)


def rule_column(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    at_home = lambda h: (F.col(host) == h) | F.col(host).endswith("." + h)
    fit = [F.when(at_home(h) & F.col(path).startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*fit) if fit else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: LogisticRegressionModel, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score (the model's probability of a block) and verdict."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    host, path = parts(url)
    # the caller's columns travel in one, so that none is called as a column of the model
    row = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(1).alias("none")])
    scored = model.transform(featured(pages.select(row.alias("_row"), host.alias("host"), path.alias("path"))))
    out = scored.withColumn("_rule", rule_column(rules)).withColumn("score", vector_to_array("probability").getItem(1))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in keep], "host", "path", F.col("_rule.rule").alias("rule"), "score", verdict.alias("verdict"))
