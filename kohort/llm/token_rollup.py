"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is turned into signed rows: what a document counted before with minus, what it counts now with plus. An
insert has no before, a delete no after, a revised count or a move to another tokenizer version has both. Spark adds the rows
up to one delta per group (partial sums first, so no group is gathered), and the delta is written to a folder of the batch.
The batch counts from the moment its name is in the log, which is written last: a batch that failed half-way leaves nothing
that is read, may be sent again, and is ignored if it is sent again afterwards. Totals add up the deltas of the batches in the
log; ``compact`` replaces them by one.

Null sources, languages and versions are groups of their own; a null count adds no tokens but counts the document; repeated
rows count as often as they occur; empty batches are committed too. Columns beyond those named play no part. Groups whose
documents and tokens are both zero are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ("source", "lang", "version")
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
_LOG = "batch string, replaces array<string>"


def change(before: str | None, after: str | None) -> tuple:
    """Struct columns ``before`` and ``after`` of a change from columns with that prefix; None for none."""
    empty = F.lit(None).cast("struct<source:string,lang:string,version:string,n_tokens:bigint>")
    make = lambda p: empty if p is None else F.struct(*[F.col(f"{p}{k}").cast("string").alias(k) for k in KEYS], F.col(f"{p}n_tokens").cast("long").alias("n_tokens"))
    return make(before).alias("before"), make(after).alias("after")


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], _LOG).write.mode("append").parquet(f"{self.folder}/log")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.folder}/log")

    def _write(self, batch: str, delta: DataFrame, replaces: list[str]) -> None:
        delta.write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        self.spark.createDataFrame([(batch, replaces)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch with columns ``before`` and ``after``; False if a batch of this name counts already."""
        if not self._log().where(F.col("batch") == batch).isEmpty():
            return False
        signed = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("s")))).alias("x")).where("x.s is not null")
        delta = signed.groupBy(*[F.col(f"x.s.{k}").alias(k) for k in KEYS]).agg(F.sum(F.col("x.sign").cast("long")).alias("n_docs"), F.sum(F.col("x.sign") * F.coalesce("x.s.n_tokens", F.lit(0))).alias("n_tokens"))
        self._write(batch, delta.where("n_docs <> 0 or n_tokens <> 0"), [])
        return True

    def _current(self) -> list[str]:
        log = self._log().distinct().collect()  # a row a batch since the last compaction, and one for each before
        gone = {b for r in log for b in r.replaces}
        return sorted({r.batch for r in log} - gone)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over all committed batches."""
        names = self._current()
        deltas = self.spark.read.schema(_DELTA).parquet(*[f"{self.folder}/deltas/{b}" for b in names]) if names else self.spark.createDataFrame([], _DELTA)
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Put one delta in the place of all so far; their names stay known."""
        names = self._current()
        if len(names) > 1:
            self._write(f"compact-{uuid.uuid4().hex}", self.totals(), names)
