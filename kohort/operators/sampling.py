"""An exact number of rows picked by hash, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_by_hash(df: DataFrame, n: int, digest: Column, key: str) -> DataFrame:
    """The ``n`` rows with the smallest ``digest`` (64 bits), ties by ``key``.

    Counts of the 2**16 ranges of the digest tell which range holds the n-th row; whole ranges below it are kept, and only
    the rows of that one are numbered.
    """
    if n <= 0:
        return df.limit(0)
    rows = df.withColumn("_digest", digest).withColumn("_range", F.shiftright("_digest", 48))
    left, last = n, None
    for r in rows.groupBy("_range").agg(F.count("*").alias("c")).orderBy("_range").collect():
        last = r["_range"]
        if r["c"] >= left:
            break
        left -= r["c"]
    else:
        return df
    order = Window.partitionBy("_range").orderBy("_digest", key)
    at = rows.where(F.col("_range") == last).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= left).drop("_nth")
    return rows.where(F.col("_range") < last).unionByName(at).drop("_digest", "_range")
