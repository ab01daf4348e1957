"""Duplicate rules. Each one folds copies on the map side, so a heavily repeated row or key does not skew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from kohort.fixed_values import ID, ROW_ORDER

_CHUNK_BITS = 20


def drop_exact_duplicates(df: DataFrame, order: str = ROW_ORDER) -> DataFrame:
    """First of each set of equal rows; the ID takes part and NULLs are equal."""
    cols = [c for c in df.columns if c != order]
    return df.groupBy(*cols).agg(F.min(order).alias(order))


def own_group_when_null(key: str, order: str = ROW_ORDER):
    """A second grouping key that keeps rows with a missing key apart from each other."""
    return F.when(F.col(key).isNull(), F.col(order))


def drop_duplicate_ids(df: DataFrame, key: str = ID, order: str = ROW_ORDER) -> DataFrame:
    """First row per ID; rows without an ID all stay.

    The planner turns the rank filter into a per-task limit before the exchange.
    """
    w = Window.partitionBy(F.col(key), own_group_when_null(key, order)).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def fill_missing_ids(df: DataFrame, key: str = ID, order: str = ROW_ORDER) -> DataFrame:
    """Consecutive IDs after the largest one, in row order.

    Rows are numbered inside fixed-width slices of the row order and shifted by the running total of the
    slices before; only the slice totals (one row per million rows) meet in one place.
    """
    chunk = F.shiftright(F.col(order), _CHUNK_BITS)
    missing = F.col(key).isNull()
    slices = df.groupBy(chunk.alias("_slice")).agg(
        F.count_if(missing).alias("_missing"), F.max(key).alias("_largest")
    )
    everything = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.col("_slice").alias("_s"),
        (
            F.coalesce(F.max("_largest").over(everything), F.lit(0))
            + F.coalesce(F.sum("_missing").over(before), F.lit(0))
        ).alias("_start"),
    )
    inside = Window.partitionBy("_slice").orderBy(order)
    blanks = (
        df.filter(missing)
        .withColumn("_slice", chunk)
        .withColumn("_nth", F.row_number().over(inside))
        .join(offsets, F.col("_slice") == F.col("_s"))
        .withColumn(key, (F.col("_start") + F.col("_nth")).cast(df.schema[key].dataType))
    )
    return df.filter(~missing).unionByName(blanks.select(*df.columns))


def drop_duplicate_profiles(df: DataFrame, key: str = ID, order: str = ROW_ORDER) -> DataFrame:
    """First of each set of rows that agree on everything but the ID."""
    cols = [c for c in df.columns if c not in (key, order)]
    return (
        df.groupBy(*cols)
        .agg(F.min_by(key, order).alias(key), F.min(order).alias(order))
        .select(*df.columns)
    )


def count_duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    cols = cols or [c for c in df.columns if c != ROW_ORDER]
    groups = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def union_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def has_distinct_rows(df: DataFrame, cols: list[str], k: int) -> bool:
    """Whether at least ``k`` different feature rows exist."""
    return df.select(*cols).distinct().limit(k).count() >= k
