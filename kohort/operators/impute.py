"""Filling missing values with exact statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kohort.functions.scalars import finite
from kohort.operators.quantiles import exact_quantiles, fitted_quantiles


def fitted_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    return {c: v for (c, _), v in fitted_quantiles(df, cols, [0.5]).items()} if cols else {}


def impute_median(df: DataFrame, cols: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    medians = fitted_medians(df, cols) if medians is None else medians
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))) for c in cols})


def median_date(df: DataFrame, col: str) -> Column:
    """Literal median day of a DATE column (an even count rounds down to a whole day)."""
    days = df.select(F.unix_date(F.col(col).cast("date")).cast("double").alias("day"))
    value = fitted_medians(days, ["day"]).get("day")
    return F.date_from_unix_date(F.lit(None if value is None else int(value // 1)).cast("int"))


def impute_group_median(df: DataFrame, col: str, group: str) -> DataFrame:
    """Median of the row's group, else the overall median. The group table is joined; AQE broadcasts it when small."""
    by_group = exact_quantiles(df, [col], [0.5], [group]).select(F.col(group).alias("_g"), F.col("value").alias("_m"))
    overall = fitted_medians(df, [col]).get(col)
    return (
        df.join(by_group, F.col(group).eqNullSafe(F.col("_g")), "left")
        .withColumn(col, F.coalesce(F.col(col), F.col("_m"), F.lit(overall)))
        .drop("_g", "_m")
    )


def attach_group_mean(df: DataFrame, col: str, group: str, out: str) -> DataFrame:
    """``df`` with the mean of ``col`` over the row's group as ``out``; rows without a group are a group of their own.

    Sums combine before they are shuffled, and the group table has one row per group: AQE broadcasts it when small.
    """
    if out in df.columns:
        raise ValueError(f"Column '{out}' is there already.")
    means = df.groupBy(F.col(f"`{group}`").alias("_g")).agg(F.avg(f"`{col}`").alias(out))
    return df.join(means, F.col(f"`{group}`").eqNullSafe(F.col("_g")), "left").select(*[df[f"`{c}`"] for c in df.columns], out)


def value_counts(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by…, column, value, n) for the non-missing values of several columns in one scan."""
    by = by or []
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    return (
        df.select(*by, F.explode(pairs).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .groupBy(*by, F.col("p.column").alias("column"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def modes(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by…, column, value): most frequent value, the smallest one on ties."""
    by = by or []
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
    return value_counts(df, cols, by).groupBy(*by, "column").agg(best.getField("value").alias("value"))


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    found = {r["column"]: r["value"] for r in modes(df, cols).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(found.get(c, "Unknown"))) for c in cols})


def coerce_mostly_numeric(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Text columns become DOUBLE when at least ``threshold`` of all rows parse as numbers."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    parsed = {c: finite(F.col(c).try_cast("double")) for c in texts}
    shares = df.agg(*[F.avg(parsed[c].isNotNull().cast("double")).alias(c) for c in texts]).first()
    return df.withColumns({c: parsed[c] for c in texts if (shares[c] or 0) >= threshold})
