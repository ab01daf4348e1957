"""Column audits and table profiles, each in one or two scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.functions.scalars import finite, is_numeric
from kohort.operators.filters import known, spend_without_purchase
from kohort.operators.impute import value_counts
from kohort.operators.prep import corrected_skewness
from kohort.operators.quantiles import exact_quantiles
from kohort.operators.ranking import top_values


def distinct_counts(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by…, column, distinct): values are counted in parallel per (column, value), not per column."""
    by = by or []
    return value_counts(df, cols, by).groupBy(*by, "column").agg(F.count("*").alias("distinct"))


def audit_quality(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, dtype, missing, missing_pct, distinct, skewness), most missing and most skewed first."""
    cols = cols or [c for c in df.columns if c != fv.ROW_ORDER]
    kinds = dict(df.dtypes)
    n = F.count("*")
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("dtype"),
                (n - F.count(c)).alias("missing"),
                F.bround((n - F.count(c)) / n * 100, 2).alias("missing_pct"),
                (F.bround(corrected_skewness(c), 2) if is_numeric(kinds[c]) else F.lit(None).cast("double")).alias("skewness"),
            ).alias(f"c{i}")
            for i, c in enumerate(cols)
        ]
    )
    stats = wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(cols))])))
    return (
        stats.join(distinct_counts(df, cols), "column", "left")
        .select("column", "dtype", "missing", "missing_pct", F.coalesce("distinct", F.lit(0)).alias("distinct"), "skewness")
        .orderBy(F.desc("missing"), F.desc_nulls_last("skewness"), "column")
    )


def _numeric_view(df, c, kinds):
    return finite(F.col(f"`{c}`").try_cast("double")) if kinds[c] not in ("date", "timestamp", "timestamp_ntz") else F.lit(None).cast("double")


def table_profile(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """(column, missing, distinct, type, mean, min, max, top) for any table; ``top`` shows 40 characters of a value."""
    kinds = dict(df.dtypes)
    cols = [c for c in df.columns if not kinds[c].startswith(("array", "map", "struct"))][:max_columns]
    n = F.count("*")
    num = {c: _numeric_view(df, c, kinds) for c in cols}
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (n - F.count(f"`{c}`")).alias("missing"),
                F.count(f"`{c}`").alias("present"),
                F.count(num[c]).alias("parsed"),
                F.avg(num[c]).alias("mean"),
                F.min(num[c]).alias("min"),
                F.max(num[c]).alias("max"),
            ).alias(f"c{i}")
            for i, c in enumerate(cols)
        ]
    )
    stats = wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(cols))])))
    counts = value_counts(df, cols)
    distinct = counts.groupBy("column").agg(F.count("*").alias("distinct"))
    listed = (
        top_values(counts, 4, ["column"])
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("position", F.format_string("%s (%d)", F.substring("value", 1, 40), F.col("n")).alias("text")))).alias("t"))
        .select("column", F.array_join(F.transform("t", lambda s: s["text"]), ", ").alias("top"))
    )
    number = (F.col("parsed") >= 0.9 * F.col("present")) & (F.col("parsed") >= 1)
    shown = lambda c: F.when(number, F.bround(c, 3)).alias(c)
    return (
        stats.join(distinct, "column", "left")
        .join(listed, "column", "left")
        .select(
            "column",
            "missing",
            F.coalesce("distinct", F.lit(0)).alias("distinct"),
            F.when(number, "number").otherwise("text").alias("type"),
            shown("mean"),
            shown("min"),
            shown("max"),
            F.when(~number, F.col("top")).alias("top"),
        )
    )


def analyze_table(df: DataFrame, renames: dict[str, str] | None = None) -> dict:
    """Summary of an uploaded table: size, renames, missing columns and values, duplicates, compatibility."""
    from kohort.operators.dedup import count_duplicates
    from kohort.sources.columns import missing_columns

    cols = [c for c in df.columns if c != fv.ROW_ORDER]
    present = [c for c in [*fv.REQUIRED, fv.ENROLLED] if c in cols]
    numbers = [c for c in ("Income", "MntWines", "MntMeatProducts", "Recency") if c in cols]
    kinds = dict(df.dtypes)
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"miss_{c}") for c in present],
        *[F.bround(f(_numeric_view(df, c, kinds)), 1).alias(f"{name}_{c}") for c in numbers for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
    ).first()
    missing = missing_columns(df)
    return {
        "rows": row["rows"],
        "columns": len(cols),
        "renamed": renames or {},
        "missing_columns": missing,
        "optional_missing": missing_columns(df, [fv.ENROLLED]),
        "missing_values": {c: row[f"miss_{c}"] for c in present if row[f"miss_{c}"]},
        "duplicate_rows": count_duplicates(df, cols).first()["duplicates"],
        "numeric_summary": [{"column": c, **{k: row[f"{k}_{c}"] for k in ("mean", "min", "max")}} for c in numbers],
        "compatible": not missing,
    }


def match_column(df: DataFrame, wanted: str) -> str:
    """Column whose name agrees apart from case, spaces and underscores."""
    key = lambda s: " ".join(str(s).replace("_", " ").split()).lower()
    found = next((c for c in df.columns if key(c) == key(wanted)), None)
    if found is None:
        raise KeyError(f"Unknown column '{wanted}'.")
    return found


def numeric_column_stats(df: DataFrame, column: str, segment: str = "Segment_Name") -> DataFrame:
    """(segment, count, mean, std, min, median, max): the segment is NULL on the overall line."""
    c = match_column(df, column)
    wide = df.groupingSets([[], [segment]], segment).agg(
        F.grouping(segment).alias("_all"),
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max"),
    )
    medians = exact_quantiles(df, [c], [0.5], [segment]).select(F.col(segment).alias("_s"), F.lit(0).alias("_a"), F.col("value").alias("median"))
    overall = exact_quantiles(df, [c], [0.5]).select(F.lit(None).cast("string").alias("_s"), F.lit(1).alias("_a"), F.col("value").alias("median"))
    match = F.col(segment).eqNullSafe(F.col("_s")) & (F.col("_all") == F.col("_a"))
    joined = wide.join(medians.unionByName(overall), match, "left")
    return joined.select(segment, "count", *[F.bround(x, 4).alias(x) for x in ("mean", "std", "min", "median", "max")])


def text_column_stats(df: DataFrame, column: str, segment: str = "Segment_Name", k: int = 6) -> DataFrame:
    """(segment, value, n): the most common values per segment and overall (segment NULL)."""
    c = match_column(df, column)
    counts = (
        df.filter(F.col(c).isNotNull())
        .groupingSets([[F.col(c)], [F.col(segment), F.col(c)]], F.col(segment), F.col(c))
        .agg(F.count("*").alias("n"))
        .select(segment, F.col(c).cast("string").alias("value"), "n")
    )
    return top_values(counts, k, [segment]).select(segment, "value", "n")


def quality_checks(df: DataFrame) -> DataFrame:
    """One row of eight defect counts; duplicates are counted by folding, not by sorting."""
    cols = [c for c in df.columns if c != fv.ROW_ORDER]
    profile = [c for c in cols if c != fv.ID]
    cells = sum([F.count_if(F.col(c).isNull()) for c in cols[1:]], F.count_if(F.col(cols[0]).isNull()))
    constant = sum([(F.coalesce(F.min(c) == F.max(c), F.lit(False))).cast("int") for c in cols[1:]], (F.coalesce(F.min(cols[0]) == F.max(cols[0]), F.lit(False))).cast("int"))
    repeated = lambda keys: df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    base = df.agg(
        cells.alias("missing_cells"),
        F.count_if(known(F.col("Year_Birth") < 1920)).alias("born_before_1920"),
        F.count_if(known(F.col("Income") > 200_000)).alias("income_above_200k"),
        F.count_if(spend_without_purchase()).alias("spend_without_purchase"),
        constant.alias("constant_columns"),
    )
    return base.select(
        "*",
        repeated(cols).alias("exact_duplicates"),
        repeated([fv.ID]).alias("id_duplicates"),
        repeated(profile).alias("profile_duplicates"),
    )


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q1, median, q3, max) with exact quartiles."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(f"c{i}")
            for i, c in enumerate(cols)
        ]
    ).select(F.inline(F.array(*[f"c{i}" for i in range(len(cols))])))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(a) for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    return stats.join(q, "column", "left").select("column", "count", "mean", "std", "min", "q1", "median", "q3", "max")
