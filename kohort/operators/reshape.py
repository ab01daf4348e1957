"""One-hot decoding, constant columns, unpivoting and cross tabulation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.functions.scalars import is_numeric, parse_date, to_number
from kohort.sources.readers import with_row_order


def _active(cols: list[str], prefix: str) -> Column:
    """Levels whose dummy is set. One array expression, so hundreds of dummies do not bloat generated code."""
    entries = F.array(
        *[
            F.struct(F.lit(c[len(prefix) + 1 :]).alias("level"), F.col(f"`{c}`").try_cast("double").alias("on"))
            for c in cols
        ]
    )
    return F.filter(entries, lambda e: e["on"] > 0)["level"]


def decode_one_hot(df: DataFrame, prefix: str, baseline: str) -> DataFrame:
    """Fold ``prefix_*`` dummies into one column: none set gives the baseline, several set gives NULL."""
    cols = [c for c in df.columns if c.startswith(f"{prefix}_")]
    if not cols or prefix in df.columns:
        return df
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    level = F.when(F.size("_on") == 0, F.lit(baseline)).when(F.size("_on") == 1, F.get("_on", F.lit(0)))
    return df.select(*keep, _active(cols, prefix).alias("_on")).withColumn(prefix, level).drop("_on")


def collapse_one_hot(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Any-table form: groups were checked to be exclusive, and an empty row is ``Other``."""
    for prefix, cols in groups.items():
        present = [c for c in cols if c in df.columns]
        if not present or prefix in df.columns:
            continue
        keep = [F.col(f"`{c}`") for c in df.columns if c not in present]
        level = F.coalesce(F.get(_active(present, prefix), F.lit(0)), F.lit("Other"))
        df = df.select(*keep, level.alias(prefix))
    return df


def find_one_hot_groups(df: DataFrame) -> dict[str, list[str]]:
    """Prefixes shared by three or more exclusive 0/1 columns, found in one aggregate pass."""
    numeric = [c for c, t in df.dtypes if "_" in c and is_numeric(t)]
    if not numeric:
        return {}
    binary = df.agg(*[F.bool_and(F.coalesce(F.col(f"`{c}`").isin(0, 1), F.lit(True))).alias(f"b{i}") for i, c in enumerate(numeric)])
    by_prefix: dict[str, list[str]] = {}
    for c in numeric:
        by_prefix.setdefault(c.rsplit("_", 1)[0], []).append(c)
    candidates = {p: cs for p, cs in by_prefix.items() if len(cs) >= 3 and p not in df.columns}
    if not candidates:
        return {}
    flags = binary.first()
    by_prefix = {p: [c for c in cs if flags[f"b{numeric.index(c)}"]] for p, cs in candidates.items()}
    candidates = {p: cs for p, cs in by_prefix.items() if len(cs) >= 3}
    if not candidates:
        return {}
    total = lambda cs: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cs])
    most = df.agg(*[F.max(total(cs)).alias(f"m{i}") for i, cs in enumerate(candidates.values())]).first()
    return {p: cs for i, (p, cs) in enumerate(candidates.items()) if (most[f"m{i}"] or 0) <= 1}


def to_canonical(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Canonical customer frame: dummies decoded, enrolment date parsed, optional columns present.

    Rows get their load order, and without an ID column the IDs 1 to n in that order. With ``ordered`` false rows that have an ID
    column are not numbered, for uses that keep no first row, such as scoring.
    """
    if fv.ROW_ORDER not in df.columns and (ordered or fv.ID not in [c.strip() for c in df.columns]):
        df = with_row_order(df)
    df = df.toDF(*[c.strip() for c in df.columns])
    for prefix, baseline in fv.ONE_HOT_BASELINES.items():
        df = decode_one_hot(df, prefix, baseline)
    missing = [c for c in fv.REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Input data is missing required columns: {missing}")
    kinds = dict(df.dtypes)
    if fv.ENROLLED in kinds:
        enrolled = parse_date(F.col(fv.ENROLLED), kinds[fv.ENROLLED])
    else:
        enrolled = F.lit(None).cast("date")
    ident = to_number(F.col(fv.ID), kinds[fv.ID]).cast("long") if fv.ID in kinds else F.col(fv.ROW_ORDER) + 1
    rest = [c for c in df.columns if c not in (fv.ENROLLED, fv.ID)]
    return df.select(ident.alias(fv.ID), *[F.col(f"`{c}`") for c in rest], enrolled.alias(fv.ENROLLED))


def constant_columns(df: DataFrame, protected: list[str]) -> list[str]:
    """Known constants plus unprotected columns that hold a single value, NULL counting as one.

    Comparing minimum and maximum answers that without counting distinct values.
    """
    known = [c for c in fv.CONSTANTS if c in df.columns]
    others = [c for c in df.columns if c not in known and c not in protected]
    if not others:
        return known
    checks = []
    for i, c in enumerate(others):
        col = F.col(f"`{c}`")
        checks.append(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")).alias(f"c{i}"))
    row = df.agg(F.count("*").alias("n"), *checks).first()
    return known + [
        c
        for i, c in enumerate(others)
        if row[f"c{i}"]["n"] == 0 or (row[f"c{i}"]["n"] == row["n"] and row[f"c{i}"]["lo"] == row[f"c{i}"]["hi"])
    ]


def drop_constant_columns(df: DataFrame, protected: list[str] | None = None) -> DataFrame:
    protected = protected if protected is not None else [*fv.REQUIRED, fv.ENROLLED, fv.ROW_ORDER]
    return df.drop(*constant_columns(df, protected))


def one_hot(df: DataFrame, levels: dict[str, list[str]], weight: float = 0.5**0.5) -> DataFrame:
    """Dummies for the learned levels only; an unseen level leaves all of them at 0."""
    dummies = [
        F.when(F.col(c) == level, F.lit(weight)).otherwise(F.lit(0.0)).alias(f"{c}_{level}")
        for c, known in levels.items()
        for level in known
    ]
    return df.select("*", *dummies)


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def crosstab_share(df: DataFrame, row: str, col: str, levels: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Row-normalised percentages in long form: (row, level, share).

    ``levels`` restricts and orders nothing but the output; ``top`` keeps the most common levels overall. Shares
    are always of the whole row.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(row).alias("row"), F.col(col).cast("string").alias("level")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("row").alias("_r")).agg(F.sum("n").alias("_t"))
    out = counts.join(totals, F.col("row").eqNullSafe(F.col("_r"))).select(
        "row", "level", (F.lit(100.0) * F.col("n") / F.col("_t")).alias("share")
    )
    if levels is not None:
        out = out.filter(F.col("level").isin(*levels))
    if top is not None:
        common = counts.groupBy("level").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "level").limit(top)
        out = out.join(F.broadcast(common.select("level")), "level", "left_semi")
    return out


def crosstab_wide(df: DataFrame, row: str, col: str, levels: list[str]) -> DataFrame:
    """The same table with one column per level; absent combinations are 0."""
    long = crosstab_share(df, row, col)
    return long.groupBy("row").agg(
        *[F.coalesce(F.max(F.when(F.col("level") == l, F.col("share"))), F.lit(0.0)).alias(l) for l in levels]
    )


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Fixed-order numeric vector; a missing value is an error because imputation comes first."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def preview(df: DataFrame, cols: list[str], n: int = 6, order: str = fv.ROW_ORDER) -> DataFrame:
    """The first ``n`` rows, for the columns that exist, with the total row count beside them."""
    kept = [c for c in cols if c in df.columns]
    total = df.agg(F.count("*")).scalar().alias("total_rows")
    return df.orderBy(order).limit(n).select(*kept, total)
