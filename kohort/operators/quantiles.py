"""Exact order statistics that never gather a column in one task.

``percentile``/``median`` keep every distinct value of a group in one aggregation buffer. Here a bounded
sketch first brackets each wanted rank, and a second scan counts what lies below the bracket and orders only
the distinct values inside it (about 10/accuracy of the rows). Both scans combine on the map side, so a group
that holds a third of all rows costs the same as any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 10_000
FEW_GROUPS = 10_000
SALTS = 32


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: list[str] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """(by…, column, prob, value) by linear interpolation between order statistics.

    Columns without any value give no row.
    """
    by = by or []
    keys = [*by, "column"]
    # twice the sketch's rank error plus the gap between its rank convention and the interpolated position
    slack = 5.0 / accuracy
    brackets = [(max(0.0, p - slack), min(1.0, p + slack)) for p in probs]
    edges = sorted({0.0, 1.0} | {e for pair in brackets for e in pair})
    number = lambda c: F.col(f"`{c}`").cast("double")
    sketched = lambda c: F.struct(
        F.lit(c).alias("column"),
        F.percentile_approx(number(c), [float(e) for e in edges], accuracy).alias("cut"),
        F.count(number(c)).alias("_n"),
    )
    names = [f"_s{i}" for i in range(len(cols))]
    wide = [sketched(c).alias(n) for c, n in zip(cols, names)]
    sketches = (df.groupBy(*by).agg(*wide) if by else df.agg(*wide)).select(*by, F.inline(F.array(*names)))
    summary = sketches.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    # one (column, value) row per number, so the bracket logic is compiled once and not per column
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in cols])
    numbers = df.select(*by, F.inline(pairs)).filter(F.col("value").isNotNull())
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    # one row per group and column: broadcast while the groups are few; beyond that, rows of a group are dealt over salts
    few = not by or df.select(*by).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    if few:
        long = numbers.join(F.broadcast(summary), match)
    else:
        spread_out = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = numbers.withColumn("_at", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
        long = salted.join(spread_out, match & (F.col("_at") == F.col("_salt"))).drop("_at", "_salt")
    value = F.col("value")
    at = [F.get("cut", F.lit(j)) for j in range(len(edges))]
    # fewer rows than accuracy means less than one rank per unit of sketch error, so all of such a group is ordered
    slot, inside = F.lit(0), F.col("_n") < accuracy
    for c in at:
        slot = slot + (value >= c).cast("int")
    for lo, hi in brackets:
        inside = inside | ((value >= at[edges.index(lo)]) & (value <= at[edges.index(hi)]))
    counted = (
        long.select(*keys, "_n", slot.alias("_slot"), F.when(inside, value).alias("value"))
        .groupBy(*keys, "_n", "_slot", "value")
        .agg(F.count("*").alias("_c"))
    )
    # inside one slot the ordered values come first: an edge value may share its slot with larger, unordered ones
    order = Window.partitionBy(*keys).orderBy("_slot", F.col("value").asc_nulls_last())
    last = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    targets = F.array(
        *[
            # positions that sit on a whole rank up to rounding noise are taken as that rank
            F.struct(F.lit(float(p)).alias("prob"), F.round(F.lit(float(p)) * (F.col("_n") - 1), 9).alias("pos"))
            for p in probs
        ]
    )
    ranked = (
        counted.select(*keys, "_n", "value", "_c", last.alias("_last"))
        .filter(value.isNotNull())
        .select(*keys, "value", "_c", "_last", F.explode(targets).alias("t"))
        .select(*keys, "value", "_c", "_last", "t.prob", "t.pos")
    )
    first = F.col("_last") - F.col("_c") + 1
    holds = lambda rank: (first <= rank) & (rank <= F.col("_last"))
    return (
        ranked.filter(holds(F.floor("pos")) | holds(F.ceil("pos")))
        .groupBy(*keys, "prob", "pos")
        .agg(
            F.max(F.when(holds(F.floor("pos")), value)).alias("_lo"),
            F.max(F.when(holds(F.ceil("pos")), value)).alias("_hi"),
        )
        .select(
            *keys,
            "prob",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("pos") - F.floor("pos"))).alias("value"),
        )
    )


def quantile_columns(
    df: DataFrame, wanted: dict[str, tuple[str, float]], by: list[str] | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """One row per group with a column for each ``{alias: (column, prob)}``."""
    by = by or []
    cols = sorted({c for c, _ in wanted.values()})
    probs = sorted({float(p) for _, p in wanted.values()})
    long = exact_quantiles(df, cols, probs, by, accuracy)
    picks = [
        F.max(F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("value"))).alias(alias)
        for alias, (c, p) in wanted.items()
    ]
    return long.groupBy(*by).agg(*picks) if by else long.agg(*picks)


def fitted_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[tuple[str, float], float]:
    """Learned constants for estimators; the result has ``len(cols) * len(probs)`` rows."""
    rows = exact_quantiles(df, cols, probs).collect()
    return {(r["column"], r["prob"]): r["value"] for r in rows}


def rank_edges(df: DataFrame, cols: list[str], pieces: int = 1024) -> dict[str, list[float]]:
    """Cut points that split each column into chunks of similar size (a bounded list per column)."""
    probs = [i / pieces for i in range(1, pieces)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, ACCURACY).alias(c) for c in cols]).first()
    return {c: sorted(set(row[c] or [])) for c in cols}


def average_ranks(df: DataFrame, col: str, edges: list[float] | None = None) -> DataFrame:
    """(value, rank) for every distinct value of ``col``; tied rows share the mean of their positions.

    Counting distinct values first folds ties on the map side; the running count is then taken inside
    chunks of the value range and shifted by the chunk totals, so there is no global sort in one task.
    """
    edges = rank_edges(df, [col])[col] if edges is None else edges
    value = F.col(col).cast("double")
    counts = df.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("_c"))
    splits = [-float("inf"), *edges, float("inf")]
    chunked = Bucketizer(splits=splits, inputCol="value", outputCol="_chunk").transform(counts) if edges else counts.withColumn("_chunk", F.lit(0.0))
    # one row per chunk, at most len(edges) + 1 of them
    totals = chunked.groupBy("_chunk").agg(F.sum("_c").alias("_t"))
    before = totals.select(
        F.col("_chunk").alias("_b"),
        (F.sum("_t").over(Window.orderBy("_chunk")) - F.col("_t")).alias("_before"),
    )
    inside = Window.partitionBy("_chunk").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = chunked.withColumn("_upto", F.sum("_c").over(inside))
    return running.join(before, F.col("_chunk") == F.col("_b")).select(
        "value",
        (F.col("_before") + F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / F.lit(2.0)).alias("rank"),
    )


def rank_pct(df: DataFrame, col: str, alias: str = "rank_pct") -> DataFrame:
    """``df`` with the average rank of ``col`` divided by the number of non-missing rows."""
    ranks = average_ranks(df, col).select(F.col("value").alias("_v"), "rank")
    total = df.agg(F.count(col)).scalar()
    joined = df.join(ranks, F.col(col).cast("double") == F.col("_v"), "left")
    return joined.withColumn(alias, F.col("rank") / total.cast("double")).drop("_v", "rank")
