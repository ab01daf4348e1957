"""Exploratory aggregations over the whole customer table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.operators.quantiles import average_ranks, exact_quantiles, quantile_columns, rank_edges


def shares_of_total(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """(name, share): each column's part of the sum over all of them."""
    sums = df.agg(*[F.sum(c).alias(name) for c, name in cols.items()])
    total = sum([F.col(n) for n in list(cols.values())[1:]], F.col(list(cols.values())[0]))
    wide = sums.select(*[F.try_divide(F.col(n), total).alias(n) for n in cols.values()])
    return wide.unpivot([], list(cols.values()), "name", "share")


def spend_shares(df: DataFrame) -> DataFrame:
    return shares_of_total(df, {c: c.replace("Mnt", "") for c in fv.SPEND})


def channel_shares(df: DataFrame) -> DataFrame:
    return shares_of_total(df, dict(zip(fv.CHANNELS, ["Web", "Catalog", "Store"])))


def quantile_edges(df: DataFrame, col: str, parts: int) -> list[float]:
    """Bin edges with repeated ones dropped (``parts + 1`` numbers at most)."""
    inner = [i / parts for i in range(1, parts)]
    rows = exact_quantiles(df, [col], inner).collect()
    ends = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    return sorted({ends[0], ends[1], *[r["value"] for r in rows]})


def quantile_bin(col: str, edges: list[float]):
    """Right-closed bin number from 0, the lowest edge included; tied values share a bin."""
    c = F.col(col)
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (c > F.lit(e)).cast("int")
    return F.when(c.isNotNull(), out)


def mean_by_quantile(df: DataFrame, by: str, value: str, parts: int) -> DataFrame:
    edges = quantile_edges(df, by, parts)
    return df.groupBy(quantile_bin(by, edges).alias("bin")).agg(F.avg(value).alias(f"avg_{value}"), F.count("*").alias("customers"))


def top_share(df: DataFrame, col: str = "Total_Spend", q: float = 0.8) -> DataFrame:
    """One row: part of the total held by rows at or above the ``q`` quantile."""
    cut = exact_quantiles(df, [col], [q]).select(F.col("value").alias("_cut")).scalar()
    flagged = df.select(F.col(col).alias("v"), (F.col(col) >= cut).alias("top"))
    return flagged.agg((F.sum(F.when(F.col("top"), F.col("v"))) / F.sum("v")).alias("top_share"))


def campaign_rates(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.avg(c).alias(c) for c in fv.CAMPAIGNS])
    return wide.unpivot([], fv.CAMPAIGNS, "campaign", "acceptance_rate")


def accepted_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("Campaigns_Accepted").cast("int").alias("accepted")).agg(F.count("*").alias("customers"))


def engagement_rates(df: DataFrame) -> DataFrame:
    rate = lambda cond, name: F.avg(cond.cast("double")).alias(name)
    return df.agg(
        rate(F.col("Campaigns_Accepted") == 0, "never_accepted"),
        F.avg("Complain").alias("complaint_rate"),
        rate(F.col("NumDealsPurchases") > 0, "bought_on_deal"),
    )


def purchases_by_visits(df: DataFrame, pooled_from: int = 10) -> DataFrame:
    bucket = F.least(F.col("NumWebVisitsMonth"), F.lit(float(pooled_from))).cast("int")
    return df.groupBy(bucket.alias("visits")).agg(
        F.avg("NumWebPurchases").alias("avg_web_purchases"), F.avg("Total_Purchases").alias("avg_purchases"), F.count("*").alias("customers")
    )


def spearman(df: DataFrame, cols: list[str], key: str = fv.ID) -> DataFrame:
    """(a, b, rho) for every pair: Pearson correlation of the average ranks among the rows that have both values.

    Columns without missing values share one ranking; a pair with gaps is ranked on its complete rows.
    """
    gaps = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    whole = [c for i, c in enumerate(cols) if not gaps[f"g{i}"]]
    out = _complete_spearman(df, whole) if len(whole) > 1 else None
    for a, b in combinations(cols, 2):
        if a not in whole or b not in whole:
            has = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
            rows = df.filter(has(a) & has(b))
            one = _complete_spearman(rows, [a, b])
            out = one if out is None else out.unionByName(one)
    return out


def _complete_spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """``spearman`` without missing values.

    Ranks are computed once per distinct value and joined back on the value; a frequent value has one row on
    the rank side, and adaptive execution splits it on the row side.
    """
    edges = rank_edges(df, cols)
    ranked = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    for c in cols:
        ranks = average_ranks(df, c, edges[c]).select(F.col("value").alias(f"_v_{c}"), F.col("rank").alias(f"_r_{c}"))
        ranked = ranked.join(ranks, F.col(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    pairs = list(combinations(cols, 2))
    # the correlation of a constant column is undefined
    row = ranked.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(F.col(f"p{i}"), F.lit(None).cast("double")).alias("rho")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(table))


def strongest_pairs(rho: DataFrame, n: int = 8) -> DataFrame:
    return rho.orderBy(F.desc_nulls_last(F.abs("rho")), "a", "b").limit(n)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n): fixed-width bins over the range, the top edge in the last bin; empty bins included."""
    ends = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((F.col(col).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def spend_quartiles_by(df: DataFrame, by: str = "Children") -> DataFrame:
    return quantile_columns(df, {"q1": ("Total_Spend", 0.25), "median": ("Total_Spend", 0.5), "q3": ("Total_Spend", 0.75)}, [by])
