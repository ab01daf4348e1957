"""Canonical customer frame derived from the transaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kohort import fixed_values as fv
from kohort.sources.readers import read_parquet

SPEND_TYPES = dict(zip(["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], fv.SPEND))
EDUCATION_OF = {
    "AUTOMOBILE": "Basic",
    "BUILDING": "Graduation",
    "FURNITURE": "2n Cycle",
    "HOUSEHOLD": "Master",
    "MACHINERY": "PhD",
}
MARITAL_OF = {
    "AFRICA": "Married",
    "AMERICA": "Together",
    "ASIA": "Single",
    "EUROPE": "Divorced",
    "MIDDLE EAST": "Widow",
}


def order_lines(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One row per order: spend by part type and whether any line was discounted.

    ``part`` is broadcast by the planner while it is small. Beyond that the join shuffles on the part key, and
    adaptive execution splits a part that is sold in a large share of all lines. The group-by then combines
    on the map side, and its partitioning by order serves the join in ``purchase_history``.
    """
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = lineitem.select("l_orderkey", "l_partkey", revenue.alias("revenue"), (F.col("l_discount") >= 0.08).alias("deal"))
    typed = lines.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return typed.groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("p_type") == t, F.col("revenue"))).alias(c) for t, c in SPEND_TYPES.items()],
        F.bool_or("deal").alias("on_deal"),
    )


def purchase_history(orders: DataFrame, per_order: DataFrame) -> DataFrame:
    """One row per ordering customer; every measure combines on the map side, so a dominant customer is cheap."""
    status = F.col("o_orderstatus")
    day = F.col("o_orderdate").cast("date")
    joined = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_custkey").agg(
        F.max(day).alias("last_order"),
        F.min(day).alias("first_order"),
        *[F.sum(c).alias(c) for c in fv.SPEND],
        F.count_if("on_deal").alias("NumDealsPurchases"),
        *[F.count_if(status == s).alias(c) for s, c in zip("POF", fv.CHANNELS)],
        *[F.count_if(F.col("o_orderpriority").startswith(f"{i}-")).alias(f"pri{i}") for i in range(1, 6)],
    )


def build_customer_360(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: read_parquet(spark, folder, name)
    history = purchase_history(t("orders"), order_lines(t("lineitem"), t("part")))
    activity = t("events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.max((F.col("event_type") == "signup").cast("int")).alias("signed_up"),
        F.max((F.col("event_type") == "error").cast("int")).alias("had_error"),
    )
    # 25 nations and 5 regions whatever the scale
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "r_name"
    )
    latest = t("orders").agg(F.max(F.col("o_orderdate").cast("date"))).scalar()
    key = F.col("c_custkey")
    base = (
        t("customer")
        .join(history, key == F.col("o_custkey"), "left")
        .join(activity, key == F.col("user_id"), "left")
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    label = lambda c, table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c))
    return base.select(
        key.alias(fv.ID),
        (1940 + (key * 37) % 60).cast("double").alias("Year_Birth"),
        F.col("c_acctbal").alias("Income"),
        (key % 3).cast("double").alias("Kidhome"),
        (F.floor(key / 3) % 2).cast("double").alias("Teenhome"),
        F.date_diff(latest, F.col("last_order")).cast("double").alias("Recency"),
        # amounts have four decimals; rounding there removes summation-order noise
        *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c) for c in fv.SPEND],
        whole("NumDealsPurchases").alias("NumDealsPurchases"),
        *[whole(c).alias(c) for c in fv.CHANNELS],
        whole("views").alias("NumWebVisitsMonth"),
        *[(F.coalesce(F.col(f"pri{i}"), F.lit(0)) >= 4).cast("double").alias(f"AcceptedCmp{i}") for i in range(1, 6)],
        whole("signed_up").alias("Response"),
        whole("had_error").alias("Complain"),
        label("c_mktsegment", EDUCATION_OF).alias("Education"),
        label("r_name", MARITAL_OF).alias("Marital_Status"),
        F.col("first_order").alias(fv.ENROLLED),
        key.alias(fv.ROW_ORDER),
    )
