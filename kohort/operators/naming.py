"""Archetype scores, one-to-one naming, recommendations and RFM personas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kohort import fixed_values as fv
from kohort.operators import profiles as P, ranking as R


def archetype_table(spark: SparkSession) -> DataFrame:
    rows = [(name, c, float(w)) for name, weights in ((a["name"], a["weights"]) for a in fv.ARCHETYPES) for c, w in weights.items()]
    return spark.createDataFrame(rows, "name string, column string, weight double")


def playbook_table(spark: SparkSession) -> DataFrame:
    rows = [(a["name"], a["summary"], a["goal"], a["actions"], a["kpis"], a["guardrail"]) for a in fv.ARCHETYPES]
    return spark.createDataFrame(
        rows, "name string, summary string, goal string, actions array<string>, kpis array<string>, responsible_use string"
    )


def rfm_playbook_table(spark: SparkSession) -> DataFrame:
    rows = [(p["persona"], p["objective"], p["actions"]) for p in fv.RFM_PLAYBOOK]
    return spark.createDataFrame(rows, "Persona string, objective string, actions array<string>")


def attach_segment_names(df: DataFrame, names: DataFrame, segment: str = "Segment") -> DataFrame:
    """Names are one row per segment id."""
    return df.join(F.broadcast(names), segment)


def attach_playbook(df: DataFrame, name: str = "Segment_Name") -> DataFrame:
    book = playbook_table(df.sparkSession).withColumnRenamed("name", "_name")
    return df.join(F.broadcast(book), F.col(name) == F.col("_name"), "left").drop("_name")


def archetype_scores(z: DataFrame, segment: str = "Segment") -> DataFrame:
    """(segment, name, score) from a (segment, column, z) table."""
    weights = F.broadcast(archetype_table(z.sparkSession))
    return z.join(weights, "column").groupBy(segment, "name").agg(F.sum(F.col("weight") * F.col("z")).alias("score"))


def name_segments(scores: DataFrame, segments: DataFrame, segment: str = "Segment") -> DataFrame:
    """(segment, Segment_Name): the one-to-one naming with the highest total score.

    Works through the segments in order and keeps, per set of used names, only the best total so far, so there
    are at most 2^10 states per step. With more segments than names, each segment may also stay unnamed.
    """
    names = sorted(a["name"] for a in fv.ARCHETYPES)
    ids = [r[0] for r in segments.select(segment).distinct().orderBy(segment).collect()]
    bit_of = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)])
    spark = scores.sparkSession
    spare = max(0, len(ids) - len(names))
    options = scores.select(segment, "name", "score", F.try_element_at(bit_of, F.col("name")).alias("bit"))
    state = spark.createDataFrame([(0, 0, 0.0, [])], "mask int, blanks int, total double, picks array<string>")
    for s in ids:
        here = options.filter(F.col(segment) == s).select("name", "score", "bit")
        if spare:
            none = spark.createDataFrame([(f"Segment {s}", 0.0, 0)], "name string, score double, bit int")
            here = here.unionByName(none)
        grown = state.join(F.broadcast(here), F.col("mask").bitwiseAND(F.col("bit")) == 0).select(
            F.col("mask").bitwiseOR(F.col("bit")).alias("mask"),
            (F.col("blanks") + (F.col("bit") == 0).cast("int")).alias("blanks"),
            (F.col("total") + F.col("score")).alias("total"),
            F.concat("picks", F.array("name")).alias("picks"),
        )
        state = (
            grown.filter(F.col("blanks") <= spare)
            .groupBy("mask", "blanks")
            .agg(F.max(F.struct("total", "picks")).alias("best"))
            .select("mask", "blanks", "best.total", "best.picks")
        )
    best = state.agg(F.max_by("picks", F.struct("total", "picks")).alias("picks"))
    order = F.array(*[F.lit(i) for i in ids])
    return best.select(F.inline(F.arrays_zip(order.alias(segment), F.col("picks").alias("Segment_Name"))))


def recommendations(df: DataFrame, z: DataFrame) -> DataFrame:
    """One row per segment: playbook, defining traits, preferred channel and over-indexed categories."""
    names = df.groupBy("Segment", "Segment_Name").agg(F.count("*").alias("customers"))
    channels = P.channel_mix(df)
    categories = R.over_indexed(P.category_mix(df), P.overall_category_mix(df))
    best = categories.groupBy("Segment").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "category"))), lambda s: s["category"]).alias("over_indexed_categories")
    )
    # every side has one row per segment
    joined = (
        names.join(R.trait_lists(R.top_traits(z)), "Segment", "left")
        .join(R.preferred_channel(channels), "Segment", "left")
        .join(channels, "Segment", "left")
        .join(best, "Segment", "left")
    )
    empty = F.array().cast("array<string>")
    return attach_playbook(joined).withColumns(
        {c: F.coalesce(F.col(c), empty) for c in ("defining_high_traits", "defining_low_traits", "over_indexed_categories", "actions", "kpis")}
    )


def rfm_personas(clustered: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """(cluster, Persona): business descriptions from relative cluster means (a table of k rows)."""
    measures = ["Recency", "Frequency", "Monetary"]
    means = clustered.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in measures])
    return personas_from_means(means, cluster)


def personas_from_means(means: DataFrame, cluster: str = "Cluster") -> DataFrame:
    every = Window.partitionBy()  # k rows

    def rank(c):
        below = F.rank().over(Window.partitionBy().orderBy(c))
        ties = F.count("*").over(Window.partitionBy(c))
        return (below + (ties - 1) / F.lit(2.0)) / F.count("*").over(every)

    scored = means.withColumn("_score", rank("Frequency") + rank("Monetary") - rank("Recency"))
    vip = F.max_by(cluster, F.struct(F.col("_score"), (-F.col(cluster)).alias("i"))).over(every)
    flagged = scored.withColumn("_vip", vip)
    rest = F.col(cluster) != F.col("_vip")
    risk = F.max(F.when(rest, F.struct(F.col("Recency").alias("r"), (-F.col(cluster)).alias("i")))).over(every)
    # the median of k cluster means is taken inside the k-row table
    medians = {f"_{c}": F.median(c).over(every) for c in ("Frequency", "Monetary")}
    named = flagged.withColumns({"_risk": -risk["i"], **medians})
    persona = (
        F.when(F.col(cluster) == F.col("_vip"), "VIP Heavy Spenders")
        .when(F.col(cluster) == F.col("_risk"), "At-Risk Customers")
        .when(F.col("Frequency") >= F.col("_Frequency"), "Loyal Frequent Buyers")
        .when(F.col("Monetary") <= F.col("_Monetary"), "Low-Value / New Customers")
        .otherwise("Casual Shoppers")
    )
    return named.select(cluster, persona.alias("Persona"))


def draft_vs_live(draft: DataFrame, draft_silhouette: float, live_k: int, live_silhouette: float) -> DataFrame:
    """Draft segment shares beside the live model's size and quality."""
    return draft.select(
        "Segment",
        "Segment_Name",
        "Customer_Share_%",
        "Revenue_Share_%",
        "Avg_Total_Spend",
        F.lit(draft_silhouette).alias("draft_silhouette"),
        F.lit(live_k).alias("live_k"),
        F.lit(live_silhouette).alias("live_silhouette"),
    )
