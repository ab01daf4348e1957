"""Top-n traits, superlatives and comparisons over small segment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kohort import fixed_values as fv


def top_traits(z: DataFrame, n: int = 3, limit: float = 0.2, segment: str = "Segment", skip: list[str] | None = None) -> DataFrame:
    """(segment, column, z, side, position): strongest columns above ``limit`` and below ``-limit``."""
    skip = fv.CATEGORY_SHARES if skip is None else skip
    kept = z.filter(~F.col("column").isin(*skip)) if skip else z
    up = Window.partitionBy(segment).orderBy(F.desc("z"), "column")
    down = Window.partitionBy(segment).orderBy(F.asc("z"), "column")
    high = kept.withColumn("position", F.row_number().over(up)).filter((F.col("position") <= n) & (F.col("z") > limit))
    low = kept.withColumn("position", F.row_number().over(down)).filter((F.col("position") <= n) & (F.col("z") < -limit))
    return high.withColumn("side", F.lit("high")).unionByName(low.withColumn("side", F.lit("low")))


def trait_lists(traits: DataFrame, segment: str = "Segment") -> DataFrame:
    """(segment, defining_high_traits, defining_low_traits) as ordered text arrays."""
    text = F.format_string("%s (%+.1f sd)", F.col("column"), F.col("z"))
    pick = lambda side: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("position", text.alias("text"))))),
        lambda s: s["text"],
    )
    return traits.groupBy(segment).agg(
        pick("high").alias("defining_high_traits"), pick("low").alias("defining_low_traits")
    )


def over_indexed(mix: DataFrame, overall: DataFrame, n: int = 2, segment: str = "Segment") -> DataFrame:
    """(segment, category, ratio, position): categories whose share exceeds the overall share most."""
    names = [c for c in overall.columns]
    long = mix.unpivot([segment], names, "category", "share")
    base = overall.unpivot([], names, "category", "base")
    w = Window.partitionBy(segment).orderBy(F.desc_nulls_last("ratio"), "category")
    return (
        long.join(F.broadcast(base), "category")
        .select(segment, "category", F.try_divide(F.col("share"), F.col("base")).alias("ratio"))
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= n)
    )


def preferred_channel(mix: DataFrame, segment: str = "Segment") -> DataFrame:
    """(segment, preferred_channel): the largest share, the first of Web, Catalog, Store on ties."""
    best = F.greatest("Web", "Catalog", "Store")
    return mix.select(
        segment, F.when(F.col("Web") == best, "Web").when(F.col("Catalog") == best, "Catalog").otherwise("Store").alias("preferred_channel")
    )


def superlative(profiles: DataFrame, word: str, lowest: bool = False) -> DataFrame:
    """(position, Segment, Segment_Name, value): ranking of segments for a metric named by a keyword."""
    metric = fv.METRIC_WORDS.get(word, word)
    order = F.asc(metric) if lowest else F.desc(metric)
    w = Window.partitionBy().orderBy(order, "Segment")  # one row per segment
    return profiles.select(
        F.row_number().over(w).alias("position"), "Segment", "Segment_Name", F.col(metric).cast("double").alias("value")
    )


def superlative_answers(questions: DataFrame, text: str, profiles: DataFrame) -> DataFrame:
    """``questions`` with metric, lowest, Segment, Segment_Name and value of the segment that each asks for.

    A question asks for a segment, holds a metric's word (the first of the list that occurs, inside longer words too) and a word for
    high or low; low wins over high. For others all five are null. Ties go to the lower segment, and metrics without values have
    no answer. ``profiles`` is one row per segment.
    """
    said = F.lower(F.col(text))
    metric = F.coalesce(*[F.when(said.contains(w), F.lit(m)) for w, m in fv.METRIC_WORDS.items()])
    low = said.rlike("|".join(fv.LOWEST_WORDS))
    asks = said.rlike(fv.ASKS_FOR_SEGMENT) & metric.isNotNull() & (low | said.rlike("|".join(fv.HIGHEST_WORDS)))
    asked = questions.withColumns({"metric": F.when(asks, metric), "lowest": F.when(asks, low)})
    metrics = sorted(set(fv.METRIC_WORDS.values()))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics]))
    long = profiles.select("Segment", "Segment_Name", cells.alias("c")).where("c.value is not null")
    place = F.struct("Segment", "Segment_Name", F.col("c.value").alias("value"))
    ends = long.groupBy(F.col("c.metric").alias("metric")).agg(
        F.min_by(place, F.struct("c.value", "Segment")).alias("low"), F.max_by(place, F.struct("c.value", -F.col("Segment"))).alias("high")
    )
    answer = F.when(F.col("lowest"), F.col("low")).otherwise(F.col("high"))
    return asked.join(ends, "metric", "left").withColumn("_answer", answer).select(
        *questions.columns, "metric", "lowest", *[F.col("_answer").getField(c).alias(c) for c in ("Segment", "Segment_Name", "value")]
    )


def compare_segments(profiles: DataFrame, segments: list[int]) -> DataFrame:
    """(metric, one column per segment) for up to four segments."""
    if not 1 <= len(segments) <= 4:
        raise ValueError("Compare one to four segments.")
    values = profiles.select("Segment", *[F.col(m).cast("double").alias(m) for m in fv.COMPARE_METRICS])
    long = values.unpivot(["Segment"], fv.COMPARE_METRICS, "metric", "value")
    return long.groupBy("metric").agg(*[F.max(F.when(F.col("Segment") == s, F.col("value"))).alias(f"segment_{s}") for s in segments])


def top_values(counts: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The ``k`` most common values per group of a (by…, value, n) table, alphabetical on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def scatter_sample(df: DataFrame, x: str, y: str, key: str = fv.ID, segments: list[int] | None = None, n: int = 2_500, seed: int = 0) -> DataFrame:
    """Plot points: at most ``n`` rows by hash order, coordinates to three decimals."""
    rows = df.filter(F.col("Segment").isin(*segments)) if segments else df
    picked = rows.select(key, "Segment", x, y).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return picked.select(F.bround(x, 3).alias("x"), F.bround(y, 3).alias("y"), "Segment", F.col(key).alias("id"))
