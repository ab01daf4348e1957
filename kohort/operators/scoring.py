"""Scoring new rows: pure projections over literal model constants."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.functions import scalars as S
from kohort.operators.kmeans import distance_array, nearest


def prepare_for_scoring(df: DataFrame) -> DataFrame:
    """Parse and bound raw customer columns; no row is dropped."""
    missing = [c for c in fv.NUMERIC if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns for scoring: {missing}")
    kinds = dict(df.dtypes)
    fixed = {c: S.null_negative((S.to_flag if c in fv.FLAGS else S.to_number)(F.col(c), kinds[c])) for c in fv.NUMERIC}
    if fv.ENROLLED in kinds:
        fixed[fv.ENROLLED] = S.parse_date(F.col(fv.ENROLLED), kinds[fv.ENROLLED])
    else:
        fixed[fv.ENROLLED] = F.lit(None).cast("date")
    purchases = S.row_sum([F.col(c) for c in fv.CHANNELS])
    return df.withColumns(fixed).withColumn("NumDealsPurchases", S.cap_at(F.col("NumDealsPurchases"), purchases))


def assignment_margin(distances: Column) -> Column:
    """1 - nearest / second nearest; a second distance of 0 counts as 1, and so does a missing one."""
    ordered = F.array_sort(distances)
    second = F.coalesce(F.get(ordered, F.lit(1)), F.get(ordered, F.lit(0)))
    return 1 - F.get(ordered, F.lit(0)) / F.when(second == 0, F.lit(1.0)).otherwise(second)


def fit_label(margin: Column) -> Column:
    return F.when(margin >= 0.25, "clear").when(margin >= 0.1, "moderate").otherwise("borderline")


def with_distances(df: DataFrame, cols: list[str], centers) -> DataFrame:
    return df.withColumn("distances", distance_array(cols, centers))


def predict(df: DataFrame, cols: list[str], centers, names: list[str]) -> DataFrame:
    """Adds segment, name, rounded distance and margin to already scaled rows; no shuffle, no Python."""
    d = F.col("distances")
    label = F.array(*[F.lit(n) for n in names])
    return (
        with_distances(df, cols, centers)
        .withColumn("Segment", nearest(d))
        .withColumns(
            {
                "Segment_Name": F.get(label, F.col("Segment")),
                "Distance_To_Centroid": F.bround(F.array_min(d), 3),
                "Assignment_Margin": F.bround(assignment_margin(d), 3),
            }
        )
    )


def predict_rfm(df: DataFrame, prep, cols: list[str], medians: dict[str, float], centers, personas: dict[int, str]) -> DataFrame:
    """Assign rows that only bring Recency, Frequency and Monetary; other model columns take training medians."""
    filled = df.withColumns({c: F.lit(float(medians.get(c, 0.0))) for c in cols if c not in df.columns})
    names = [personas.get(i, f"Cluster {i}") for i in range(len(centers))]
    scored = predict(prep.transform(filled), cols, centers, names)
    return scored.withColumnsRenamed({"Segment": "Cluster", "Segment_Name": "Persona"})


@dataclass
class Projection:
    """Principal components of centred columns. The sign of a component carries no meaning."""

    cols: list[str]
    means: list[float]
    components: np.ndarray
    variance: list[float]

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], n: int = 3) -> "Projection":
        n = min(n, len(cols))
        means = list(df.agg(*[F.avg(c).alias(c) for c in cols]).first())
        centred = df.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(cols, means)])
        vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(centred).select("v")
        model = PCA(k=n, inputCol="v", outputCol="p").fit(vectors)
        return cls(cols, means, model.pc.toArray(), [float(v) for v in model.explainedVariance.toArray()])

    def coordinates(self, names: list[str] | None = None, width: int | None = None) -> list[Column]:
        n = self.components.shape[1]
        names = names or [f"PCA{i + 1}" for i in range(width or n)]
        out = []
        for i, name in enumerate(names):
            if i >= n:
                out.append(F.lit(0.0).alias(name))
                continue
            terms = [(F.col(c) - F.lit(m)) * F.lit(float(w)) for c, m, w in zip(self.cols, self.means, self.components[:, i])]
            out.append(sum(terms[1:], terms[0]).alias(name))
        return out

    def transform(self, df: DataFrame, width: int | None = None) -> DataFrame:
        return df.select("*", *self.coordinates(width=width))

    def project(self, centers: np.ndarray) -> np.ndarray:
        return (np.asarray(centers) - np.asarray(self.means)) @ self.components
