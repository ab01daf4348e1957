"""Behavioural and RFM features, and the estimator that learns their reference date."""

from __future__ import annotations

import datetime as dt

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.functions import scalars as S


def engineer_features(df: DataFrame, reference_date) -> DataFrame:
    """All derived columns in two projections: totals first, then everything that divides by them."""
    col = F.col
    ref = F.lit(reference_date).cast("date")
    totals = {
        "Total_Spend": S.row_sum([col(c) for c in fv.SPEND]),
        "Total_Purchases": S.row_sum([col(c) for c in fv.CHANNELS]),
        "Campaigns_Accepted": S.row_sum([col(c) for c in fv.CAMPAIGNS]),
        "Age": F.year(ref) - col("Year_Birth"),
        "Children": col("Kidhome") + col("Teenhome"),
        "Tenure_Days": S.tenure_days(col(fv.ENROLLED), ref),
    }
    purchases = col("Total_Purchases")
    ratios = {
        "Avg_Order_Value": S.safe_ratio(col("Total_Spend"), purchases),
        "Deal_Ratio": S.clip(S.safe_ratio(col("NumDealsPurchases"), purchases), 0.0, 1.0),
        "Web_Share": S.safe_ratio(col("NumWebPurchases"), purchases),
        "Catalog_Share": S.safe_ratio(col("NumCatalogPurchases"), purchases),
        "Store_Share": S.safe_ratio(col("NumStorePurchases"), purchases),
        "Spend_To_Income": S.safe_ratio(col("Total_Spend"), col("Income")),
        **{share: S.safe_ratio(col(c), col("Total_Spend")) for c, share in fv.SHARE_OF.items()},
        "Age_Band": S.age_band(col("Age")),
        "Is_Parent": F.when(col("Children") > 0, "Parent").otherwise("No children"),
    }
    return df.withColumns(totals).withColumns(ratios)


class FeatureEngineer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the reference date (latest enrolment) so that training and scoring share one clock."""

    fallbackDate = Param(Params._dummy(), "fallbackDate", "date used when no enrolment is known", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fallbackDate=None):
        super().__init__()
        self._setDefault(fallbackDate=dt.date.today().isoformat())
        if fallbackDate:
            self._set(fallbackDate=fallbackDate)

    def _fit(self, df: DataFrame) -> "FeatureModel":
        latest = df.agg(F.max(F.col(fv.ENROLLED).cast("date")).alias("d")).first()["d"]
        return FeatureModel(referenceDate=latest.isoformat() if latest else self.getOrDefault("fallbackDate"))


class FeatureModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    referenceDate = Param(Params._dummy(), "referenceDate", "anchor of age and tenure", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, referenceDate=None):
        super().__init__()
        if referenceDate:
            self._set(referenceDate=referenceDate)

    def _transform(self, df: DataFrame) -> DataFrame:
        return engineer_features(df, self.getOrDefault("referenceDate"))


def detect_rfm_columns(columns: list[str]) -> dict[str, list[str]]:
    """Column roles by the listed names, else by the usual prefixes; Recency is mandatory."""
    if "Recency" not in columns:
        raise ValueError("The table must contain a Recency column.")
    monetary = [c for c in fv.SPEND if c in columns] or [c for c in columns if c.lower().startswith("mnt")]
    frequency = [c for c in fv.CHANNELS if c in columns] or [
        c for c in columns if c.lower().startswith("num") and "purchas" in c.lower()
    ]
    if not monetary:
        raise ValueError("No monetary columns detected.")
    if not frequency:
        raise ValueError("No purchase-frequency columns detected.")
    return {"monetary": monetary, "frequency": frequency, "behavior": [c for c in fv.RFM_OPTIONAL if c in columns]}


def rfm_features(df: DataFrame, medians: dict[str, float], roles: dict[str, list[str]] | None = None) -> DataFrame:
    """RFM feature table; ``medians`` holds the learned medians of Recency and (unclipped) Age."""
    roles = roles or detect_rfm_columns(df.columns)
    num = lambda c: S.finite(F.col(c).try_cast("double"))
    id_name = next((c for c in fv.RFM_ID_NAMES if c in df.columns), None)
    out = [
        F.coalesce(num("Recency"), F.lit(medians.get("Recency"))).alias("Recency"),
        S.row_sum([num(c) for c in roles["monetary"]]).alias("Monetary"),
        S.row_sum([num(c) for c in roles["frequency"]]).alias("Frequency"),
        *[F.coalesce(num(c), F.lit(0.0)).alias(c) for c in roles["behavior"]],
    ]
    if "Year_Birth" in df.columns:
        age = F.lit(float(fv.RFM_YEAR)) - num("Year_Birth")
        out.append(F.coalesce(S.clip(age, 18.0, 100.0), F.lit(medians.get("Age"))).alias("Age"))
    ident = F.col(id_name) if id_name else F.col(fv.ROW_ORDER)
    table = df.select(*out, ident.alias("CustomerID"))
    aov = F.col("Monetary") / F.greatest(F.col("Frequency"), F.lit(1.0))
    return table.withColumn("AverageOrderValue", aov)
