"""Duplicates, filters, imputation and the cleaning job, on defects planted into the given rows by key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.checks.base import C360_SQL, SEG_SQL, c360, query, rnd, segmented, table
from kohort.operators import dedup, filters, impute, quality
from kohort.plans.cleaning import clean_customers, cleaning_summary

# every customer, plus an exact copy (keys divisible by 10), the same ID with another balance (by 15), and the same
# attributes under a new ID (by 20); IDs divisible by 7 are missing
_COPIES_SQL = """WITH copies AS (
  SELECT *, unnest([0] || CASE WHEN c_custkey % 10 = 0 THEN [1] ELSE [] END || CASE WHEN c_custkey % 15 = 0 THEN [2] ELSE [] END
    || CASE WHEN c_custkey % 20 = 0 THEN [3] ELSE [] END) AS v FROM customer),
dirty AS (
  SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN v = 3 THEN c_custkey + 10000000 ELSE c_custkey END AS ID,
    c_nationkey, CASE WHEN v = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment,
    CAST(v * 100000000 + c_custkey AS BIGINT) AS pos FROM copies)"""


def _dirty(spark, folder):
    k = F.col("c_custkey")
    versions = F.array_compact(
        F.array(F.lit(0), F.when(k % 10 == 0, 1), F.when(k % 15 == 0, 2), F.when(k % 20 == 0, 3))
    )
    copies = table(spark, folder, "customer").withColumn("v", F.explode(versions))
    v = F.col("v")
    return copies.select(
        F.when(k % 7 != 0, F.when(v == 3, k + 10_000_000).otherwise(k)).alias(fv.ID),
        "c_nationkey",
        F.when(v == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment",
        (v.cast("long") * 100_000_000 + k).alias(fv.ROW_ORDER),
    )


def _shown(df):
    return df.withColumnRenamed(fv.ROW_ORDER, "pos").withColumn(fv.ID, F.col(fv.ID).cast("double"))


_OUT = "CAST(ID AS DOUBLE) AS ID, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, pos"


@query("s1_drop_exact_duplicates", f"{_COPIES_SQL} SELECT CAST(ID AS DOUBLE) AS ID, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, min(pos) AS pos FROM dirty GROUP BY ALL")
def exact(spark, folder):
    return _shown(dedup.drop_exact_duplicates(_dirty(spark, folder)))


@query("s2_drop_duplicate_ids", f"{_COPIES_SQL} SELECT {_OUT} FROM dirty QUALIFY ID IS NULL OR row_number() OVER (PARTITION BY ID ORDER BY pos) = 1")
def duplicate_ids(spark, folder):
    return _shown(dedup.drop_duplicate_ids(_dirty(spark, folder)))


@query("s3_fill_missing_ids", f"""{_COPIES_SQL} SELECT CASE WHEN ID IS NULL THEN (SELECT max(ID) FROM dirty) + row_number() OVER (PARTITION BY ID IS NULL ORDER BY pos) ELSE ID END::DOUBLE AS ID, pos FROM dirty""")
def fill_ids(spark, folder):
    return _shown(dedup.fill_missing_ids(_dirty(spark, folder))).select("ID", "pos")


@query("s4_drop_duplicate_profiles", f"{_COPIES_SQL} SELECT {_OUT} FROM dirty QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_acctbal, c_mktsegment ORDER BY pos) = 1")
def duplicate_profiles(spark, folder):
    return _shown(dedup.drop_duplicate_profiles(_dirty(spark, folder)))


@query("s5_count_duplicates", f"{_COPIES_SQL} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM dirty GROUP BY ID, c_nationkey, c_acctbal, c_mktsegment)")
def count_duplicates(spark, folder):
    return dedup.count_duplicates(_dirty(spark, folder), [fv.ID, "c_nationkey", "c_acctbal", "c_mktsegment"])


@query("s6_union_rows", "SELECT c_custkey AS key, c_name AS name, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_rows(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    b = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return dedup.union_rows([a, b])


_BLANKED = ["Income", "Recency", "MntWines", "Education"]


@query("d1_drop_blank_rows", f"{C360_SQL} SELECT ID FROM c360 WHERE ID % 5 <> 0 OR ID % 3 <> 0")
def blank_rows(spark, folder):
    # keys divisible by 5 lose Income and Recency, those divisible by 3 lose MntWines and Education
    base = c360(spark, folder)
    lose = {c: F.when(F.col("ID") % 5 != 0, F.coalesce(F.col(c), F.lit(0.0))) for c in _BLANKED[:2]}
    lose |= {c: F.when(F.col("ID") % 3 != 0, F.col(c)) for c in _BLANKED[2:]}
    return filters.drop_blank_rows(base.withColumns(lose), 0.5, _BLANKED).select("ID")


@query("d2_drop_implausible_birth", f"{C360_SQL} SELECT ID FROM c360 WHERE Kidhome = 2 OR NOT (Year_Birth < 1920 OR Year_Birth > year((SELECT max(Dt_Customer) FROM c360)) - 16)")
def implausible_birth(spark, folder):
    df = c360(spark, folder).withColumn("Year_Birth", F.when(F.col("Kidhome") != 2, F.col("Year_Birth")))
    return filters.drop_implausible_birth(df, 2026).select("ID")


@query("d3_drop_extreme_income", f"{C360_SQL} SELECT ID FROM c360 WHERE Kidhome = 2 OR NOT Income * 40 > 200000")
def extreme_income(spark, folder):
    df = c360(spark, folder).withColumn("Income", F.when(F.col("Kidhome") != 2, F.col("Income") * 40))
    return filters.drop_extreme_income(df).select("ID")


@query("d4_drop_spend_without_purchase", f"{C360_SQL} SELECT ID FROM c360 WHERE NOT (MntWines + MntFruits + MntMeatProducts + MntFishProducts + MntSweetProducts + MntGoldProds > 0 AND (Kidhome = 1 OR NumWebPurchases + NumCatalogPurchases + NumStorePurchases = 0))")
def spend_without_purchase(spark, folder):
    df = c360(spark, folder).withColumns({c: F.when(F.col("Kidhome") == 1, 0.0).otherwise(F.col(c)) for c in fv.CHANNELS})
    return filters.drop_spend_without_purchase(df).select("ID")


@query("d5_segment_in", f"{SEG_SQL} SELECT ID, Segment FROM seg WHERE Segment IN (1, 3)")
def segment_in(spark, folder):
    return filters.segment_in(segmented(spark, folder), [3, 1, 1], [0, 1, 2, 3]).select("ID", "Segment")


@query("d6_compare_numeric", f"""{SEG_SQL} SELECT ID, CAST(coalesce(Income > 5000, false) AS BIGINT) AS above, CAST(Deal_Ratio > 0.3 AS BIGINT) AS ratio, CAST(coalesce(Recency <> 100, true) AS BIGINT) AS other FROM seg""")
def compare_numeric(spark, folder):
    df = segmented(spark, folder)
    c = lambda f, op, v: filters.comparison(df, f, op, v)
    return df.select("ID", c("Income", ">", 5000).alias("above"), c("Deal_Ratio", ">", 30).alias("ratio"), c("Recency", "!=", 100).alias("other"))


@query("d7_compare_text", f"{SEG_SQL} SELECT ID FROM seg WHERE lower(Education) = 'phd' AND lower(Marital_Status) <> 'single'")
def compare_text(spark, folder):
    df = segmented(spark, folder)
    return df.filter(filters.comparison(df, "Education", "==", "phd") & filters.comparison(df, "Marital_Status", "!=", "SINGLE")).select("ID")


@query("d8_filter_customers", f"{SEG_SQL} SELECT ID, Segment, strftime(Dt_Customer, '%Y-%m-%d') AS Dt_Customer FROM seg WHERE Segment IN (2, 3) AND Income >= 1000 AND NumWebVisitsMonth < 20 AND lower(Education) <> 'basic'")
def filter_customers(spark, folder):
    wanted = [
        {"feature": "Income", "op": ">=", "value": 1000},
        {"feature": "NumWebVisitsMonth", "op": "<", "value": 20},
        {"feature": "Education", "op": "!=", "value": "Basic"},
    ]
    return filters.filter_customers(segmented(spark, folder), [2, 3], wanted, [0, 1, 2, 3]).select("ID", "Segment", "Dt_Customer")


@query("d9_record_warnings", f"""{C360_SQL}, x AS (SELECT ID, Kidhome, CASE WHEN ID % 7 = 0 THEN NULL ELSE Income END AS Income, NumDealsPurchases, CASE WHEN Kidhome = 1 THEN 0 ELSE NumWebPurchases + NumCatalogPurchases + NumStorePurchases END AS p, MntWines + MntFruits + MntMeatProducts + MntFishProducts + MntSweetProducts + MntGoldProds AS s FROM c360)
SELECT ID, CAST(CAST(s > 0 AND p = 0 AS INT) + CAST(NumDealsPurchases > p AS INT) + CAST(Income IS NULL AS INT) AS BIGINT) AS n_warnings FROM x""")
def warnings(spark, folder):
    lose = {c: F.when(F.col("Kidhome") == 1, 0.0).otherwise(F.col(c)) for c in fv.CHANNELS}
    df = c360(spark, folder).withColumns({**lose, "Income": F.when(F.col("ID") % 7 != 0, F.col("Income"))})
    return df.select("ID", F.size(filters.record_warnings()).alias("n_warnings"))


@query("d10_bounds_check", f"""{C360_SQL} SELECT ID, concat_ws('|', CASE WHEN Income < 0 OR Income > 1000000 THEN 'Income' END, CASE WHEN Recency < 0 OR Recency > 3650 THEN 'Recency' END,
  CASE WHEN MntWines < 0 OR MntWines > 100000 THEN 'MntWines' END) AS violations FROM c360""")
def bounds(spark, folder):
    df = c360(spark, folder).select("ID", "Income", "Recency", "MntWines")
    return filters.bounds_check(df, allowed=["ID", *fv.RECORD_BOUNDS]).select("ID", "violations")


_RECORD_SQL = ", ".join(
    [f"CASE WHEN {c} IS NULL OR {c} < {lo} OR {c} > {hi} THEN '{c}' END" if c != "Income" else f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c}' END" for c, (lo, hi) in fv.RECORD_BOUNDS.items()]
    + [f"CASE WHEN {c} NOT IN (0, 1) THEN '{c}' END" for c in fv.FLAGS]
    + [f"CASE WHEN {c} NOT IN ({', '.join(repr(v) for v in labels)}) THEN '{c}' END" for c, labels in fv.RECORD_LABELS.items()]
    + ["CASE WHEN Dt_Customer IS NULL THEN 'Dt_Customer' END"]
)


@query("d10_record_violations", f"""{C360_SQL}, damaged AS (SELECT * REPLACE (CASE WHEN ID % 5 = 0 THEN 2 WHEN ID % 7 = 0 THEN NULL ELSE AcceptedCmp1 END AS AcceptedCmp1,
  CASE WHEN ID % 9 = 0 THEN 'Diploma' WHEN ID % 11 = 0 THEN NULL ELSE Education END AS Education, CASE WHEN ID % 13 = 0 THEN NULL ELSE Year_Birth END AS Year_Birth) FROM c360)
SELECT ID, concat_ws('|', {_RECORD_SQL}) AS violations FROM damaged""")
def record_violations(spark, folder):
    every = lambda n: F.col("ID") % n == 0
    df = c360(spark, folder).withColumns(
        {
            "AcceptedCmp1": F.when(every(5), 2.0).when(every(7), None).otherwise(F.col("AcceptedCmp1")),
            "Education": F.when(every(9), "Diploma").when(every(11), None).otherwise(F.col("Education")),
            "Year_Birth": F.when(every(13), None).otherwise(F.col("Year_Birth")),
        }
    )
    return filters.record_violations(df).select("ID", "violations")


_GAPS = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"


def _gaps(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    )


@query("g5_impute_group_median", f"WITH g AS ({_GAPS}), m AS (SELECT c_mktsegment AS s, median(c_acctbal) AS m FROM g GROUP BY 1) SELECT c_custkey, round(coalesce(c_acctbal, m, (SELECT median(c_acctbal) FROM g)), 6) AS balance FROM g LEFT JOIN m ON s IS NOT DISTINCT FROM c_mktsegment")
def group_median(spark, folder):
    return impute.impute_group_median(_gaps(spark, folder), "c_acctbal", "c_mktsegment").select("c_custkey", rnd("c_acctbal").alias("balance"))


@query("g6_impute_median", f"WITH g AS ({_GAPS}) SELECT c_custkey, round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM g)), 6) AS balance FROM g")
def median(spark, folder):
    return impute.impute_median(_gaps(spark, folder), ["c_acctbal"]).select("c_custkey", rnd("c_acctbal").alias("balance"))


@query("g6_median_date", "SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 9 = 0 THEN (SELECT DATE '1970-01-01' + CAST(floor(median(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)))) AS INT) FROM orders WHERE o_orderkey % 9 <> 0) ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS day FROM orders")
def median_date(spark, folder):
    gaps = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    return gaps.select("o_orderkey", F.coalesce("day", impute.median_date(gaps, "day")).alias("day"))


@query("g7_impute_mode", f"WITH g AS ({_GAPS}) SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM g WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS label FROM g")
def mode(spark, folder):
    return impute.impute_mode(_gaps(spark, folder), ["c_mktsegment"]).select("c_custkey", F.col("c_mktsegment").alias("label"))


@query("g8_coerce_mostly_numeric", "SELECT c_custkey, CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_acctbal END AS mostly, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS rarely FROM customer")
def coerce(spark, folder):
    k = F.col("c_custkey")
    df = table(spark, folder, "customer").select(
        k, F.when(k % 40 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("mostly"), F.when(k % 4 == 0, "x").otherwise(k.cast("string")).alias("rarely")
    )
    return impute.coerce_mostly_numeric(df)


_AS_OF = dt.date(2026, 1, 1)


def _clean_sql() -> str:
    """The cleaning rules on the derived customer frame, which has no duplicates, blanks or misspellings."""
    neg = lambda c: f"CASE WHEN {c} >= 0 THEN {c} END AS {c}"
    return f"""{C360_SQL},
std AS (SELECT ID, {", ".join(neg(c) for c in fv.NUMERIC)}, Education, Marital_Status, Dt_Customer FROM c360),
born AS (SELECT * FROM std WHERE NOT coalesce(Year_Birth < 1920 OR Year_Birth > year((SELECT max(Dt_Customer) FROM std)) - 16, false)),
kept AS (SELECT * FROM born WHERE NOT coalesce(Income > 200000, false)
  AND NOT ({" + ".join(fv.SPEND)} > 0 AND {" + ".join(fv.CHANNELS)} = 0)),
lev AS (SELECT *, CASE Education WHEN 'Basic' THEN 'Basic' WHEN 'Graduation' THEN 'Graduate' ELSE 'Postgraduate' END AS Education_Level FROM kept),
med AS (SELECT Education_Level AS l, median(Income) AS m FROM lev GROUP BY 1)"""


@query("g30_clean_customers", f"""{_clean_sql()} SELECT ID, Year_Birth, round(coalesce(Income, m), 6) AS Income, coalesce(Recency, (SELECT median(Recency) FROM lev)) AS Recency,
  least(NumDealsPurchases, NumWebPurchases + NumCatalogPurchases + NumStorePurchases) AS NumDealsPurchases, Education_Level FROM lev LEFT JOIN med ON l = Education_Level""")
def clean(spark, folder):
    out = clean_customers(c360(spark, folder), _AS_OF).customers
    return out.select("ID", "Year_Birth", rnd("Income").alias("Income"), "Recency", "NumDealsPurchases", "Education_Level")


@query("g30_cleaning_report", f"""{_clean_sql()}, n AS (SELECT (SELECT count(*) FROM std) AS a, (SELECT count(*) FROM born) AS b, (SELECT count(*) FROM kept) AS c)
SELECT CAST(p AS BIGINT) AS position, CASE WHEN p <= 9 THEN a WHEN p <= 11 THEN b ELSE c END AS rows_before, CASE WHEN p <= 8 THEN a WHEN p <= 10 THEN b ELSE c END AS rows_after FROM n, range(1, 14) t(p)""")
def cleaning_report(spark, folder):
    return clean_customers(c360(spark, folder), _AS_OF).audit.select("position", "rows_before", "rows_after")


@query("g30_cleaning_summary")
def summary(spark, folder):
    return cleaning_summary(clean_customers(c360(spark, folder), _AS_OF).audit)


@query("g38_quality_checks", f"""{_COPIES_SQL} SELECT (SELECT count(*) FROM dirty WHERE ID IS NULL) AS missing_cells, (SELECT count(*) - count(DISTINCT (ID, c_nationkey, c_acctbal, c_mktsegment)) FROM dirty) AS exact_duplicates,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM dirty GROUP BY ID)) AS id_duplicates,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM dirty GROUP BY c_nationkey, c_acctbal, c_mktsegment)) AS profile_duplicates,
  0::BIGINT AS born_before_1920, (SELECT count(*) FROM dirty WHERE c_acctbal * 40 > 200000) AS income_above_200k, 0::BIGINT AS spend_without_purchase, 10::BIGINT AS constant_columns""")
def quality_checks(spark, folder):
    fixed = {c: F.lit(0.0) for c in [*fv.SPEND, *fv.CHANNELS]}
    df = _dirty(spark, folder).withColumns({**fixed, "Income": F.col("c_acctbal") * 40, "Year_Birth": F.lit(1970.0)}).drop("c_acctbal")
    return quality.quality_checks(df)
