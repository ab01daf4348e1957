"""Scalar functions on dirty values derived from the given columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.checks.base import C360_SQL, FEAT_SQL, c360, featured, query, rnd, table
from kohort.functions import scalars as S
from kohort.operators.features import rfm_features
from kohort.operators.impute import fitted_medians

_AMOUNT_TEXT = (
    "CASE o_orderkey % 4 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) "
    "WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' USD' WHEN 2 THEN 'N/A' "
    "ELSE '  ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.50 ' END"
)


def _amount_text():
    whole = F.floor("o_totalprice").cast("long").cast("string")
    k = F.col("o_orderkey") % 4
    return (
        F.when(k == 0, F.concat(F.lit("$"), whole))
        .when(k == 1, F.concat(whole, F.lit(" USD")))
        .when(k == 2, F.lit("N/A"))
        .otherwise(F.concat(F.lit("  "), whole, F.lit(".50 ")))
    )


@query("b1_to_number", f"""SELECT o_orderkey, TRY_CAST(regexp_replace({_AMOUNT_TEXT}, 'usd|inr|eur|gbp|rs\\.?|[,$€£₹\\s]', '', 'gi') AS DOUBLE) AS amount FROM orders""")
def to_number(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.to_number(_amount_text()).alias("amount"))


@query("b2_to_flag", """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE
  WHEN 3 THEN 0.0::DOUBLE WHEN 5 THEN 1.0::DOUBLE WHEN 6 THEN 0.0::DOUBLE END AS flag FROM customer""")
def to_flag(spark, folder):
    words = F.array(*[F.lit(w) for w in ["Yes", " no", "TRUE", "f", "2", "1", "0", "-1"]])
    raw = F.get(words, (F.col("c_custkey") % 8).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", S.to_flag(raw).alias("flag"))


_LAYOUTS = ["dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "yyyy/MM/dd", "MMMM d, yyyy", "dd.MM.yyyy"]


def _date_text():
    out = F.lit("31-02-2014")
    for i, f in enumerate(_LAYOUTS):
        out = F.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", f)).otherwise(out)
    return out


_DATE_TEXT_SQL = "CASE o_orderkey % 8 " + " ".join(
    f"WHEN {i} THEN strftime(o_orderdate, '{f}')"
    for i, f in enumerate(["%d-%m-%Y", "%Y-%m-%d", "%d/%m/%Y", "%-d %b %Y", "%Y/%m/%d", "%B %-d, %Y", "%d.%m.%Y"])
) + " ELSE '31-02-2014' END"
_PARSED_SQL = f"CAST(try_strptime({_DATE_TEXT_SQL}, ['%d-%m-%Y', '%Y-%m-%d', '%d/%m/%Y', '%d %b %Y', '%Y/%m/%d', '%B %d, %Y', '%d.%m.%Y']) AS DATE)"


@query("b3_parse_date", f"SELECT o_orderkey, strftime({_PARSED_SQL}, '%Y-%m-%d') AS day FROM orders")
def parse_date(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.parse_date(_date_text()).alias("day"))


@query("b4_to_number_any", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_acctbal END AS amount FROM customer""")
def to_number_any(spark, folder):
    k, text = F.col("c_custkey") % 3, F.col("c_acctbal").cast("string")
    raw = F.when(k == 0, F.concat(text, F.lit(" %"))).when(k == 1, F.concat(F.lit("€ "), text)).otherwise(F.concat(text, F.lit(" USD")))
    return table(spark, folder, "customer").select("c_custkey", S.to_number_any(raw).alias("amount"))


@query("b5_parse_date_any", f"SELECT o_orderkey, strftime({_PARSED_SQL}, '%Y-%m-%d') AS day FROM orders")
def parse_date_any(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.parse_date(_date_text(), iso_first=True).alias("day"))


_SPELLED = {
    "AUTOMOBILE": ["basic", "High School", " School. "],
    "BUILDING": ["GRADUATION", "Bachelor's", "B.Sc."],
    "FURNITURE": ["2nd Cycle", "2N cycle", "second-cycle"],
    "HOUSEHOLD": ["Masters", "M.B.A.", "postgraduate"],
    "MACHINERY": ["Ph.D.", "doctorate", "???"],
}


def _spelled():
    out = F.lit(None).cast("string")
    for seg, options in _SPELLED.items():
        pick = F.get(F.array(*[F.lit(o) for o in options]), (F.col("c_custkey") % 3).cast("int"))
        out = F.when(F.col("c_mktsegment") == seg, pick).otherwise(out)
    return out


_CANONICAL_SQL = """CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 2 THEN NULL ELSE CASE c_mktsegment
  WHEN 'AUTOMOBILE' THEN 'Basic' WHEN 'BUILDING' THEN 'Graduation' WHEN 'FURNITURE' THEN '2n Cycle' WHEN 'HOUSEHOLD' THEN 'Master' ELSE 'PhD' END END"""


@query("b6_canonical_label", f"SELECT c_custkey, {_CANONICAL_SQL} AS label FROM customer")
def canonical_label(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.canonical_education(_spelled()).alias("label"))


@query("b7_group_label", f"""SELECT c_custkey, CASE {_CANONICAL_SQL} WHEN 'Basic' THEN 'Basic' WHEN 'Graduation' THEN 'Graduate'
  WHEN '2n Cycle' THEN 'Postgraduate' WHEN 'Master' THEN 'Postgraduate' WHEN 'PhD' THEN 'Postgraduate' ELSE 'Unknown' END AS label FROM customer""")
def group_label(spark, folder):
    edu = S.canonical_education(_spelled())
    return table(spark, folder, "customer").select("c_custkey", S.group_label(edu, fv.EDUCATION_GROUPS).alias("label"))


@query("b8_null_negative", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer")
def null_negative(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.null_negative(F.col("c_acctbal")).alias("balance"))


@query("b9_clear_future_dates", f"SELECT o_orderkey, CASE WHEN {_PARSED_SQL} <= DATE '1998-06-30' THEN strftime({_PARSED_SQL}, '%Y-%m-%d') END AS day FROM orders")
def clear_future(spark, folder):
    day = S.clear_future(S.parse_date(_date_text()), "1998-06-30")
    return table(spark, folder, "orders").select("o_orderkey", day.alias("day"))


@query("b10_safe_ratio", f"{C360_SQL} SELECT ID, round(coalesce(MntWines / nullif(NumWebVisitsMonth, 0), 0.0), 9) AS ratio FROM c360")
def safe_ratio(spark, folder):
    return c360(spark, folder).select("ID", rnd(S.safe_ratio(F.col("MntWines"), F.col("NumWebVisitsMonth")), 9).alias("ratio"))


@query("b11_row_sum", f"{C360_SQL} SELECT ID, coalesce(Recency, 0) + coalesce(nullif(Kidhome, 0), 0) + coalesce(Income, 0) AS total FROM c360")
def row_sum(spark, folder):
    kid = F.when(F.col("Kidhome") != 0, F.col("Kidhome"))
    return c360(spark, folder).select("ID", S.row_sum([F.col("Recency"), kid, F.col("Income")]).alias("total"))


@query("b12_clip", f"{C360_SQL} SELECT ID, CASE WHEN Recency IS NOT NULL THEN greatest(least(Recency, 400.0), 30.0) END AS clipped FROM c360")
def clip(spark, folder):
    return c360(spark, folder).select("ID", S.clip(F.col("Recency"), 30.0, 400.0).alias("clipped"))


@query("b13_cap_at", f"{C360_SQL} SELECT ID, CASE WHEN Recency IS NOT NULL AND Income IS NOT NULL THEN least(Recency, Income) END AS capped FROM c360")
def cap_at(spark, folder):
    return c360(spark, folder).select("ID", S.cap_at(F.col("Recency"), F.col("Income")).alias("capped"))


@query("b14_log1p", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 9) AS logged FROM customer")
def log1p(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", rnd(S.log1p_floor(F.col("c_acctbal")), 9).alias("logged"))


@query("b15_age_band", f"{FEAT_SQL} SELECT ID, Age, Age_Band FROM feat")
def age_band(spark, folder):
    return featured(spark, folder).select("ID", "Age", "Age_Band")


@query("b16_age_clipped", f"{C360_SQL} SELECT ID, CASE WHEN Kidhome = 2 THEN (SELECT median(2025 - Year_Birth) FROM c360 WHERE Kidhome <> 2) ELSE greatest(least(2025 - Year_Birth, 100.0), 18.0) END AS Age FROM c360")
def age_clipped(spark, folder):
    gaps = c360(spark, folder).withColumn("Year_Birth", F.when(F.col("Kidhome") != 2, F.col("Year_Birth")))
    medians = fitted_medians(gaps.withColumn("Age", 2025 - F.col("Year_Birth")), ["Age", "Recency"])
    return rfm_features(gaps, medians).select(F.col("CustomerID").alias("ID"), "Age")


@query("b17_tenure_days", f"{FEAT_SQL} SELECT ID, CAST(Tenure_Days AS BIGINT) AS Tenure_Days FROM feat")
def tenure(spark, folder):
    return featured(spark, folder).select("ID", "Tenure_Days")


@query("b18_is_parent", f"{FEAT_SQL} SELECT ID, Children, Is_Parent FROM feat")
def is_parent(spark, folder):
    return featured(spark, folder).select("ID", "Children", "Is_Parent")


@query("b19_aov", f"{FEAT_SQL} SELECT ID, round(Total_Spend / greatest(Total_Purchases, 1), 9) AS AverageOrderValue FROM feat")
def aov(spark, folder):
    base = c360(spark, folder)
    out = rfm_features(base, fitted_medians(base, ["Recency"]))
    return out.select(F.col("CustomerID").alias("ID"), rnd("AverageOrderValue", 9).alias("AverageOrderValue"))


@query("b20_name_tokens", """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(p_brand, '#', 'No_') || p_type || '_v' || p_size, '[A-Z]?[a-z]+|[A-Z]+|\\d+'), lambda x: lower(x)), '|') AS n_check,
  regexp_replace(replace(p_name, ' ', '_'), '_', ' ', 'g') AS pretty FROM part""")
def name_tokens(spark, folder):
    name = F.concat(F.regexp_replace("p_brand", "#", "No_"), F.col("p_type"), F.lit("_v"), F.col("p_size").cast("string"))
    return table(spark, folder, "part").select(
        "p_partkey", S.name_tokens(name).alias("n_check"), S.pretty(F.regexp_replace("p_name", " ", "_")).alias("pretty")
    )


@query("b21_format_value", """SELECT c_custkey, CASE WHEN abs(c_acctbal) >= 1000 THEN format('{:,}', CAST(round_even(c_acctbal, 0) AS BIGINT))
  WHEN abs(c_acctbal) >= 10 THEN format('{:.1f}', c_acctbal) ELSE format('{:.2f}', c_acctbal) END AS shown FROM customer""")
def format_value(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.format_value(F.col("c_acctbal")).alias("shown"))


@query("b22_days_before_latest", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS DOUBLE) AS days FROM orders")
def days_before(spark, folder):
    orders = table(spark, folder, "orders")
    latest = orders.agg(F.max(F.col("o_orderdate").cast("date")).alias("d")).first()["d"]
    return orders.select("o_orderkey", S.days_before(F.col("o_orderdate"), latest).alias("days"))


@query("b23_category_with_other", """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'Missing' WHEN p_type IN ('ECONOMY', 'SMALL', 'PROMO') THEN p_type ELSE 'Other' END AS level FROM part""")
def category_with_other(spark, folder):
    raw = F.when(F.col("p_size") % 10 != 0, F.concat(F.lit(" "), F.col("p_type")))
    return table(spark, folder, "part").select("p_partkey", S.category_with_other(raw, ["ECONOMY", "SMALL", "PROMO"]).alias("level"))


@query("b24_parse_filter_phrase", """WITH r AS (SELECT c_custkey, CAST(20 + c_custkey % 80 AS BIGINT) AS k, CAST(1000 + c_custkey AS BIGINT) AS cap, CAST(c_custkey % 7 AS BIGINT) AS a, CAST(3 + c_custkey % 5 AS BIGINT) AS b FROM customer)
SELECT c_custkey, 'NumWebVisitsMonth' AS feature, '>=' AS op, CAST(least(a, b) AS DOUBLE) AS value FROM r
UNION ALL SELECT c_custkey, 'NumWebVisitsMonth', '<=', CAST(greatest(a, b) AS DOUBLE) FROM r
UNION ALL SELECT c_custkey, 'Income', '>', CAST(k * 1000 AS DOUBLE) FROM r
UNION ALL SELECT c_custkey, 'Total_Spend', '<=', CAST(cap AS DOUBLE) FROM r""")
def filter_phrase(spark, folder):
    from kohort.functions.text import filter_phrases

    k = F.col("c_custkey")
    text = F.format_string(
        "Income over %dk and spend <= %s and web visits between %d and %d please", 20 + k % 80, F.format_number(1000 + k, 0), k % 7, 3 + k % 5
    )
    return table(spark, folder, "customer").select("c_custkey", F.inline(filter_phrases(text)))
