"""Column statistics and segment profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.checks.base import MOMENTS_SQL, SEG_SQL, Z_SQL, c360, query, rnd, segmented, table
from kohort.operators import profiles as P, quality
from kohort.operators.naming import rfm_personas
from kohort.operators.ranking import compare_segments, over_indexed, preferred_channel, superlative, superlative_answers, top_traits

_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_GAP_SQL = "gaps AS (SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"


def _gaps(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey",
        "c_name",
        F.col("c_nationkey").cast("long").alias("c_nationkey"),
        F.when(k % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 13 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


def _per_column(cols, body, numeric=None):
    return " UNION ALL ".join(body(c, numeric is None or c in numeric) for c in cols)


_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("g1_audit_quality", f"""WITH {_GAP_SQL} {_per_column(_CUST_COLS, lambda c, num: f'''SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  round_even((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS "distinct", {f"round_even(skewness({c}), 2)" if num else "NULL::DOUBLE"} AS skewness FROM gaps''', _NUM)}""")
def audit(spark, folder):
    return quality.audit_quality(_gaps(spark, folder)).drop("dtype")


def _top4(c):
    return f"""(SELECT string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM gaps WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 4))"""


def _profile_body(c, num):
    if num:
        stats = f"'number' AS type, round_even(avg({c}), 3) AS mean, round_even(min({c}), 3) AS min, round_even(max({c}), 3) AS max, NULL AS top"
    else:
        stats = f"'text' AS type, NULL::DOUBLE AS mean, NULL::DOUBLE AS min, NULL::DOUBLE AS max, {_top4(c)} AS top"
    return f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct", {stats} FROM gaps"""


@query("g2_table_profile", f"WITH {_GAP_SQL} {_per_column(_CUST_COLS, _profile_body, _NUM)}")
def table_profile(spark, folder):
    return quality.table_profile(_gaps(spark, folder))


@query("g3_analyze_table", f"""{SEG_SQL} SELECT (SELECT count(*) FROM seg) AS rows, 25::BIGINT AS columns, 0::BIGINT AS duplicate_rows, 1::BIGINT AS n_missing_columns,
  (SELECT round_even(avg(Income), 1) FROM seg) AS income_mean, (SELECT round_even(max(MntWines), 1) FROM seg) AS wine_max""")
def analyze(spark, folder):
    frame = c360(spark, folder).drop("Complain", "Dt_Customer")
    info = quality.analyze_table(frame)
    by = {r["column"]: r for r in info["numeric_summary"]}
    row = (info["rows"], info["columns"], info["duplicate_rows"], len(info["missing_columns"]), by["Income"]["mean"], by["MntWines"]["max"])
    return spark.createDataFrame([row], "rows long, columns long, duplicate_rows long, n_missing_columns long, income_mean double, wine_max double")


_STATS = 'count(Income) AS "count", round_even(avg(Income), 4) AS mean, round_even(stddev_samp(Income), 4) AS std, min(Income) AS min, round_even(median(Income), 4) AS median, max(Income) AS max'


@query("g4_column_stats", f"{SEG_SQL} SELECT Segment_Name, {_STATS} FROM seg GROUP BY Segment_Name UNION ALL SELECT 'all', {_STATS} FROM seg")
def column_stats(spark, folder):
    out = quality.numeric_column_stats(segmented(spark, folder), " income ")
    return out.withColumn("Segment_Name", F.coalesce("Segment_Name", F.lit("all")))


@query("g4_text_column_stats", f"""{SEG_SQL}, n AS (SELECT Segment_Name, Education AS value, count(*) AS n FROM seg GROUP BY ALL UNION ALL SELECT 'all', Education, count(*) FROM seg GROUP BY Education)
SELECT * FROM n""")
def text_column_stats(spark, folder):
    out = quality.text_column_stats(segmented(spark, folder), "education")
    return out.withColumn("Segment_Name", F.coalesce("Segment_Name", F.lit("all")))


@query("g9_zscore_profile", f'{Z_SQL} SELECT Segment, "column", round(z, 6) AS z FROM z')
def zscores(spark, folder):
    return P.zscore_profile(segmented(spark, folder)).select("Segment", "column", rnd("z").alias("z"))


@query("g9_fingerprint", f"""{MOMENTS_SQL}, spread AS (SELECT "column" AS c, (max(mean) - min(mean)) / max(sample_std) AS s FROM moments GROUP BY 1 ORDER BY s DESC, c LIMIT 12)
SELECT Segment, "column", round(greatest(least((mean - pop_mean) / pop_std, 2.0), -2.0), 6) AS z FROM moments WHERE "column" IN (SELECT c FROM spread) AND pop_std > 0""")
def fingerprint(spark, folder):
    return P.fingerprint(segmented(spark, folder), fv.DESCRIBING, clip=2.0).select("Segment", "column", rnd("z").alias("z"))


@query("g10_index_table", f'{MOMENTS_SQL} SELECT Segment, "column", round_even(mean / nullif(pop_mean, 0) * 100, 0) AS "index" FROM moments')
def index(spark, folder):
    return P.index_table(segmented(spark, folder))


PROFILES_SQL = f"""{SEG_SQL}, profiles AS (SELECT Segment, Segment_Name, count(*) AS Customers, round_even(count(*) / (SELECT count(*) FROM seg) * 100, 1) AS "Customer_Share_%",
  round_even(sum(Total_Spend) / (SELECT sum(Total_Spend) FROM seg) * 100, 1) AS "Revenue_Share_%", round_even(median(Income), 0) AS Median_Income, round_even(avg(Total_Spend), 0) AS Avg_Total_Spend,
  round_even(avg(Total_Purchases), 1) AS Avg_Purchases, round_even(avg(Avg_Order_Value), 1) AS Avg_Order_Value, round_even(avg(Recency), 1) AS Avg_Recency_Days, round_even(avg(NumWebVisitsMonth), 1) AS Avg_Web_Visits,
  round_even(avg(Deal_Ratio) * 100, 1) AS "Deal_Ratio_%", round_even(avg(Campaigns_Accepted), 2) AS Campaign_Acceptance, round_even(avg(Age), 1) AS Avg_Age, round_even(avg(Children), 2) AS Avg_Children,
  round_even(avg(Tenure_Days), 0) AS Avg_Tenure_Days FROM seg GROUP BY Segment, Segment_Name)"""


@query("g11_segment_profiles", f"{PROFILES_SQL} SELECT * FROM profiles")
def segment_profiles(spark, folder):
    return P.segment_profiles(segmented(spark, folder))


_MIX = lambda cols: ", ".join(f'round_even(avg({c}) * 100, 1) AS "{n}"' for c, n in cols.items())
_CATS = {c: c.replace("_Share", "") for c in fv.CATEGORY_SHARES}


@query("g12_channel_mix", f"{SEG_SQL} SELECT Segment, {_MIX(fv.CHANNEL_SHARES)} FROM seg GROUP BY Segment")
def channel_mix(spark, folder):
    return P.channel_mix(segmented(spark, folder))


@query("g12_category_mix", f"{SEG_SQL} SELECT Segment, {_MIX(_CATS)} FROM seg GROUP BY Segment")
def category_mix(spark, folder):
    return P.category_mix(segmented(spark, folder))


def _cramer(src, a, b):
    return f"""(WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {src} WHERE {b} IS NOT NULL GROUP BY ALL), ra AS (SELECT a, sum(n) AS r FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS k FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c)
  SELECT sqrt(sum(power(coalesce(c.n, 0) - r * k / t, 2) / (r * k / t)) / max(t) / (least((SELECT count(*) FROM ra), (SELECT count(*) FROM cb)) - 1)) FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN c ON c.a = ra.a AND c.b = cb.b)"""


@query("g13_cramers_v", f"SELECT round({_cramer('customer', 'c_mktsegment', 'c_nationkey')}, 6) AS cramers_v")
def cramers(spark, folder):
    return P.cramers_v(table(spark, folder, "customer"), "c_mktsegment", "c_nationkey").select(rnd("cramers_v").alias("cramers_v"))


@query("g14_proxy_check", f"{SEG_SQL}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS attribute, {_cramer('seg', 'Segment', c)} AS v" for c in ("Age_Band", "Is_Parent", "Education_Level", "Marital_Status")) + ") SELECT attribute, round_even(v, 3) AS cramers_v, CAST(v >= 0.3 AS BIGINT) AS review_needed FROM v")
def proxy_check(spark, folder):
    return P.proxy_check(segmented(spark, folder))


def _detail_sql():
    parts = ["SELECT Segment, 'Share of customers' AS label, count(*) / (SELECT count(*) FROM seg) AS value, NULL::DOUBLE AS baseline FROM seg GROUP BY Segment"]
    for label, (kind, c) in fv.DETAIL_METRICS.items():
        f = "median" if kind == "median" else "avg"
        parts.append(f"SELECT Segment, '{label}', {f}({c}), (SELECT {f}({c}) FROM seg) FROM seg GROUP BY Segment")
    return " UNION ALL ".join(parts)


@query("g15_segment_detail", f"{SEG_SQL}, d AS ({_detail_sql()}) SELECT Segment, label, round_even(value, 4) AS value, round_even(baseline, 4) AS baseline, round_even((value / nullif(baseline, 0) - 1) * 100, 1) AS delta_pct FROM d")
def detail(spark, folder):
    return P.segment_detail(segmented(spark, folder))


@query("g16_distribution", f"{SEG_SQL} SELECT Segment, round_even(min(Avg_Order_Value), 3) AS min, round_even(quantile_cont(Avg_Order_Value, 0.25), 3) AS q1, round_even(median(Avg_Order_Value), 3) AS median, round_even(quantile_cont(Avg_Order_Value, 0.75), 3) AS q3, round_even(max(Avg_Order_Value), 3) AS max, round_even(avg(Avg_Order_Value), 3) AS mean FROM seg GROUP BY Segment")
def distribution(spark, folder):
    return P.distribution(segmented(spark, folder), "Avg_Order_Value")


@query("g17_overview_kpis", f"{SEG_SQL} SELECT count(*) AS customers, count(DISTINCT Segment) AS segments, round_even(sum(Total_Spend), 0) AS total_spend, round_even(avg(Total_Spend), 0) AS avg_spend, round_even(median(Income), 0) AS median_income FROM seg")
def kpis(spark, folder):
    return P.overview_kpis(segmented(spark, folder))


@query("g18_report_sizes", f"{SEG_SQL} SELECT coalesce(Segment_Name, 'Total') AS segment, count(*) AS customers, count(*) / (SELECT count(*) FROM seg) AS share FROM seg GROUP BY ROLLUP (Segment_Name)")
def report_sizes(spark, folder):
    return P.report_sizes(segmented(spark, folder))


@query("g18_report_averages", f"{SEG_SQL} SELECT coalesce(Segment_Name, 'All rows') AS segment, count(*) AS customers, round_even(avg(Total_Purchases), 2) AS avg_Total_Purchases, round_even(avg(Deal_Ratio), 2) AS avg_Deal_Ratio FROM seg GROUP BY ROLLUP (Segment_Name)")
def report_averages(spark, folder):
    return P.report_averages(segmented(spark, folder), ["Total_Purchases", "Deal_Ratio"])


@query("g19_spread_ranking", f"""{MOMENTS_SQL} SELECT "column", round((max(mean) - min(mean)) / max(sample_std), 6) AS spread, row_number() OVER (ORDER BY (max(mean) - min(mean)) / max(sample_std) DESC, "column") AS position FROM moments GROUP BY "column" HAVING max(sample_std) > 0""")
def spread(spark, folder):
    return P.spread_ranking(segmented(spark, folder), fv.DESCRIBING).select("column", rnd("spread").alias("spread"), "position")


@query("g19_report_metrics")
def report_metrics(spark, folder):
    names = P.report_metrics(segmented(spark, folder))
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "position int, metric string")


@query("g20_value_column", "SELECT CASE WHEN min(o_totalprice) >= 0 AND sum(o_totalprice) > 0 THEN 'o_totalprice_value' END AS value_column FROM orders")
def value_column(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", (F.col("o_totalprice") - 1e12).alias("net_amount"), F.col("o_totalprice").alias("o_totalprice_value"))
    return spark.createDataFrame([(P.value_column(orders, orders.columns),)], "value_column string")


@query("g21_generic_profiles", f"""{SEG_SQL} SELECT Segment, count(*) AS Customers, round_even(count(*) / (SELECT count(*) FROM seg) * 100, 1) AS "Customer_Share_%", round_even(sum(Total_Spend) / (SELECT sum(Total_Spend) FROM seg) * 100, 1) AS "Revenue_Share_%",
  round_even(avg(Total_Spend), 2) AS Avg_Total_Spend, round_even(avg(Age), 2) AS "Avg Age", (SELECT x.Education FROM seg x WHERE x.Segment = seg.Segment GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS "Top Education" FROM seg GROUP BY Segment""")
def generic(spark, folder):
    return P.generic_profiles(segmented(spark, folder), ["Age"], ["Education"], "Total_Spend")


@query("g22_category_lift", """WITH c AS (SELECT CAST(p_size // 13 AS BIGINT) AS Segment, 'p_type' AS "column", p_type AS level, count(*) AS n FROM part GROUP BY ALL UNION ALL
  SELECT CAST(p_size // 13 AS BIGINT), 'half', CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END, count(*) FROM part GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY Segment, "column") AS share, sum(n) OVER (PARTITION BY "column", level) / sum(n) OVER (PARTITION BY "column") AS overall FROM c),
h AS (SELECT *, share / overall AS lift FROM s WHERE share >= 0.4 AND share / overall >= 1.3),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY Segment, "column" ORDER BY lift DESC, level) = 1)
SELECT Segment, "column", level, round(share, 6) AS share, round(overall, 6) AS overall, round(lift, 6) AS lift, row_number() OVER (PARTITION BY Segment ORDER BY lift DESC, "column" DESC) AS position FROM b QUALIFY position <= 2""")
def lift(spark, folder):
    part = table(spark, folder, "part").select(
        F.floor(F.col("p_size") / 13).alias("Segment"), "p_type", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("half")
    )
    out = P.category_lift(part, ["p_type", "half"])
    return out.select("Segment", "column", "level", *[rnd(c).alias(c) for c in ("share", "overall", "lift")], "position")


@query("g23_rfm_summary", f"""{SEG_SQL}, r AS (SELECT Segment_Name AS Persona, Recency, Total_Purchases AS Frequency, Total_Spend AS Monetary FROM seg) """ + " UNION ALL ".join(f"""SELECT Persona, '{c}' AS "column", round_even(avg({c}), 2) AS mean, count({c}) AS "count", round_even(median({c}), 2) AS median FROM r GROUP BY Persona""" for c in ("Recency", "Frequency", "Monetary")))
def rfm_summary(spark, folder):
    df = segmented(spark, folder).select(F.col("Segment_Name").alias("Persona"), "Recency", F.col("Total_Purchases").alias("Frequency"), F.col("Total_Spend").alias("Monetary"))
    return P.rfm_summary(df)


@query("g24_form_defaults", f"{SEG_SQL} SELECT CAST(floor(median(Year_Birth)) AS BIGINT) AS Year_Birth, CAST(floor(median(NumWebPurchases)) AS BIGINT) AS NumWebPurchases, round_even(median(Income), 0) AS Income, round_even(median(MntWines), 0) AS MntWines, strftime(DATE '2003-01-01' - CAST(floor(median(Tenure_Days)) AS INT), '%Y-%m-%d') AS Dt_Customer FROM seg")
def form_defaults(spark, folder):
    return P.form_defaults(segmented(spark, folder), "2003-01-01").select("Year_Birth", "NumWebPurchases", "Income", "MntWines", "Dt_Customer")


@query("g24_generic_form_defaults", """SELECT 'p_size' AS "column", 'number' AS kind, CAST(round_even(median(p_size), 0) AS DOUBLE) AS value, CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high, 1.0::DOUBLE AS whole FROM part
UNION ALL SELECT 'p_retailprice', 'number', round_even(median(p_retailprice), 2), min(p_retailprice), max(p_retailprice), 0.0 FROM part""")
def generic_defaults(spark, folder):
    out = P.generic_form_defaults(table(spark, folder, "part"), ["p_size", "p_retailprice"], [])
    return out.select("column", "kind", F.col("value").cast("double"), "low", "high", F.col("whole").cast("double"))


@query("g25_template_rows", f"{SEG_SQL} SELECT row_number() OVER (ORDER BY Segment) AS ID, round_even(median(Income), -2) AS Income, CAST(round_even(median(Recency), 0) AS BIGINT) AS Recency, CAST(round_even(median(MntWines), 0) AS BIGINT) AS MntWines, CASE WHEN Segment = 0 THEN 'Graduation' ELSE 'Master' END AS Education FROM seg GROUP BY Segment ORDER BY Segment LIMIT 2")
def template(spark, folder):
    return P.template_rows(segmented(spark, folder)).select("ID", "Income", "Recency", "MntWines", "Education")


@query("g28_segment_metric", f"""{PROFILES_SQL} SELECT Segment, Avg_Purchases AS value, round((SELECT sum(Avg_Purchases * "Customer_Share_%") / sum("Customer_Share_%") FROM profiles), 6) AS overall FROM profiles""")
def segment_metric(spark, folder):
    out = P.segment_metric(P.segment_profiles(segmented(spark, folder)), "Avg_Purchases")
    return out.select("Segment", "value", rnd("overall").alias("overall"))


@query("g29_count_answer", f"{SEG_SQL} SELECT Segment_Name, count(*) AS customers, round_even(count(*) / (SELECT count(*) FROM seg) * 100, 1) AS share_pct, (SELECT count(*) FROM seg) AS total FROM seg GROUP BY Segment_Name")
def count_answer(spark, folder):
    return P.count_answer(segmented(spark, folder))


@query("g41_segment_scale", f"{SEG_SQL} SELECT Segment_Name, count(*) AS rows FROM seg GROUP BY Segment_Name")
def segment_scale(spark, folder):
    return P.segment_scale(segmented(spark, folder))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("g39_describe", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max FROM lineitem""" for c in _LINE))
def describe(spark, folder):
    out = quality.describe(table(spark, folder, "lineitem"), _LINE)
    return out.select("column", "count", rnd("mean", 5).alias("mean"), rnd("std", 5).alias("std"), "min", rnd("q1").alias("q1"), rnd("median").alias("median"), rnd("q3").alias("q3"), "max")


# ------------------------------------------------------------------------------------------ rankings
@query("w5_top_traits", f"""{Z_SQL}, k AS (SELECT * FROM z WHERE "column" NOT IN ({", ".join(f"'{c}'" for c in fv.CATEGORY_SHARES)})),
h AS (SELECT *, row_number() OVER (PARTITION BY Segment ORDER BY z DESC, "column") AS position, 'high' AS side FROM k), l AS (SELECT *, row_number() OVER (PARTITION BY Segment ORDER BY z, "column") AS position, 'low' AS side FROM k)
SELECT Segment, "column", round(z, 6) AS z, position, side FROM h WHERE position <= 3 AND z > 0.2 UNION ALL SELECT Segment, "column", round(z, 6), position, side FROM l WHERE position <= 3 AND z < -0.2""")
def traits(spark, folder):
    out = top_traits(P.zscore_profile(segmented(spark, folder)))
    return out.select("Segment", "column", rnd("z").alias("z"), "position", "side")


_MIXES = f"{SEG_SQL}, mix AS (SELECT Segment, {_MIX(_CATS)} FROM seg GROUP BY Segment), overall AS (SELECT {_MIX(_CATS)} FROM seg)"


@query("w6_over_indexed", _MIXES + ", r AS (" + " UNION ALL ".join(f"SELECT Segment, '{n}' AS category, mix.\"{n}\" / nullif(overall.\"{n}\", 0) AS ratio FROM mix, overall" for n in _CATS.values()) + ") SELECT Segment, category, round(ratio, 6) AS ratio, row_number() OVER (PARTITION BY Segment ORDER BY ratio DESC, category) AS position FROM r QUALIFY position <= 2")
def indexed(spark, folder):
    df = segmented(spark, folder)
    out = over_indexed(P.category_mix(df), P.overall_category_mix(df))
    return out.select("Segment", "category", rnd("ratio").alias("ratio"), "position")


@query("w7_preferred_channel", f"{SEG_SQL}, mix AS (SELECT Segment, {_MIX(fv.CHANNEL_SHARES)} FROM seg GROUP BY Segment) SELECT Segment, CASE WHEN Web >= Catalog AND Web >= Store THEN 'Web' WHEN Catalog >= Store THEN 'Catalog' ELSE 'Store' END AS preferred_channel FROM mix")
def channel(spark, folder):
    return preferred_channel(P.channel_mix(segmented(spark, folder)))


@query("w8_superlative", f'{PROFILES_SQL} SELECT row_number() OVER (ORDER BY "Deal_Ratio_%", Segment) AS position, Segment, Segment_Name, "Deal_Ratio_%" AS value FROM profiles')
def best(spark, folder):
    return superlative(P.segment_profiles(segmented(spark, folder)), "deal", lowest=True)


_WORDS = list(fv.METRIC_WORDS)
_ASKED = ["Which segment has the highest", "What group is the LOWEST by", "Tell me about"]  # the last asks for nothing
_LONG = " UNION ALL ".join(f"""SELECT '{m}' AS metric, Segment, Segment_Name, CAST("{m}" AS DOUBLE) AS value FROM profiles""" for m in sorted(set(fv.METRIC_WORDS.values())))


@query("w8_superlative_answers", f"""{PROFILES_SQL}, words AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{w}', '{m}')" for i, (w, m) in enumerate(fv.METRIC_WORDS.items()))}) t(pos, word, metric)),
asked AS (SELECT c_custkey, c_custkey % 3 AS form, CASE c_custkey % 3 WHEN 0 THEN '{_ASKED[0]}' WHEN 1 THEN '{_ASKED[1]}' ELSE '{_ASKED[2]}' END || ' ' || word AS said FROM customer JOIN words ON pos = c_custkey % {len(_WORDS)}),
meant AS (SELECT c_custkey, arg_min(metric, pos) AS metric, any_value(regexp_matches(lower(said), '{"|".join(fv.LOWEST_WORDS)}')) AS lowest FROM asked JOIN words ON contains(lower(said), word) WHERE form < 2 GROUP BY c_custkey),
long AS ({_LONG}), ends AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, Segment) AS up, row_number() OVER (PARTITION BY metric ORDER BY value DESC, Segment) AS down FROM long)
SELECT c_custkey, said AS question, coalesce(m.metric, 'none') AS metric, coalesce(CAST(lowest AS BIGINT), -1) AS lowest, coalesce(e.Segment, -1) AS Segment, coalesce(e.Segment_Name, 'none') AS Segment_Name, coalesce(e.value, -1.0) AS value FROM asked LEFT JOIN meant m USING (c_custkey)
LEFT JOIN ends e ON e.metric = m.metric AND CASE WHEN lowest THEN up ELSE down END = 1""")
def answers(spark, folder):
    key = F.col("c_custkey")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (key % n).cast("int"))
    asked = table(spark, folder, "customer").select(key, F.concat_ws(" ", pick(_ASKED, 3), pick(_WORDS, len(_WORDS))).alias("question"))
    out = superlative_answers(asked, "question", P.segment_profiles(segmented(spark, folder))).withColumn("lowest", F.col("lowest").cast("int"))
    return out.fillna("none", ["metric", "Segment_Name"]).fillna(-1, ["lowest", "Segment", "value"])


@query("w9_compare_segments", f"{PROFILES_SQL} " + " UNION ALL ".join(f"""SELECT '{m}' AS metric, max(CASE WHEN Segment = 0 THEN "{m}" END) AS segment_0, max(CASE WHEN Segment = 3 THEN "{m}" END) AS segment_3 FROM profiles""" for m in fv.COMPARE_METRICS))
def compare(spark, folder):
    return compare_segments(P.segment_profiles(segmented(spark, folder)), [0, 3])


@query("w10_top_values", """WITH n AS (SELECT p_type, p_brand AS value, count(*) AS n FROM part GROUP BY ALL) SELECT p_type, value, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, value) AS position FROM n QUALIFY position <= 4""")
def top_values(spark, folder):
    from kohort.operators.ranking import top_values as top

    counts = table(spark, folder, "part").groupBy("p_type", F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))
    return top(counts, 4, ["p_type"])


@query("w11_sample_points")
def sample_points(spark, folder):
    from kohort.operators.ranking import scatter_sample

    return scatter_sample(segmented(spark, folder), "Income", "Total_Spend", segments=[1, 2, 3])


@query("l6_rfm_personas", f"""{SEG_SQL}, m AS (SELECT Segment AS Cluster, avg(Recency) AS r, avg(Total_Purchases) AS f, avg(Total_Spend) AS m FROM seg GROUP BY Segment),
s AS (SELECT *, (rank() OVER (ORDER BY f) + rank() OVER (ORDER BY m) - rank() OVER (ORDER BY r)) / 4.0 AS score FROM m),
v AS (SELECT Cluster AS vip FROM s ORDER BY score DESC, Cluster LIMIT 1), k AS (SELECT Cluster AS risk FROM s, v WHERE Cluster <> vip ORDER BY r DESC, Cluster LIMIT 1)
SELECT Cluster, CASE WHEN Cluster = vip THEN 'VIP Heavy Spenders' WHEN Cluster = risk THEN 'At-Risk Customers' WHEN f >= (SELECT median(f) FROM m) THEN 'Loyal Frequent Buyers'
  WHEN s.m <= (SELECT median(m) FROM m) THEN 'Low-Value / New Customers' ELSE 'Casual Shoppers' END AS Persona FROM s, v, k""")
def personas(spark, folder):
    df = segmented(spark, folder).select(F.col("Segment").alias("Cluster"), "Recency", F.col("Total_Purchases").alias("Frequency"), F.col("Total_Spend").alias("Monetary"))
    return rfm_personas(df)
