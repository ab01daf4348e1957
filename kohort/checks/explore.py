"""Exploratory aggregations and preprocessing estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.checks.base import C360_SQL, FEAT_SQL, SEG_SQL, c360, featured, query, rnd, segmented, table
from kohort.operators import explore as X, profiles as P
from kohort.operators.features import FeatureEngineer, detect_rfm_columns, rfm_features
from kohort.operators.impute import fitted_medians
from kohort.operators.prep import MedianImputer, PopulationScaler, RobustPrep, SkewCorrector, Winsorizer, customer_prep, skewness_report
from kohort.operators.quantiles import rank_pct

_T = "Total_Spend"


@query("g31_spend_shares", f"{SEG_SQL} " + " UNION ALL ".join(f"SELECT '{c.replace('Mnt', '')}' AS name, round((SELECT sum({c}) FROM seg) / (SELECT sum(Total_Spend) FROM seg), 9) AS share" for c in fv.SPEND))
def spend_shares(spark, folder):
    return X.spend_shares(segmented(spark, folder)).select("name", rnd("share", 9).alias("share"))


@query("g31_channel_shares", f"{SEG_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS name, round((SELECT sum({c}) FROM seg) / (SELECT sum(Total_Purchases) FROM seg), 9) AS share" for c, n in zip(fv.CHANNELS, ["Web", "Catalog", "Store"])))
def channel_shares(spark, folder):
    return X.channel_shares(segmented(spark, folder)).select("name", rnd("share", 9).alias("share"))


def _bins(col, value, parts):
    probs = [i / parts for i in range(1, parts)]
    return f"""{SEG_SQL}, q AS (SELECT list_distinct(quantile_cont({col}, {probs})) AS d FROM seg), qs AS (SELECT list_sort(d) AS e FROM q)
SELECT CAST({"+".join(f"coalesce(CAST({col} > e[{i + 1}] AS INT), 0)" for i in range(len(probs)))} AS BIGINT) AS bin, round(avg({value}), 4) AS avg_{value}, count(*) AS customers FROM seg, qs GROUP BY 1"""


@query("g32_spend_by_income_quintile", _bins("Income", "Total_Spend", 5))
def income_quintiles(spark, folder):
    out = X.mean_by_quantile(segmented(spark, folder), "Income", "Total_Spend", 5)
    return out.select("bin", rnd("avg_Total_Spend", 4).alias("avg_Total_Spend"), "customers")


@query("g32_deals_by_frequency_quartile", _bins("Total_Purchases", "Deal_Ratio", 4))
def frequency_quartiles(spark, folder):
    out = X.mean_by_quantile(segmented(spark, folder), "Total_Purchases", "Deal_Ratio", 4)
    return out.select("bin", rnd("avg_Deal_Ratio", 4).alias("avg_Deal_Ratio"), "customers")


@query("g33_top_share", f"{SEG_SQL} SELECT round(sum(Total_Spend) FILTER (WHERE Total_Spend >= (SELECT quantile_cont(Total_Spend, 0.8) FROM seg)) / sum(Total_Spend), 9) AS top_share FROM seg")
def top_share(spark, folder):
    return X.top_share(segmented(spark, folder)).select(rnd("top_share", 9).alias("top_share"))


@query("g34_campaign_rates", f"{SEG_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS campaign, round(avg({c}), 9) AS acceptance_rate FROM seg" for c in fv.CAMPAIGNS))
def campaigns(spark, folder):
    return X.campaign_rates(segmented(spark, folder)).select("campaign", rnd("acceptance_rate", 9).alias("acceptance_rate"))


@query("g34_accepted_histogram", f"{SEG_SQL} SELECT CAST(Campaigns_Accepted AS BIGINT) AS accepted, count(*) AS customers FROM seg GROUP BY 1")
def accepted(spark, folder):
    return X.accepted_histogram(segmented(spark, folder))


@query("g34_engagement_rates", f"{SEG_SQL} SELECT round(avg(CAST(Campaigns_Accepted = 0 AS INT)), 9) AS never_accepted, round(avg(Complain), 9) AS complaint_rate, round(avg(CAST(NumDealsPurchases > 0 AS INT)), 9) AS bought_on_deal FROM seg")
def rates(spark, folder):
    out = X.engagement_rates(segmented(spark, folder))
    return out.select(*[rnd(c, 9).alias(c) for c in out.columns])


@query("g35_purchases_by_visits", f"{SEG_SQL} SELECT CAST(least(NumWebVisitsMonth, 10) AS BIGINT) AS visits, round(avg(NumWebPurchases), 6) AS avg_web_purchases, round(avg(Total_Purchases), 6) AS avg_purchases, count(*) AS customers FROM seg GROUP BY 1")
def visits(spark, folder):
    out = X.purchases_by_visits(segmented(spark, folder))
    return out.select("visits", rnd("avg_web_purchases").alias("avg_web_purchases"), rnd("avg_purchases").alias("avg_purchases"), "customers")


_RHO = ["Income", "Total_Spend", "Total_Purchases", "Recency", "NumWebVisitsMonth"]
_RANKS = f"{SEG_SQL}, ranks AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _RHO) + " FROM seg)"


def _pairs():
    return [(a, b) for i, a in enumerate(_RHO) for b in _RHO[i + 1 :]]


@query("g36_spearman", _RANKS + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(r_{a}, r_{b}), 6) AS rho FROM ranks" for a, b in _pairs()))
def spearman(spark, folder):
    return X.spearman(segmented(spark, folder), _RHO).select("a", "b", rnd("rho").alias("rho"))


@query("g36_strongest_pairs", _RANKS + ", p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr(r_{a}, r_{b}) AS rho FROM ranks" for a, b in _pairs()) + ") SELECT a, b, round(rho, 6) AS rho FROM p ORDER BY abs(rho) DESC, a, b LIMIT 8")
def strongest(spark, folder):
    return X.strongest_pairs(X.spearman(segmented(spark, folder), _RHO)).select("a", "b", rnd("rho").alias("rho"))


@query("g37_skewness", f"{SEG_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round_even(skewness({c}), 2) AS skewness FROM seg" for c in fv.FORMING))
def skewness(spark, folder):
    return P.skewness_list(segmented(spark, folder), fv.FORMING)


@query("g37_histogram", f"""{SEG_SQL}, e AS (SELECT min(Recency) AS lo, max(Recency) AS hi, (max(Recency) - min(Recency)) / 30 AS w FROM seg),
n AS (SELECT least(floor((Recency - lo) / w), 29) AS bin, count(*) AS n FROM seg, e WHERE Recency IS NOT NULL GROUP BY 1)
SELECT b AS bin, round(lo + b * w, 6) AS low, round(lo + (b + 1) * w, 6) AS high, coalesce(n, 0) AS n FROM range(30) t(b) CROSS JOIN e LEFT JOIN n ON bin = b""")
def histogram(spark, folder):
    return X.histogram(segmented(spark, folder), "Recency").select("bin", rnd("low").alias("low"), rnd("high").alias("high"), "n")


@query("g37_spend_quartiles", f"{SEG_SQL} SELECT Children, round(quantile_cont(Total_Spend, 0.25), 4) AS q1, round(median(Total_Spend), 4) AS median, round(quantile_cont(Total_Spend, 0.75), 4) AS q3 FROM seg GROUP BY Children")
def spend_quartiles(spark, folder):
    return X.spend_quartiles_by(segmented(spark, folder)).select("Children", *[rnd(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("w1_rank_pct", "SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER (), 9) AS rank_pct FROM orders")
def rank(spark, folder):
    return rank_pct(table(spark, folder, "orders"), "o_totalprice").select("o_orderkey", rnd("rank_pct", 9).alias("rank_pct"))


# ------------------------------------------------------------------------------------------ estimators
@query("p1_feature_engineer", f"{FEAT_SQL} SELECT ID, round(Total_Spend, 4) AS Total_Spend, Total_Purchases, round(Avg_Order_Value, 9) AS Avg_Order_Value, round(Deal_Ratio, 9) AS Deal_Ratio, round(Web_Share, 9) AS Web_Share, Campaigns_Accepted, CAST(Tenure_Days AS BIGINT) AS Tenure_Days, round(Spend_To_Income, 6) AS Spend_To_Income, round(Gold_Share, 9) AS Gold_Share FROM feat")
def feature_engineer(spark, folder):
    base = c360(spark, folder)
    out = FeatureEngineer().fit(base).transform(base)
    return out.select("ID", rnd("Total_Spend", 4).alias("Total_Spend"), "Total_Purchases", rnd("Avg_Order_Value", 9).alias("Avg_Order_Value"), rnd("Deal_Ratio", 9).alias("Deal_Ratio"), rnd("Web_Share", 9).alias("Web_Share"), "Campaigns_Accepted", "Tenure_Days", rnd("Spend_To_Income", 6).alias("Spend_To_Income"), rnd("Gold_Share", 9).alias("Gold_Share"))


_LINES = ["l_quantity", "l_extendedprice", "l_discount"]
_KEY = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"
_GAPPED = "SELECT l_orderkey, l_linenumber, l_shipdate, " + ", ".join(f"CASE WHEN l_linenumber <> 3 THEN {c} END AS {c}" for c in _LINES) + " FROM lineitem"


def _lines(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.withColumns({c: F.when(F.col("l_linenumber") != 3, F.col(c)) for c in _LINES})


def _line_out(df, digits=6):
    return df.select("l_orderkey", "l_linenumber", *[rnd(c, digits).alias(c) for c in _LINES])


@query("p2_median_imputer", f"WITH g AS ({_GAPPED}) SELECT {_KEY}, " + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM g)), 6) AS {c}" for c in _LINES) + " FROM g")
def median_imputer(spark, folder):
    df = _lines(spark, folder)
    return _line_out(MedianImputer(cols=_LINES).fit(df).transform(df))


@query("p3_winsorizer", f"SELECT {_KEY}, " + ", ".join(f"round(greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM lineitem)), (SELECT quantile_cont({c}, 0.01) FROM lineitem)), 6) AS {c}" for c in _LINES) + " FROM lineitem")
def winsorizer(spark, folder):
    df = table(spark, folder, "lineitem")
    return _line_out(Winsorizer(cols=_LINES).fit(df).transform(df))


_SKEWED = ["Income", "MntWines", "NumWebVisitsMonth", "Recency"]


@query("p4_skew_corrector", f"{C360_SQL} SELECT ID, " + ", ".join(f"round(CASE WHEN (SELECT abs(skewness({c})) > 0.4 AND min({c}) >= 0 FROM c360) THEN ln(1 + greatest({c}, 0)) ELSE {c} END, 6) AS {c}" for c in _SKEWED) + " FROM c360")
def skew_corrector(spark, folder):
    df = c360(spark, folder)
    return SkewCorrector(cols=_SKEWED, threshold=0.4).fit(df).transform(df).select("ID", *[rnd(c).alias(c) for c in _SKEWED])


@query("p5_standard_scaler", f"SELECT {_KEY}, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}" for c in _LINES) + " FROM lineitem")
def scaler(spark, folder):
    df = table(spark, folder, "lineitem")
    return _line_out(PopulationScaler(cols=_LINES).fit(df).transform(df))


_REPORT = ["Income", "Total_Spend", "Recency"]


def _winsor(c):
    return f"greatest(least(coalesce({c}, m_{c}), h_{c}), l_{c})"


@query("p6_skewness_report", f"{FEAT_SQL}, m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in _REPORT)} FROM feat), q AS (SELECT {', '.join(f'quantile_cont(coalesce({c}, m_{c}), 0.01) AS l_{c}, quantile_cont(coalesce({c}, m_{c}), 0.99) AS h_{c}' for c in _REPORT)} FROM feat, m), w AS (SELECT {', '.join(f'{_winsor(c)} AS {c}' for c in _REPORT)} FROM feat, m, q) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT round_even(skewness({c}), 2) FROM feat) AS skew_before, (SELECT round_even(CASE WHEN f THEN skewness(ln(1 + greatest({c}, 0))) ELSE skewness({c}) END, 2) FROM w, (SELECT abs(skewness({c})) > 0.75 AND min({c}) >= 0 AS f FROM w) GROUP BY f) AS skew_after, (SELECT CAST(abs(skewness({c})) > 0.75 AND min({c}) >= 0 AS BIGINT) FROM w) AS log_transformed" for c in _REPORT
))
def report(spark, folder):
    df = featured(spark, folder)
    return skewness_report(df, customer_prep(_REPORT).fit(df), _REPORT)


_ROBUST = ["Recency", "MntWines", "NumWebVisitsMonth"]


@query("p7_robust_prep", f"{C360_SQL}, g AS (SELECT ID, {', '.join(f'ln(1 + greatest({c}, 0)) AS {c}' for c in _ROBUST)} FROM c360), w AS (SELECT ID, " + ", ".join(f"greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM g)), (SELECT quantile_cont({c}, 0.01) FROM g)) AS {c}" for c in _ROBUST) + " FROM g) SELECT ID, " + ", ".join(f"round(({c} - (SELECT median({c}) FROM w)) / coalesce(nullif((SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM w), 0), 1), 6) AS {c}" for c in _ROBUST) + " FROM w")
def robust(spark, folder):
    df = c360(spark, folder)
    return RobustPrep(cols=_ROBUST).fit(df).transform(df).select("ID", *[rnd(c).alias(c) for c in _ROBUST])


@query("p10_detect_schema", f"{C360_SQL} SELECT 'monetary' AS role, 6::BIGINT AS columns, round(sum({' + '.join(fv.SPEND)}), 1) AS total FROM c360 UNION ALL SELECT 'frequency', 3, round(sum({' + '.join(fv.CHANNELS)}), 1) FROM c360")
def detect(spark, folder):
    df = c360(spark, folder)
    roles = detect_rfm_columns(df.columns)
    row = lambda r: F.struct(F.lit(r).alias("role"), F.lit(len(roles[r])).alias("columns"), rnd(F.sum(sum([F.col(c) for c in roles[r][1:]], F.col(roles[r][0]))), 1).alias("total"))
    return df.agg(row("monetary").alias("a"), row("frequency").alias("b")).select(F.inline(F.array("a", "b")))


@query("p11_rfm_features", f"{C360_SQL} SELECT ID AS CustomerID, coalesce(Recency, (SELECT median(Recency) FROM c360)) AS Recency, round(MntWines + MntFruits + MntMeatProducts + MntFishProducts + MntSweetProducts + MntGoldProds, 4) AS Monetary, NumWebPurchases + NumCatalogPurchases + NumStorePurchases AS Frequency, Response, Income, greatest(least(2025 - Year_Birth, 100.0), 18.0) AS Age FROM c360")
def rfm(spark, folder):
    df = c360(spark, folder)
    medians = fitted_medians(df.withColumn("Age", 2025 - F.col("Year_Birth")), ["Recency", "Age"])
    return rfm_features(df, medians).select("CustomerID", "Recency", rnd("Monetary", 4).alias("Monetary"), "Frequency", "Response", "Income", "Age")
