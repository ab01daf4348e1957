"""Sources, sinks, reshaping and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.checks.base import C360_SQL, FEAT_SQL, SEG_SQL, c360, query, rnd, segmented, table
from kohort.operators import naming, reshape
from kohort.operators.impute import impute_group_median
from kohort.operators.profiles import segment_moments
from kohort.operators.synth import copied_ids
from kohort.session import shared_folder
from kohort.sources import columns, readers, sinks

_CUSTOMER = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"
_COLS = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]


def _typed(df):
    return df.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"), "c_mktsegment")


def _copy(spark, folder, fmt, label):
    import uuid

    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    sinks.write_table(table(spark, folder, "customer").select(*_COLS), path, fmt)
    return path


@query("a1_read_delimited", _CUSTOMER)
def read_delimited(spark, folder):
    return _typed(readers.read_delimited(spark, _copy(spark, folder, "csv", "delimited")))


@query("a2_read_json_lines", _CUSTOMER)
def read_json_lines(spark, folder):
    return _typed(readers.read_json_lines(spark, _copy(spark, folder, "json", "lines")))


@query("a3_flatten_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def flatten_json(spark, folder):
    events = table(spark, folder, "events")
    nested = events.select("event_id", F.from_json("props", "k long").alias("props"))
    return readers.flatten_structs(nested)


@query("a4_load_source", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus")
def load_source(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("kohort_orders")
    return readers.load_source(spark, query="SELECT o_orderstatus, count(*) AS orders FROM kohort_orders GROUP BY o_orderstatus")


@query("a5_read_parquet", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def read_parquet(spark, folder):
    return readers.read_parquet(spark, folder, "supplier")


@query("a7_normalize_columns", f"{C360_SQL} SELECT ID, Income, Marital_Status, strftime(Dt_Customer, '%Y-%m-%d') AS Dt_Customer, Recency, MntWines FROM c360")
def normalize_columns(spark, folder):
    odd = {"ID": "Cust. ID", "Income": "Annual Income", "Marital_Status": "marital status", "Dt_Customer": "Customer Since", "Recency": " recency ", "MntWines": "Wines"}
    raw = c360(spark, folder).select(*[F.col(c).alias(n) for c, n in odd.items()])
    return columns.normalize_columns(raw)[0]


@query("a8_write_table", _CUSTOMER)
def write_table(spark, folder):
    return _typed(spark.read.parquet(_copy(spark, folder, "parquet", "written")))


@query("a9_sanitize_text", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '''=' || c_name WHEN 1 THEN '''+' || c_name WHEN 2 THEN '''@' || c_name WHEN 3 THEN '''-1' ELSE c_name END AS cell FROM customer""")
def sanitize(spark, folder):
    k = F.col("c_custkey") % 5
    cell = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, F.concat(F.lit("+"), "c_name")).when(k == 2, F.concat(F.lit("@"), "c_name")).when(k == 3, F.lit("-1")).otherwise(F.col("c_name"))
    return sinks.sanitize_text(table(spark, folder, "customer").select("c_custkey", cell.alias("cell")))


@query("a10_export_segment", f"{SEG_SQL} SELECT ID, Segment, Segment_Name, Total_Purchases, Age_Band FROM seg WHERE Segment = 2")
def export_segment(spark, folder):
    return sinks.export_segment(segmented(spark, folder), ["ID", "Segment", "Segment_Name", "Total_Purchases", "Age_Band"], 2, [0, 1, 2, 3])


@query("a12_publish", f"{SEG_SQL} SELECT Segment, Segment_Name, count(*) AS rows FROM seg GROUP BY ALL")
def publish(spark, folder):
    import uuid

    store = sinks.PublishedTables(spark, f"{shared_folder(spark)}/published-{uuid.uuid4().hex}")
    sizes = segmented(spark, folder).groupBy("Segment", "Segment_Name").agg(F.count("*").alias("rows"))
    for version in ("v1", "v2"):
        store.publish(version, {"sizes": sizes})
    return store.table("sizes")


_DUMMIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]


def _dummies(spark, folder):
    """Part types as dummies with STANDARD as the baseline; sizes that divide by 10 get a second active dummy."""
    part = table(spark, folder, "part")
    twice = (F.col("p_size") % 10 == 0) & (F.col("p_type") != "STANDARD")
    other = lambda t: twice & (F.lit(t) == F.when(F.col("p_type") == "ECONOMY", "LARGE").otherwise("ECONOMY"))
    return part.select("p_partkey", *[((F.col("p_type") == t) | other(t)).cast("int").alias(f"kind_{t}") for t in _DUMMIES])


@query("c1_decode_one_hot", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 AND p_type <> 'STANDARD' THEN NULL ELSE p_type END AS kind FROM part")
def decode_one_hot(spark, folder):
    return reshape.decode_one_hot(_dummies(spark, folder), "kind", "STANDARD")


@query("c2_to_canonical", f"{C360_SQL} SELECT ID, Income, Education, Marital_Status, strftime(Dt_Customer, '%Y-%m-%d') AS Dt_Customer FROM c360")
def to_canonical(spark, folder):
    levels = ["Basic", "Graduation", "Master", "PhD"]
    base = c360(spark, folder)
    encoded = base.select(
        *[c for c in base.columns if c not in ("Education", "Dt_Customer")],
        *[(F.col("Education") == l).cast("int").alias(f"Education_{l}") for l in levels],
        F.date_format("Dt_Customer", "dd-MM-yyyy").alias("Dt_Customer"),
    )
    return reshape.to_canonical(encoded).select("ID", "Income", "Education", "Marital_Status", "Dt_Customer")


@query("c3_find_one_hot_groups", "SELECT 'kind' AS prefix, string_agg('kind_' || p_type, '|' ORDER BY p_type) AS columns FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> 'STANDARD')")
def find_groups(spark, folder):
    part = table(spark, folder, "part")
    exclusive = part.select("p_size", *[(F.col("p_type") == t).cast("int").alias(f"kind_{t}") for t in _DUMMIES])
    found = reshape.find_one_hot_groups(exclusive)
    return spark.createDataFrame([(p, "|".join(sorted(c))) for p, c in found.items()], "prefix string, columns string")


@query("c4_collapse_one_hot", "SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN 'Other' ELSE p_type END AS kind FROM part")
def collapse(spark, folder):
    part = table(spark, folder, "part")
    exclusive = part.select("p_partkey", *[(F.col("p_type") == t).cast("int").alias(f"kind_{t}") for t in _DUMMIES])
    return reshape.collapse_one_hot(exclusive, {"kind": [f"kind_{t}" for t in _DUMMIES]})


@query("c5_one_hot", "SELECT p_partkey, p_type, CASE WHEN p_type = 'PROMO' THEN sqrt(0.5) ELSE 0.0 END AS p_type_PROMO, CASE WHEN p_type = 'SMALL' THEN sqrt(0.5) ELSE 0.0 END AS p_type_SMALL FROM part")
def one_hot(spark, folder):
    return reshape.one_hot(table(spark, folder, "part").select("p_partkey", "p_type"), {"p_type": ["PROMO", "SMALL"]})


@query("c6_drop_constant_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def drop_constant(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", F.lit(3).alias("Z_CostContact"), F.lit("x").alias("same"), F.lit(None).cast("double").alias("empty"))
    return reshape.drop_constant_columns(df, protected=[])


@query("c7_melt", f"{C360_SQL} " + " UNION ALL ".join(f"SELECT ID, '{c}' AS variable, {c} AS value FROM c360" for c in fv.CHANNELS))
def melt(spark, folder):
    return reshape.melt(c360(spark, folder), ["ID"], fv.CHANNELS)


@query("c8_crosstab_share", f"""{SEG_SQL}, n AS (SELECT Segment, Age_Band, count(*) AS n FROM seg WHERE Age_Band IS NOT NULL GROUP BY ALL)
SELECT Segment AS row, Age_Band AS level, round(100.0 * n / sum(n) OVER (PARTITION BY Segment), 6) AS share FROM n""")
def crosstab(spark, folder):
    out = reshape.crosstab_share(segmented(spark, folder), "Segment", "Age_Band", fv.AGE_LABELS)
    return out.select("row", "level", rnd("share").alias("share"))


_AGE_SHARES = ", ".join(f"""round(coalesce(100.0 * count(*) FILTER (WHERE Age_Band = '{a}') / nullif(count(Age_Band), 0), 0.0), 6) AS "{a}\"""" for a in fv.AGE_LABELS)


@query("c8_crosstab_wide", f"{SEG_SQL} SELECT Segment AS row, {_AGE_SHARES} FROM seg WHERE Age_Band IS NOT NULL GROUP BY Segment")
def crosstab_wide(spark, folder):
    out = reshape.crosstab_wide(segmented(spark, folder), "Segment", "Age_Band", fv.AGE_LABELS)
    return out.select("row", *[rnd(F.col(f"`{a}`")).alias(a) for a in fv.AGE_LABELS])


@query("w2_file_order", "SELECT count(*) AS rows, count(*) AS positions, 0 AS first, count(*) - 1 AS last FROM lineitem")
def file_order(spark, folder):
    rows = readers.with_row_order(table(spark, folder, "lineitem"))
    at = F.col(fv.ROW_ORDER)
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(at).alias("positions"), F.min(at).alias("first"), F.max(at).alias("last"))


@query("c8_crosstab_top", """WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL),
top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 8),
s AS (SELECT p_type AS row, p_brand AS level, round(100.0 * n / sum(n) OVER (PARTITION BY p_type), 6) AS share FROM n)
SELECT * FROM s WHERE level IN (SELECT p_brand FROM top)""")
def crosstab_top(spark, folder):
    out = reshape.crosstab_share(table(spark, folder, "part"), "p_type", "p_brand", top=8)
    return out.select("row", "level", rnd("share").alias("share"))


@query("c9_assemble", f"{FEAT_SQL} SELECT ID, round(Total_Purchases + Recency + Deal_Ratio, 9) AS vector_sum FROM feat WHERE Recency IS NOT NULL")
def assemble(spark, folder):
    from pyspark.ml.functions import vector_to_array

    df = segmented(spark, folder).filter(F.col("Recency").isNotNull())
    out = reshape.assemble(df, ["Total_Purchases", "Recency", "Deal_Ratio"])
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return out.select("ID", rnd(total, 9).alias("vector_sum"))


@query("c10_preview", "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 6")
def preview(spark, folder):
    orders = readers.with_row_order(table(spark, folder, "orders"), "o_orderkey")
    return reshape.preview(orders, ["o_orderkey", "o_orderstatus", "absent"])


@query("e1_attach_segment_names", f"{SEG_SQL} SELECT ID, Segment, Segment_Name AS name FROM seg")
def attach_names(spark, folder):
    df = segmented(spark, folder)
    names = df.select("Segment", F.col("Segment_Name").alias("name")).distinct()
    return naming.attach_segment_names(df.select("ID", "Segment"), names)


_PLAYBOOK_CASE = "CASE Education WHEN 'Basic' THEN 'Lapsing Customers' WHEN 'PhD' THEN 'Catalog Connoisseurs' ELSE 'Unlisted' END"


@query("e2_attach_playbook", f"""{C360_SQL} SELECT ID, {_PLAYBOOK_CASE} AS Segment_Name,
  CASE Education WHEN 'Basic' THEN 'Win back before churn' WHEN 'PhD' THEN 'Modernise the channel without losing value' END AS goal,
  CASE Education WHEN 'Basic' THEN 2 WHEN 'PhD' THEN 2 ELSE 0 END::BIGINT AS n_kpis FROM c360""")
def attach_playbook(spark, folder):
    name = F.when(F.col("Education") == "Basic", "Lapsing Customers").when(F.col("Education") == "PhD", "Catalog Connoisseurs").otherwise("Unlisted")
    out = naming.attach_playbook(c360(spark, folder).select("ID", name.alias("Segment_Name")))
    return out.select("ID", "Segment_Name", "goal", F.when(F.col("kpis").isNull(), 0).otherwise(F.size("kpis")).alias("n_kpis"))


@query("e3_attach_group_stat", "SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END, (SELECT median(x.c_acctbal) FROM customer x WHERE x.c_custkey % 7 <> 0 AND x.c_mktsegment = customer.c_mktsegment)), 6) AS balance FROM customer")
def attach_group_stat(spark, folder):
    gaps = table(spark, folder, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    return impute_group_median(gaps, "c_acctbal", "c_mktsegment").select("c_custkey", rnd("c_acctbal").alias("balance"))


@query("e4_compare_to_population", f"""{SEG_SQL} SELECT Segment, 'Total_Spend' AS "column", round(avg(Total_Spend), 2) AS mean, round((SELECT avg(Total_Spend) FROM seg), 2) AS overall FROM seg GROUP BY Segment
UNION ALL SELECT Segment, 'Age', round(avg(Age), 6), round((SELECT avg(Age) FROM seg), 6) FROM seg GROUP BY Segment""")
def compare_to_population(spark, folder):
    out = segment_moments(segmented(spark, folder), ["Total_Spend", "Age"])
    digits = lambda c: F.when(F.col("column") == "Age", F.round(c, 6)).otherwise(F.round(c, 2))
    return out.select("Segment", "column", digits("mean").alias("mean"), digits("pop_mean").alias("overall"))


@query("e5_no_copied_ids", "SELECT c_custkey AS ID FROM customer WHERE c_custkey IN (SELECT s_suppkey * 20 FROM supplier)")
def no_copied_ids(spark, folder):
    real = table(spark, folder, "supplier").select((F.col("s_suppkey") * 20).alias("ID"))
    return copied_ids(real, table(spark, folder, "customer").select(F.col("c_custkey").alias("ID")))


@query("e6_customer_360", f"{C360_SQL} SELECT * REPLACE (strftime(Dt_Customer, '%Y-%m-%d') AS Dt_Customer) FROM c360")
def customer_360(spark, folder):
    from kohort.plans.customer360 import build_customer_360

    return build_customer_360(spark, folder).drop(fv.ROW_ORDER)
