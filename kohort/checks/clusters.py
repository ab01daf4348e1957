"""Cluster quality, choice of k, scoring and the clustering jobs."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.checks.base import SEG_SQL, c360, query, rnd, segmented, staged, table
from kohort.operators import kmeans as km, metrics as M, mixture as gmm, profiles as P, scoring, selection, ward
from kohort.operators.dedup import has_distinct_rows
from kohort.session import shared_folder

_DIM = 64


def _vectors(spark, folder):
    wide, cols = M.feature_columns(table(spark, folder, "embeddings"), "embedding", _DIM)
    return wide.select("vec_id", "label", *cols), cols


_U = f"""WITH u AS (SELECT vec_id, label, unnest(range(1, {_DIM + 1})) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM u GROUP BY ALL), d AS (SELECT vec_id, label, sum((v - m) * (v - m)) AS d2 FROM u JOIN c USING (label, i) GROUP BY ALL),
s AS (SELECT label, count(*) AS n, sum(d2) AS within, avg(sqrt(d2)) AS spread FROM d GROUP BY label)"""


@query("j1_inertia", f"{_U} SELECT round(sum(within), 6) AS inertia FROM s")
def inertia(spark, folder):
    df, cols = _vectors(spark, folder)
    return M.inertia(df, cols, "label").select(rnd("inertia").alias("inertia"))


_PAIRS = """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
m AS (SELECT a, la, lb, avg(dist) AS d FROM p GROUP BY ALL), w AS (SELECT a, la, max(CASE WHEN la = lb THEN d END) AS own, min(CASE WHEN la <> lb THEN d END) AS other FROM m GROUP BY ALL),
sil AS (SELECT a AS vec_id, la AS label, CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END AS silhouette FROM w)"""


@query("j2_silhouette", f"{_PAIRS} SELECT round(avg(silhouette), 9) AS silhouette FROM sil")
def silhouette(spark, folder):
    df, cols = _vectors(spark, folder)
    out = M.silhouette_by_labeling(df, cols, {"label": "label"}, "vec_id")
    return out.select(rnd("silhouette", 9).alias("silhouette"))


@query("j3_row_silhouette", f"{_PAIRS} SELECT vec_id, CAST(label AS BIGINT) AS label, round(silhouette, 9) AS silhouette FROM sil")
def row_silhouette(spark, folder):
    df, cols = _vectors(spark, folder)
    return M.silhouette_values(df, cols, "label", "vec_id").select("vec_id", "label", rnd("silhouette", 9).alias("silhouette"))


@query("j2_squared_silhouette", f"{_PAIRS.replace('AS dist FROM', '^ 2 AS dist FROM')} SELECT round(avg(silhouette), 9) AS silhouette FROM sil")
def squared_silhouette(spark, folder):
    df, cols = _vectors(spark, folder)
    out = M.silhouette_by_labeling(df, cols, {"label": "label"}, "vec_id", distance="squared")
    return out.select(rnd("silhouette", 9).alias("silhouette"))


@query("j4_calinski_harabasz", f"{_U}, g AS (SELECT i, avg(v) AS g FROM u GROUP BY i), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM c JOIN g USING (i) JOIN s USING (label)) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, (SELECT count(*) AS k, sum(n) AS n, sum(within) AS w FROM s)")
def calinski(spark, folder):
    df, cols = _vectors(spark, folder)
    return M.partition_quality(df, cols, "label").select(rnd("calinski_harabasz").alias("calinski_harabasz"))


@query("j5_davies_bouldin", f"{_U}, x AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL), r AS (SELECT la, max((sa.spread + sb.spread) / dist) AS r FROM x JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies(spark, folder):
    df, cols = _vectors(spark, folder)
    return M.partition_quality(df, cols, "label").select(rnd("davies_bouldin").alias("davies_bouldin"))


_ARI = """cells AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM labels2 GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS agreed, sum(n) AS n FROM cells),
ra AS (SELECT sum(r * (r - 1) / 2) AS r FROM (SELECT sum(n) AS r FROM cells GROUP BY a)), rb AS (SELECT sum(r * (r - 1) / 2) AS r FROM (SELECT sum(n) AS r FROM cells GROUP BY b))"""


@query("j6_adjusted_rand", f"WITH labels2 AS (SELECT c_mktsegment AS a, r_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), {_ARI} SELECT round((agreed - ra.r * rb.r / (n * (n - 1) / 2)) / ((ra.r + rb.r) / 2 - ra.r * rb.r / (n * (n - 1) / 2)), 9) AS ari FROM t, ra, rb")
def ari(spark, folder):
    return M.adjusted_rand(c360(spark, folder), "Education", "Marital_Status").select(rnd("ari", 9).alias("ari"))


@query("j7_smallest_share", "SELECT min(n) / sum(n) AS min_segment_share FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def smallest(spark, folder):
    return M.smallest_share(table(spark, folder, "embeddings"), "label")


# ------------------------------------------------------------------ choice of k on labelings "label modulo k"
_KS = list(range(2, 11))
_K_SQL = f"""WITH u AS (SELECT vec_id, unnest(range(1, {_DIM + 1})) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
lab AS (SELECT vec_id, k, label % k AS l, label FROM embeddings, range(2, 11) t(k)),
c AS (SELECT k, l, i, avg(v) AS m FROM u JOIN lab USING (vec_id) GROUP BY ALL),
d AS (SELECT vec_id, k, l, sum((v - m) * (v - m)) AS d2 FROM u JOIN lab USING (vec_id) JOIN c USING (k, l, i) GROUP BY ALL),
s AS (SELECT k, l, count(*) AS n, sum(d2) AS within, avg(sqrt(d2)) AS spread FROM d GROUP BY ALL),
g AS (SELECT i, avg(v) AS g FROM u GROUP BY i),
b AS (SELECT k, sum(n * (m - g) * (m - g)) AS b FROM c JOIN g USING (i) JOIN s USING (k, l) GROUP BY k),
q AS (SELECT k, sum(within) AS inertia, sum(n) AS n, count(*) AS kk, min(n) / sum(n) AS min_segment_share FROM s GROUP BY k),
x AS (SELECT a.k, a.l AS la, e.l AS lb, sqrt(sum((a.m - e.m) * (a.m - e.m))) AS dist FROM c a JOIN c e ON a.k = e.k AND a.i = e.i AND a.l <> e.l GROUP BY ALL),
db AS (SELECT k, avg(r) AS davies_bouldin FROM (SELECT x.k, la, max((sa.spread + sb.spread) / dist) AS r FROM x JOIN s sa ON sa.k = x.k AND sa.l = la JOIN s sb ON sb.k = x.k AND sb.l = lb GROUP BY ALL) GROUP BY k),
p AS (SELECT a.vec_id AS a, e.vec_id AS b, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS dist FROM embeddings a, embeddings e WHERE a.vec_id <> e.vec_id),
pm AS (SELECT x.k, a, x.l AS la, y.l AS lb, avg(dist) AS d FROM p JOIN lab x ON x.vec_id = a JOIN lab y ON y.vec_id = b AND y.k = x.k GROUP BY ALL),
sil AS (SELECT k, avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END) AS silhouette FROM (SELECT k, a, max(CASE WHEN la = lb THEN d END) AS own, min(CASE WHEN la <> lb THEN d END) AS other FROM pm GROUP BY k, a) GROUP BY k),
cells AS (SELECT k, l, label, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY ALL),
ari AS (SELECT k, (agreed - rr * cc / (n * (n - 1) / 2)) / ((rr + cc) / 2 - rr * cc / (n * (n - 1) / 2)) AS stability_ari FROM (SELECT k, sum(n * (n - 1) / 2) AS agreed, sum(n) AS n FROM cells GROUP BY k)
  JOIN (SELECT k, sum(r * (r - 1) / 2) AS rr FROM (SELECT k, l, sum(n) AS r FROM cells GROUP BY ALL) GROUP BY k) USING (k) JOIN (SELECT k, sum(r * (r - 1) / 2) AS cc FROM (SELECT k, label, sum(n) AS r FROM cells GROUP BY ALL) GROUP BY k) USING (k)),
km AS (SELECT k, inertia, silhouette, (b / (kk - 1)) / (inertia / (n - kk)) AS calinski_harabasz, davies_bouldin, min_segment_share, stability_ari FROM q JOIN b USING (k) JOIN db USING (k) JOIN sil USING (k) JOIN ari USING (k))"""


def _k_table(spark, folder):
    def build():
        df, cols = _vectors(spark, folder)
        labeled = df.withColumns({f"k{k}": F.col("label") % k for k in _KS})
        scored = selection.score_labelings(labeled, cols, {k: f"k{k}" for k in _KS}, "vec_id")
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("l")) for k in _KS])
        agreement = M.adjusted_rand(labeled.select("label", F.inline(pairs)), "l", "label", ["k"])
        return scored.join(agreement.withColumnRenamed("ari", "stability_ari"), "k")

    return staged(spark, folder, "k_table", build)


@query("k6_score_labelings", f"{_K_SQL} SELECT k, round(inertia, 6) AS inertia, round(silhouette, 9) AS silhouette, round(calinski_harabasz, 6) AS calinski_harabasz, round(davies_bouldin, 6) AS davies_bouldin, min_segment_share, round(stability_ari, 9) AS stability_ari FROM km")
def score_labelings(spark, folder):
    out = _k_table(spark, folder)
    return out.select("k", rnd("inertia").alias("inertia"), rnd("silhouette", 9).alias("silhouette"), rnd("calinski_harabasz").alias("calinski_harabasz"), rnd("davies_bouldin").alias("davies_bouldin"), "min_segment_share", rnd("stability_ari", 9).alias("stability_ari"))


_ELBOW = "e AS (SELECT k, abs((inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) - (1 - (k - 2) / 8.0)) AS gap FROM km), el AS (SELECT k AS elbow_k FROM e ORDER BY gap DESC, k LIMIT 1)"
_MM = lambda c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
_COMP = f"co AS (SELECT *, ({_MM('silhouette')} + {_MM('calinski_harabasz')} + 1 - {_MM('davies_bouldin')} + {_MM('stability_ari')}) / 4 AS composite_score, k >= 3 AND min_segment_share >= 0.05 AND stability_ari >= 0.8 AS eligible FROM km)"


@query("k7_find_elbow", f"{_K_SQL}, {_ELBOW} SELECT elbow_k FROM el")
def elbow(spark, folder):
    return selection.find_elbow(_k_table(spark, folder))


@query("k8_composite_score", f"{_K_SQL}, {_COMP} SELECT k, round(composite_score, 6) AS composite_score FROM co")
def composite(spark, folder):
    return selection.composite_score(_k_table(spark, folder)).select("k", rnd("composite_score").alias("composite_score"))


@query("k9_recommend_k", f"""{_K_SQL}, {_ELBOW}, {_COMP}, pool AS (SELECT * FROM co WHERE eligible OR NOT (SELECT bool_or(eligible) FROM co)),
acc AS (SELECT bool_or(co.k = elbow_k AND eligible AND silhouette >= 0.9 * (SELECT max(silhouette) FROM pool)) AS ok FROM co, el), best AS (SELECT k FROM pool ORDER BY composite_score DESC, k LIMIT 1)
SELECT co.k, CAST(eligible AS BIGINT) AS eligible, elbow_k, CAST(co.k = CASE WHEN ok THEN elbow_k ELSE best.k END AS BIGINT) AS recommended FROM co, el, acc, best""")
def recommend(spark, folder):
    return selection.recommend_k(_k_table(spark, folder)).select("k", "eligible", "elbow_k", "recommended")


@query("k10_choose_k_any", f"""{_K_SQL}, a AS (SELECT *, min_segment_share >= 0.03 AS eligible FROM km WHERE k <= 8), pool AS (SELECT * FROM a WHERE eligible OR NOT (SELECT bool_or(eligible) FROM a)),
rich AS (SELECT * FROM pool WHERE k >= 3 AND silhouette >= 0.6 * (SELECT max(silhouette) FROM pool)), fin AS (SELECT * FROM rich UNION ALL SELECT * FROM pool WHERE NOT EXISTS (SELECT 1 FROM rich))
SELECT k, CAST(eligible AS BIGINT) AS eligible, CAST(k = (SELECT k FROM fin ORDER BY silhouette DESC, k LIMIT 1) AS BIGINT) AS recommended FROM a""")
def choose_any(spark, folder):
    return selection.choose_k_any(_k_table(spark, folder).filter(F.col("k") <= 8)).select("k", "eligible", "recommended")


@query("k11_choose_k_rfm", f"{_K_SQL} SELECT k, round(silhouette, 9) AS silhouette FROM km ORDER BY km.silhouette DESC, davies_bouldin, k LIMIT 1")
def choose_rfm(spark, folder):
    return selection.choose_k_rfm(_k_table(spark, folder)).select("k", rnd("silhouette", 9).alias("silhouette"))


# ------------------------------------------------------------------ scoring with given centres
_SCALED = ["income", "recency", "purchases"]
_CENTERS = [[0.2, 0.1, 0.5], [0.9, 0.3, 1.1], [1.5, 0.05, 0.9], [0.6, 0.9, 0.7]]
_NAMES = ["Quiet", "Regular", "Wealthy", "Away"]
_DIST = [" + ".join(f"({c} - {v}::DOUBLE) * ({c} - {v}::DOUBLE)" for c, v in zip(_SCALED, center)) for center in _CENTERS]
_R_SQL = f"""{SEG_SQL}, x AS (SELECT ID, Income / 5000 AS income, coalesce(Recency, 0) / 600 AS recency, Total_Purchases / 10 AS purchases FROM seg),
d AS (SELECT ID, [{", ".join(f"sqrt({e})" for e in _DIST)}] AS d FROM x),
r AS (SELECT *, list_position(d, list_min(d)) - 1 AS Segment, 1 - list_sort(d)[1] / CASE WHEN list_sort(d)[2] = 0 THEN 1 ELSE list_sort(d)[2] END AS margin FROM d)"""


def _points(df):
    return df.select(
        "ID", (F.col("Income") / 5000).alias("income"), (F.coalesce("Recency", F.lit(0.0)) / 600).alias("recency"), (F.col("Total_Purchases") / 10).alias("purchases")
    )


def _predicted(spark, folder):
    return scoring.predict(_points(segmented(spark, folder)), _SCALED, _CENTERS, _NAMES)


_NAME_CASE = "CASE Segment WHEN 0 THEN 'Quiet' WHEN 1 THEN 'Regular' WHEN 2 THEN 'Wealthy' ELSE 'Away' END"
_R3_SQL = f"{_R_SQL} SELECT ID, CAST(Segment AS BIGINT) AS Segment, {_NAME_CASE} AS Segment_Name, round_even(list_min(d), 3) AS Distance_To_Centroid, round_even(margin, 3) AS Assignment_Margin FROM r"


@query("r1_prepare_for_scoring", f"{SEG_SQL} SELECT ID, CASE WHEN Income >= 0 THEN Income END AS Income, least(CASE WHEN ID % 50 = 0 THEN 40 ELSE NumDealsPurchases END, NumWebPurchases + NumCatalogPurchases + NumStorePurchases) AS NumDealsPurchases, CASE WHEN ID % 4 = 0 THEN NULL ELSE Response END AS Response FROM seg")
def prepare(spark, folder):
    k = F.col("ID")
    raw = c360(spark, folder).withColumns(
        {
            "Income": F.concat(F.lit("$"), F.col("Income").cast("string")),
            "NumDealsPurchases": F.when(k % 50 == 0, 40.0).otherwise(F.col("NumDealsPurchases")),
            "Response": F.when(k % 4 == 0, "maybe").otherwise(F.when(F.col("Response") == 1, "Yes").otherwise("n")),
        }
    )
    return scoring.prepare_for_scoring(raw).select("ID", "Income", "NumDealsPurchases", "Response")


@query("r2_distances", f"{_R_SQL} SELECT ID, " + ", ".join(f"round(d[{i + 1}], 9) AS d{i}" for i in range(4)) + " FROM r")
def distances(spark, folder):
    out = scoring.with_distances(_points(segmented(spark, folder)), _SCALED, _CENTERS)
    return out.select("ID", *[rnd(F.get("distances", F.lit(i)), 9).alias(f"d{i}") for i in range(4)])


@query("r3_predict", _R3_SQL)
def predict(spark, folder):
    return _predicted(spark, folder).select("ID", "Segment", "Segment_Name", "Distance_To_Centroid", "Assignment_Margin")


@query("r4_assignment_margin", f"{_R_SQL} SELECT ID, round(margin, 9) AS margin FROM r")
def margin(spark, folder):
    return _predicted(spark, folder).select("ID", rnd(scoring.assignment_margin(F.col("distances")), 9).alias("margin"))


@query("r5_fit_label", f"{_R_SQL} SELECT ID, CASE WHEN margin >= 0.25 THEN 'clear' WHEN margin >= 0.1 THEN 'moderate' ELSE 'borderline' END AS fit FROM r")
def fit_label(spark, folder):
    return _predicted(spark, folder).select("ID", scoring.fit_label(scoring.assignment_margin(F.col("distances"))).alias("fit"))


@query("e7_align_scores", f"{_R_SQL} SELECT r.ID, seg.Income, CAST(r.Segment AS BIGINT) AS Segment FROM r JOIN seg ON seg.ID = r.ID")
def align(spark, folder):
    return _predicted(spark, folder).select("ID", (F.round(F.col("income") * 5000, 6)).alias("Income"), "Segment")


@query("g27_score_mix", f"{_R_SQL} SELECT {_NAME_CASE} AS Segment_Name, count(*) / (SELECT count(*) FROM r) AS share, count(*) FILTER (WHERE round_even(margin, 3) < 0.1) AS borderline FROM r GROUP BY 1")
def score_mix(spark, folder):
    return P.score_mix(_predicted(spark, folder))


@query("r10_streaming_score", _R3_SQL)
def streaming(spark, folder):
    from kohort.streaming.score import read_customer_stream, write_scores

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = _points(segmented(spark, folder))
    source.write.parquet(f"{root}/in")
    stream = read_customer_stream(spark, f"{root}/in", source.schema)
    scored = scoring.predict(stream, _SCALED, _CENTERS, _NAMES).select("ID", "Segment", "Segment_Name", "Distance_To_Centroid", "Assignment_Margin")
    write_scores(scored, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("s7_distinct_guard", "SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT p_type, p_size FROM part)) >= 8 AS BIGINT) AS enough")
def distinct_guard(spark, folder):
    return spark.createDataFrame([(has_distinct_rows(table(spark, folder, "part"), ["p_type", "p_size"], 8),)], "enough boolean")


# ------------------------------------------------------------------ jobs that fit clusters (checked by rows here, by brute force in tests)
def _matrix(spark, folder):
    from kohort.operators.prep import customer_prep

    def build():
        df = segmented(spark, folder)
        return customer_prep(fv.FORMING).fit(df).transform(df).select("ID", *fv.FORMING)

    return staged(spark, folder, "scaled", build)


@query("k1_kmeans")
def fit_kmeans(spark, folder):
    df = _matrix(spark, folder)
    centers = km.kmeans(df, fv.FORMING, 4, "ID")
    return km.assign(df, fv.FORMING, centers).groupBy("Segment").agg(F.count("*").alias("rows"))


@query("k2_gaussian_mixture")
def mixture(spark, folder):
    df = _matrix(spark, folder)
    model = gmm.gaussian_mixture(df, fv.FORMING, 4, "ID")
    rows = gmm.assign_mixture(df, fv.FORMING, model).groupBy("component")
    return rows.agg(F.count("*").alias("rows"), rnd(F.avg("component_probability"), 3).alias("probability"), rnd(F.avg("component_log_likelihood"), 3).alias("log_likelihood"))


@query("k3_ward")
def hierarchy(spark, folder):
    df = _matrix(spark, folder)
    return ward.assign_ward(df, fv.FORMING, ward.fit_ward(df, fv.FORMING), 4).groupBy("cluster").agg(F.count("*").alias("rows"))


_MIXTURE_START = [(0.5, 9.5, 1.5, 1.0, 0.0, 1.0), (0.5, 10.8, 3.8, 1.0, 0.0, 1.0)]  # weight, means, variance, covariance, variance
_SCANS = 3


def _mixture_sql() -> str:
    """Scans of a mixture of two columns, one after another."""
    start = ", ".join(f"({j}, {', '.join(map(str, p))})" for j, p in enumerate(_MIXTURE_START))
    parts = [
        "WITH pts AS (SELECT row_number() OVER () AS id, ln(CAST(l_extendedprice AS DOUBLE)) AS x, CAST(l_quantity AS DOUBLE) / 10 AS y FROM lineitem)",
        f"p0 AS (SELECT CAST(j AS BIGINT) AS j, CAST(w AS DOUBLE) AS w, CAST(mx AS DOUBLE) AS mx, CAST(my AS DOUBLE) AS my, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c FROM (VALUES {start}) t(j, w, mx, my, a, b, c))",
    ]
    for i in range(_SCANS):
        parts += [
            f"""d{i} AS (SELECT id, x, y, j, w / (2 * pi() * sqrt(a * c - b * b))
  * exp(-0.5 * (c * pow(x - mx, 2) - 2 * b * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * c - b * b)) AS d FROM pts, p{i})""",
            f"r{i} AS (SELECT x, y, j, d / sum(d) OVER (PARTITION BY id) AS r FROM d{i})",
            f"m{i} AS (SELECT j, sum(r) AS n, sum(r * x) / sum(r) AS mx, sum(r * y) / sum(r) AS my FROM r{i} GROUP BY j)",
            f"""p{i + 1} AS (SELECT j, n / sum(n) OVER () AS w, mx, my, a / n + 1e-6 AS a, b / n AS b, c / n + 1e-6 AS c FROM (
  SELECT j, n, mx, my, sum(r * pow(x - mx, 2)) AS a, sum(r * (x - mx) * (y - my)) AS b, sum(r * pow(y - my, 2)) AS c FROM r{i} JOIN m{i} USING (j) GROUP BY j, n, mx, my))""",
        ]
    values = ", ".join(f"round({c}, 6) AS {n}" for c, n in zip(["w", "mx", "my", "a", "b", "c"], ["weight", "mean_x", "mean_y", "var_x", "cov_xy", "var_y"]))
    likelihood = f"SELECT round(avg(ln(d)), 6) FROM (SELECT sum(d) AS d FROM d{_SCANS - 1} GROUP BY id)"
    return ", ".join(parts) + f" SELECT j AS component, {values}, ({likelihood}) AS log_likelihood FROM p{_SCANS}"


@query("k2_mixture_scans", _mixture_sql())
def mixture_scans(spark, folder):
    df = table(spark, folder, "lineitem").select(F.log(F.col("l_extendedprice").cast("double")).alias("x"), (F.col("l_quantity").cast("double") / 10).alias("y"))
    start = np.array(_MIXTURE_START)
    model = gmm.Mixture(start[:, 0], start[:, 1:3], start[:, [3, 4, 4, 5]].reshape(-1, 2, 2))
    (model,) = gmm.fit_mixtures(df, ["x", "y"], [model], tol=0, max_iter=_SCANS)
    rows = [
        (j, *[round(float(v), 6) for v in (w, *m, c[0, 0], c[0, 1], c[1, 1], model.log_likelihood)])
        for j, (w, m, c) in enumerate(zip(model.weights, model.means, model.covariances))
    ]
    return spark.createDataFrame(rows, "component long, weight double, mean_x double, mean_y double, var_x double, cov_xy double, var_y double, log_likelihood double")


@query("k4_compare_algorithms")
def algorithms(spark, folder):
    return selection.compare_algorithms(_matrix(spark, folder), fv.FORMING, 4, "ID")


@query("k5_bootstrap_stability")
def stability(spark, folder):
    metrics, _ = selection.evaluate_k_range(_matrix(spark, folder), fv.FORMING, "ID")
    return metrics.select("k", "stability_ari")


@query("r9_pca")
def pca(spark, folder):
    df = _matrix(spark, folder)
    projection = scoring.Projection.fit(df, fv.FORMING, 3)
    return projection.transform(df).select("ID", *[rnd(F.abs(c), 3).alias(c) for c in ("PCA1", "PCA2", "PCA3")])


_models: dict = {}


def customer_model(spark, folder):
    """One fitted model per application and folder, shared by the queries below."""
    from kohort.plans.segmenter import fit_customers

    key = (spark.sparkContext.applicationId, folder)
    if key not in _models:
        _models[key] = fit_customers(c360(spark, folder), as_of=dt.date(2026, 1, 1))
    return _models[key]


@query("k13_fit_customers")
def fit_customers(spark, folder):
    return customer_model(spark, folder).tables["profiles"]


@query("g26_summary_table")
def summary_table(spark, folder):
    return customer_model(spark, folder).summary_table("k_selection")


@query("g40_diagnostics")
def diagnostics(spark, folder):
    parts = customer_model(spark, folder).diagnostics()
    sizes = [df.agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n, df in parts.items()]
    from kohort.operators.dedup import union_rows

    return union_rows(sizes)


@query("r6_assign")
def assign(spark, folder):
    out = customer_model(spark, folder).assign(c360(spark, folder))
    return out.select("ID", "Segment", "Segment_Name", "fit", "goal", F.size("warnings").alias("n_warnings"))


@query("r7_score_file")
def score_file(spark, folder):
    from kohort.sources.sinks import write_table

    path = f"{shared_folder(spark)}/upload-{uuid.uuid4().hex}.csv"
    write_table(c360(spark, folder).drop(fv.ROW_ORDER), path, "csv")
    return customer_model(spark, folder).score_file(spark, path).select("ID", "Segment", "Segment_Name", "Assignment_Margin")


@query("a11_save_load")
def save_load(spark, folder):
    from kohort.plans.segmenter import CustomerModel

    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    customer_model(spark, folder).save(path)
    return CustomerModel.load(spark, path).predict(c360(spark, folder)).select("ID", "Segment", "Distance_To_Centroid")


@query("l7_draft_vs_live")
def draft_vs_live(spark, folder):
    from kohort.operators.naming import draft_vs_live as compare

    model = customer_model(spark, folder)
    return compare(model.tables["profiles"], model.card["silhouette"], 4, 0.2)


@query("m1_synthesize")
def synthesize(spark, folder):
    from kohort.operators.synth import synthesize as make

    customers = customer_model(spark, folder).tables["customers"]
    return make(customers, customers.count())


@query("m2_fidelity")
def fidelity(spark, folder):
    from kohort.operators.synth import fidelity as share, synthesize as make

    model = customer_model(spark, folder)
    customers = model.tables["customers"]
    return share(model.predict(make(customers, customers.count())))


def rfm_model(spark, folder):
    from kohort.plans.rfm import train_rfm

    key = (spark.sparkContext.applicationId, folder, "rfm")
    if key not in _models:
        _models[key] = train_rfm(c360(spark, folder))
    return _models[key]


@query("k14_train_rfm")
def rfm(spark, folder):
    customers = rfm_model(spark, folder).customers
    return customers.groupBy("Cluster", "Persona").agg(F.count("*").alias("rows"), rnd(F.avg("Monetary"), 1).alias("avg_monetary"))


@query("r8_predict_rfm")
def predict_rfm(spark, folder):
    given = segmented(spark, folder).select(
        "ID", F.coalesce("Recency", F.lit(0.0)).alias("Recency"), F.col("Total_Purchases").alias("Frequency"), F.col("Total_Spend").alias("Monetary")
    )
    return rfm_model(spark, folder).predict(given).select("ID", "Cluster", "Persona")
