"""Known values, row-order and partition independence, and skew."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.functions import scalars as S
from kohort.functions.text import filter_phrases
from kohort.operators import dedup, filters, metrics, reshape
from kohort.operators.features import engineer_features
from kohort.operators.prep import corrected_skewness
from kohort.operators.quantiles import average_ranks, exact_quantiles
from kohort.operators.selection import find_elbow, recommend_k
from kohort.sources import columns, readers, sinks


def test_one_hot_decoding(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 1)], "Edu_A int, Edu_B int")
    assert [r[0] for r in reshape.decode_one_hot(df, "Edu", "Base").collect()] == ["A", "Base", None]


def test_one_hot_with_many_dummies(spark):
    cols = [f"D_{i}" for i in range(662)]
    df = spark.createDataFrame([tuple(int(i == j) for i in range(662)) for j in (0, 300, 661)], cols)
    assert [r[0] for r in reshape.decode_one_hot(df, "D", "none").collect()] == ["0", "300", "661"]


def test_engineered_features(spark):
    values = {c: 0.0 for c in fv.NUMERIC} | {
        "Year_Birth": 1980.0, "Income": 50_000.0, "Kidhome": 1.0, "Teenhome": 1.0, "MntWines": 100.0, "MntMeatProducts": 100.0,
        "NumDealsPurchases": 2.0, "NumWebPurchases": 2.0, "NumStorePurchases": 2.0, "AcceptedCmp1": 1.0, "Response": 1.0,
    }
    df = spark.createDataFrame([tuple(values.values()) + (dt.date(2014, 1, 1),)], ", ".join(f"{c} double" for c in values) + ", Dt_Customer date")
    r = engineer_features(df, "2014-06-29").first()
    assert (r.Total_Spend, r.Total_Purchases, r.Avg_Order_Value, r.Deal_Ratio) == (200, 4, 50, 0.5)
    assert (r.Campaigns_Accepted, r.Children, r.Age, r.Tenure_Days, r.Is_Parent) == (2, 2, 34, 179, "Parent")


def test_corrected_skewness(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x double")
    assert df.agg(corrected_skewness("x")).first()[0] == pytest.approx(2.2324, abs=1e-4)


def test_elbow_and_recommendation(spark):
    df = spark.createDataFrame(list(zip(range(2, 9), map(float, (100, 60, 30, 26, 23, 21, 20)))), "k int, inertia double")
    assert find_elbow(df).first()[0] == 4
    rows = [(k, i, 0.3 - 0.01 * k, 100.0 - k, 1.0 + 0.1 * k, 0.2, 0.9) for k, i in zip(range(2, 9), map(float, (100, 60, 30, 26, 23, 21, 20)))]
    table = spark.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, min_segment_share double, stability_ari double")
    assert recommend_k(table).filter("recommended").first().k == 4
    # nothing eligible: the best composite over all rows wins
    assert recommend_k(table.withColumn("stability_ari", F.lit(0.1))).filter("recommended").first().k == 2


def test_filter_phrases(spark):
    text = "income over 70k and spend <= 1,500 and web visits between 3 and 6"
    found = spark.range(1).select(F.inline(filter_phrases(F.lit(text)))).collect()
    assert {tuple(r) for r in found} == {
        ("Income", ">", 70_000.0), ("Total_Spend", "<=", 1500.0), ("NumWebVisitsMonth", ">=", 3.0), ("NumWebVisitsMonth", "<=", 6.0)
    }


def test_text_guard(spark):
    df = spark.createDataFrame([('=HYPERLINK("http://x")',), ("safe",), ("+1",), ("@cmd",), (None,)], "t string")
    assert [r[0] for r in sinks.sanitize_text(df).collect()] == ["'=HYPERLINK(\"http://x\")", "safe", "'+1", "'@cmd", None]


def test_numbers_flags_dates(spark):
    rows = [("$58,138", "Yes", "1-1-2013"), ("58138 USD", "f", "31-02-2014"), ("N/A", "2", "March 5, 2013"), ("1d", "-1", "2013-05-06 10:11:12"), ("NaN", "1.0", "15/06/2031")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.select(S.to_number(F.col("a")).alias("a"), S.to_flag(F.col("b")).alias("b"), S.parse_date(F.col("c")).alias("c")).collect()
    assert [r.a for r in got] == [58138.0, 58138.0, None, None, None]
    assert [r.b for r in got] == [1.0, 0.0, None, None, 1.0]
    assert [r.c for r in got] == [dt.date(2013, 1, 1), None, dt.date(2013, 3, 5), dt.date(2013, 5, 6), dt.date(2031, 6, 15)]


def test_unknown_requests_are_rejected(spark):
    df = spark.createDataFrame([(0, 1.0, "x")], "Segment int, Income double, Education string")
    for bad in (lambda: filters.segment_in(df, [9], [0]), lambda: filters.comparison(df, "None", ">", 1), lambda: filters.comparison(df, "Education", ">", 1), lambda: filters.comparison(df, "Income", ">", "x")):
        with pytest.raises(filters.BadRequest):
            bad()


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_quantiles_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(3, 2, 20_000), np.zeros(10_000)])  # a third of the rows share one value
    g = np.where(np.arange(30_000) % 3 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x})).repartition(parts)
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, ["x"], [0.01, 0.25, 0.5, 0.8, 0.99], ["g"]).collect()}
    for (key, p), v in got.items():
        assert v == pytest.approx(np.quantile(x[g == key], p), rel=1e-12, abs=1e-12)
    assert len(got) == 10


@pytest.mark.parametrize("n", [1, 2, 3, 11, 113, 1125, 12_001])
def test_quantiles_of_any_size(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for r in exact_quantiles(df, ["x"], [0.0, 0.01, 0.5, 0.99, 1.0]).collect():
        assert r.value == pytest.approx(np.quantile(x, r.prob), rel=1e-12, abs=1e-12)


def test_average_ranks_with_ties(spark):
    x = np.random.default_rng(0).integers(0, 300, 20_000).astype(float)
    got = {r["value"]: r["rank"] for r in average_ranks(spark.createDataFrame(pd.DataFrame({"x": x})), "x").collect()}
    assert (pd.Series(x).map(got) - pd.Series(x).rank()).abs().max() < 1e-9


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_duplicates_keep_the_first_row(spark, parts):
    n = 6_000
    pdf = pd.DataFrame({"ID": [None if i % 7 == 0 else (1 if i % 3 == 0 else i) for i in range(n)], "v": [i % 50 for i in range(n)], fv.ROW_ORDER: range(n)})
    df = spark.createDataFrame(pdf.astype({"ID": "Int64"})).repartition(parts)
    kept = dedup.drop_duplicate_ids(df).toPandas().sort_values(fv.ROW_ORDER)
    want = pdf[pdf.ID.isna() | ~pdf.ID.duplicated()]
    assert kept[fv.ROW_ORDER].tolist() == want[fv.ROW_ORDER].tolist()
    filled = dedup.fill_missing_ids(df).toPandas().sort_values(fv.ROW_ORDER)
    gaps = pdf.ID.isna().to_numpy()
    assert filled.ID[gaps].tolist() == list(range(int(pdf.ID.max()) + 1, int(pdf.ID.max()) + 1 + gaps.sum()))


def test_hot_id_is_cut_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("ID"), F.col("id").alias(fv.ROW_ORDER))
    plan = dedup.drop_duplicate_ids(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    lab = rng.integers(0, 4, 400)
    lab[0] = 4  # a cluster with one member
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(label=lab, id=range(400)))
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))

    def sil(i):
        same = lab == lab[i]
        if same.sum() == 1:
            return 0.0
        a = dist[i][same].sum() / (same.sum() - 1)
        b = min(dist[i][lab == c].mean() for c in set(lab) if c != lab[i])
        return (b - a) / max(a, b)

    for sample in (5_000, None):
        got = metrics.silhouette_values(df, list("abc"), "label", "id", sample=sample).toPandas().set_index("id").silhouette
        assert len(got) == 400 and max(abs(got[i] - sil(i)) for i in range(400)) < 1e-9
    dist = dist**2
    got = metrics.silhouette_values(df, list("abc"), "label", "id", distance="squared").toPandas().set_index("id").silhouette
    assert len(got) == 400 and max(abs(got[i] - sil(i)) for i in range(400)) < 1e-9
    q = metrics.partition_quality(df, list("abc"), "label").first()
    cs = {c: x[lab == c].mean(axis=0) for c in set(lab)}
    w = sum(((x[lab == c] - m) ** 2).sum() for c, m in cs.items())
    b = sum((lab == c).sum() * ((m - x.mean(axis=0)) ** 2).sum() for c, m in cs.items())
    s = {c: np.sqrt(((x[lab == c] - m) ** 2).sum(axis=1)).mean() for c, m in cs.items()}
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cs[i] - cs[j]) for j in cs if j != i) for i in cs])
    assert q.inertia == pytest.approx(w) and q.calinski_harabasz == pytest.approx((b / 4) / (w / 395)) and q.davies_bouldin == pytest.approx(db)


def test_file_formats_agree(spark, tmp_path):
    rows = [{"ID": i, "Annual Income": 1000 + i, "Education": "PhD"} for i in range(20)]
    pd.DataFrame(rows).to_csv(tmp_path / "t.csv", index=False)
    pd.DataFrame(rows).to_csv(tmp_path / "t.tsv", index=False, sep="\t")
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "wrapped.json").write_text(json.dumps({"customers": rows}))
    (tmp_path / "columns.json").write_text(json.dumps({k: {str(i): r[k] for i, r in enumerate(rows)} for k in rows[0]}))
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    frames = []
    for name in ("t.csv", "t.tsv", "list.json", "wrapped.json", "columns.json", "t.jsonl"):
        df, renames = columns.normalize_columns(readers.read_table(spark, str(tmp_path / name)))
        assert renames == {"Annual Income": "Income"}
        frames.append(sorted(tuple(map(str, r)) for r in df.select("ID", "Income", "Education").collect()))
    assert all(f == frames[0] for f in frames) and len(frames[0]) == 20
    for bad in ("t.xlsx", "t"):
        with pytest.raises(readers.UnreadableTable):
            readers.read_table(spark, str(tmp_path / bad))
    with pytest.raises(readers.UnreadableTable):
        columns.guard_rows(spark.range(5), 1, 4)


def test_published_versions(spark, tmp_path):
    store = sinks.PublishedTables(spark, str(tmp_path / "store"))
    assert store.live() is None
    for v in ("v1", "v2", "v3", "v4"):
        store.publish(v, {"t": spark.createDataFrame([(v,)], "v string")})
    assert store.versions() == ["v2", "v3", "v4"] and store.live() == "v4" and store.table("t").first()[0] == "v4"
    store.reset()
    assert store.live() is None and store.status().filter("live").count() == 0


def test_dates_and_numbers_of_many_layouts(spark):
    day = dt.date(2013, 3, 5)
    texts = ["5 March 2013", "Mar 5, 2013", "05-Mar-2013", "05/03/2013 10:11", "2013/3/5 10:00", "5/3/13", "20130305", "2013-03-05T10:11:12", "5.3.2013", "5-3-2013 1:02 PM", "2013-3-5"]
    other = {"3/15/2013": dt.date(2013, 3, 15), "15/3/85": dt.date(1985, 3, 15), "31/2/2013": None, "nonsense": None, "": None, "2013": None}
    df = spark.createDataFrame([(t, day) for t in texts] + list(other.items()), "t string, want date")
    rows = df.select("t", "want", S.parse_date(F.col("t")).alias("got"), S.parse_date(F.col("t"), iso_first=True).alias("iso")).collect()
    assert all(r.got == r.want and r.iso == r.want for r in rows), [r for r in rows if r.got != r.want or r.iso != r.want]
    numbers = {"1e150": 1e150, "1E-200": 1e-200, "1e400": None, "12": 12.0, "9" * 250: float("9" * 250), "9" * 400: None}
    rows = spark.createDataFrame(list(numbers.items()), "t string, want double").select("want", S.to_number(F.col("t")).alias("a"), S.to_number_any(F.col("t")).alias("b")).collect()
    assert all(r.a == r.want == r.b for r in rows)


def test_spearman_ranks_complete_pairs(spark):
    from kohort.operators.explore import spearman

    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.integers(0, 30, (200, 4)).astype(float), columns=list("abcd"))
    frame["b"] += frame["a"]
    for c in "bcd":
        frame.loc[rng.random(200) < 0.3, c] = None
    want = {(x, y): frame[[x, y]].dropna().rank().corr().iloc[0, 1] for x in "abcd" for y in "abcd" if x < y}
    rows = [tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)]
    got = {(r.a, r.b): r.rho for r in spearman(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_silhouette_over_many_blocks(spark, monkeypatch):
    """Separate groups, so that parts are passed over; repeated points; clashing column names."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(330, 2)) + 1e4 + np.repeat(np.arange(6), 55)[:, None] * 30
    x[5] = x[6] = x[7]
    labels = {"k6": np.repeat(np.arange(6), 55), "k2": np.repeat([0, 1], 165), "one": np.zeros(330, int)}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for name, lab in labels.items():
        size = np.bincount(lab)
        means = np.stack([dist[:, lab == c].sum(axis=1) for c in range(len(size))], axis=1) / size
        own = means[np.arange(330), lab] * size[lab] / (size[lab] - 1)
        means[np.arange(330), lab] = np.inf
        other = means.min(axis=1) if len(size) > 1 else own
        want[name] = ((other - own) / np.maximum(own, other)).mean()
    df = spark.createDataFrame(pd.DataFrame(x, columns=["s0", "key"]).assign(id=range(330), **labels)).repartition(7)
    monkeypatch.setattr(metrics, "BLOCK", 60)
    monkeypatch.setattr(metrics, "PART", 16)
    got = metrics.silhouette_by_labeling(df, ["s0", "key"], {n: n for n in labels}, "id").collect()
    assert {r.labeling: r.silhouette for r in got} == pytest.approx(want, abs=1e-9)
    assert metrics.silhouette_by_labeling(df.limit(0), ["s0", "key"], {"k6": "k6"}, "id").collect() == []


def test_silhouette_returns_every_row(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 3).alias("label"), *[((F.col("id") * p) % 101 + (F.col("id") % 3) * 40).cast("double").alias(f"x{p}") for p in (7, 13)])
    out = metrics.silhouette_values(df, ["x7", "x13"], "label", "id")
    assert out.count() == out.select("id").distinct().count() == 30_000


def test_duplicates_ignore_the_row_order(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (2, "a", 2)], f"x int, y string, `{fv.ROW_ORDER}` int")
    assert dedup.count_duplicates(df).first()[0] == 1


def test_profiles_rank_whole_values_and_all_columns(spark):
    from kohort.operators.quality import table_profile, text_column_stats

    start = "https://example.org/" + "a" * 30
    values = [f"{start}/{i}" for i in range(5)] + ["short"] * 3
    df = spark.createDataFrame([(v, "s") for v in values], "url string, Segment_Name string")
    assert {r["column"]: r.top for r in table_profile(df).collect()}["url"].startswith("short (3), ")
    rows = text_column_stats(df, "url").where("Segment_Name is null").collect()
    assert len(rows) == len({r.value for r in rows}) == 6
    wide = spark.range(2).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)])
    assert table_profile(wide).count() == 60


def test_dates_are_decided_by_all_rows(spark):
    from kohort.operators.anytable import plan_columns

    rows = [(i, "unknown" if i < 200 else f"20{10 + i % 10}-0{1 + i % 9}-1{i % 10}") for i in range(3000)]
    df = spark.createDataFrame(rows, "_row_order long, moment string").withColumnRenamed("_row_order", fv.ROW_ORDER)
    assert [c.kind for c in plan_columns(df)] == ["date"]


def test_mean_of_a_group(spark):
    from kohort.operators.impute import attach_group_mean

    rows = [(1, "a", 2.0), (2, "a", 4.0), (3, None, 5.0), (4, None, None), (5, "b", None), (5, "b", None)]
    df = spark.createDataFrame(rows, "id int, `g.x` string, v double")
    got = sorted((r.id, r.m) for r in attach_group_mean(df, "v", "g.x", "m").collect())
    assert got == [(1, 3.0), (2, 3.0), (3, 5.0), (4, 5.0), (5, None), (5, None)]
    assert attach_group_mean(df.limit(0), "v", "g.x", "m").count() == 0
    with pytest.raises(ValueError):
        attach_group_mean(df, "v", "g.x", "id")


def test_silhouette_moves_each_row_once(spark, monkeypatch):
    """What is shuffled grows with the rows: blocks pass by without a group of rows, or of sums, for each pair of blocks."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 3)), 1)
    lab = {"a": (x[:, 0] > 0).astype(int), "b": np.arange(300) % 9}
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("xyz")).assign(id=range(300), **lab))
    monkeypatch.setattr(metrics, "BLOCK", 40)
    monkeypatch.setattr(metrics, "PART", 16)
    out = metrics.silhouette_values(df, list("xyz"), "b", "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "InPandas" not in plan
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    means = np.stack([dist[:, lab["b"] == c].sum(axis=1) for c in range(9)], axis=1)
    size = np.bincount(lab["b"])
    row = np.arange(300)
    own = means[row, lab["b"]] / (size[lab["b"]] - 1)
    means = means / size
    means[row, lab["b"]] = np.inf
    want = (means.min(axis=1) - own) / np.maximum(means.min(axis=1), own)
    got = {r.id: r.silhouette for r in out.collect()}
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-9)
