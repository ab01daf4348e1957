"""Gaussian mixtures against a textbook fit, Ward's hierarchy against brute force, and their edge cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.operators import mixture as gmm, ward


def _blobs(spark, sizes, centers, seed=3, scale=0.5):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, scale, (n, len(c))) for n, c in zip(sizes, centers)])
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")


def _textbook(x, weights, means, covs, scans, reg=1e-6):
    """Expectation and maximisation, row by row as defined."""
    for _ in range(scans):
        dens = np.array([[w * np.exp(-0.5 * (r - m) @ np.linalg.inv(c) @ (r - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(weights, means, covs)] for r in x])
        shares = dens / dens.sum(axis=1, keepdims=True)
        n = shares.sum(axis=0)
        weights, means = n / len(x), (shares.T @ x) / n[:, None]
        covs = np.array([((shares[:, j, None] * (x - means[j])).T @ (x - means[j])) / n[j] + reg * np.eye(x.shape[1]) for j in range(len(n))])
    return weights, means, covs, np.log(dens.sum(axis=1)).mean()


def test_scans_equal_the_textbook_fit_for_all_starts_at_once(spark):
    x, df = _blobs(spark, [150, 60, 90], [(0, 0), (2, 1), (1, 4)], scale=0.9)
    x = x + 1e4  # far from the origin: moments must not cancel
    df = df.select("id", (F.col("a") + 1e4).alias("a"), (F.col("b") + 1e4).alias("b"))
    starts = [gmm.Mixture(np.full(k, 1 / k), x[i : i + 40 * k : 40], np.array([np.eye(2)] * k)) for k, i in ((2, 0), (3, 7), (3, 90))]
    for start, got in zip(starts, gmm.fit_mixtures(df.repartition(7), ["a", "b"], starts, tol=0, max_iter=5)):
        weights, means, covs, log = _textbook(x, start.weights, start.means, start.covariances, 5)
        np.testing.assert_allclose(got.weights, weights, rtol=1e-6)
        np.testing.assert_allclose(got.means, means, rtol=1e-9)
        np.testing.assert_allclose(got.covariances, covs, rtol=1e-5, atol=1e-7)
        assert got.log_likelihood == pytest.approx(log, rel=1e-8) and not got.converged


def test_mixture_finds_stretched_components_and_converges(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(600, 2)) * [6, 0.3], rng.normal(size=(300, 2)) * [0.3, 6] + [0, 12]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    model = gmm.gaussian_mixture(df, ["a", "b"], 2, "id")
    assert model.converged
    got = gmm.assign_mixture(df, ["a", "b"], model).orderBy("id").toPandas()
    true = np.repeat([0, 1], [600, 300])
    assert max((got["component"] == true).mean(), (got["component"] != true).mean()) > 0.97
    assert got["component_log_likelihood"].mean() == pytest.approx(model.log_likelihood, abs=1e-2)


def test_mixture_of_nulls_repeats_constants_and_clashing_names(spark):
    rows = [(i, float(i % 2) * 5, 1.0) for i in range(40)] + [(40, None, 1.0), (41, float("nan"), 1.0), (42, 0.0, float("inf"))]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("judged", F.lit("x")).withColumn("run", F.lit(1))
    model = gmm.gaussian_mixture(df, ["a", "b"], 2, "id")
    got = gmm.assign_mixture(df, ["a", "b"], model, "run").orderBy("id").collect()
    assert [r["run"] for r in got] == [i % 2 for i in range(40)] + [None] * 3
    assert got[0]["judged"] == "x" and np.allclose(model.weights, 0.5)
    with pytest.raises(ValueError):
        gmm.gaussian_mixture(df.where("id >= 40"), ["a", "b"], 2, "id")


def _brute_ward(x, k):
    """Merge the pair that adds least to the inner square sum until k clusters are left."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        def cost(p):
            g, h = x[groups[p[0]]], x[groups[p[1]]]
            return len(g) * len(h) / (len(g) + len(h)) * ((g.mean(axis=0) - h.mean(axis=0)) ** 2).sum()

        a, b = min(itertools.combinations(range(len(groups)), 2), key=cost)
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def _groups(df, out="cluster"):
    return {frozenset(r["ids"]) for r in df.where(f"{out} is not null").groupBy(out).agg(F.collect_list("id").alias("ids")).collect()}


@pytest.mark.parametrize("k", [1, 2, 3, 6, 11])
def test_ward_equals_brute_force_where_features_are_rows(spark, k):
    x, df = _blobs(spark, [25, 8, 30], [(0, 0), (2, 1), (1, 3)], seed=k)
    tree = ward.fit_ward(df.repartition(5), ["a", "b"])
    assert _groups(ward.assign_ward(df, ["a", "b"], tree, k)) == _brute_ward(x, k)


def test_bounded_features_count_every_row_and_keep_clear_clusters(spark):
    sizes = [3_000, 200, 1_000]
    x, df = _blobs(spark, sizes, [(0, 0), (9, 1), (1, 9)])
    found = ward.clustering_features(df.repartition(40), ["a", "b"], leaves=32)  # joined in levels, as there are over 16 tasks
    assert len(found) <= 32 and found["n"].sum() == len(x)
    means = found[["m0", "m1"]].to_numpy()
    np.testing.assert_allclose((found["n"].to_numpy() @ means) / len(x), x.mean(axis=0), atol=1e-9)
    between = (found["n"].to_numpy() * ((means - x.mean(axis=0)) ** 2).sum(axis=1)).sum()
    assert found["inner"].sum() + between == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    tree = ward.fit_ward(df.repartition(40), ["a", "b"], leaves=32)
    assert sorted(map(len, _groups(ward.assign_ward(df, ["a", "b"], tree, 3)))) == sorted(sizes)


def test_ward_of_nulls_repeats_and_empty_tables(spark):
    rows = [(i, float(i % 3 * 4), 0.0) for i in range(3_000)] + [(3_000, None, 0.0), (3_001, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    tree = ward.fit_ward(df, ["a", "b"], leaves=3)
    assert sorted(tree.n) == [1_000] * 3 and [m[0] for m in tree.merges] == sorted(m[0] for m in tree.merges)
    got = ward.assign_ward(df, ["a", "b"], tree, 3)
    assert sorted(map(len, _groups(got))) == [1_000] * 3 and got.where("cluster is null").count() == 2
    empty = df.where("id < 0")
    assert ward.assign_ward(df, ["a", "b"], ward.fit_ward(empty, ["a", "b"]), 3).where("cluster is not null").count() == 0
