import numpy as np
import pandas as pd
import pytest

from kohort import fixed_values as fv
from kohort.operators import kmeans as km, metrics, selection


def brute(x: np.ndarray, lab: np.ndarray) -> np.ndarray:
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    size, row = np.bincount(lab), np.arange(len(x))
    sums = np.stack([dist[:, lab == c].sum(axis=1) for c in range(len(size))], axis=1)
    own = sums[row, lab] / (size[lab] - 1)
    means = sums / size
    means[row, lab] = np.inf
    return (means.min(axis=1) - own) / np.maximum(means.min(axis=1), own)


@pytest.mark.parametrize("blocks_per_strip", [1, 2, 5])
def test_a_pair_of_rows_is_measured_once(spark, monkeypatch, tmp_path, blocks_per_strip):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(430, 3)), 1)
    lab = {"a": (x[:, 0] > 0).astype(int), "b": np.arange(430) % 9}
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("xyz")).assign(id=range(430), **lab)).repartition(5)
    measure, seen = metrics._distances, str(tmp_path / "seen")

    def counted(a, b, *rest):
        with open(seen, "a") as f:
            f.write(f"{len(a) * len(b)}\n")
        return measure(a, b, *rest)

    monkeypatch.setattr(metrics, "_distances", counted)
    monkeypatch.setattr(metrics, "BLOCK", 40)
    monkeypatch.setattr(metrics, "PART", 16)
    monkeypatch.setattr(metrics, "STRIP", blocks_per_strip)
    out = metrics.silhouette_by_labeling(df, list("xyz"), {n: n for n in lab}, "id").collect()
    want = {n: brute(x, v).mean() for n, v in lab.items()}
    assert {r.labeling: r.silhouette for r in out} == pytest.approx(want, abs=1e-12)
    # half of the square of the rows, and what a part has with itself
    assert sum(map(int, open(seen))) < 430 * (430 + 2 * 16) / 2


def test_rows_of_each_labeling_come_once(spark, monkeypatch):
    x = np.repeat(np.arange(90.0), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "l": np.arange(180) % 2, "id": range(180)}))
    monkeypatch.setattr(metrics, "BLOCK", 7)
    monkeypatch.setattr(metrics, "PART", 3)
    got = {r.id: r.silhouette for r in metrics.silhouette_values(df, ["x"], "l", "id").collect()}
    assert np.allclose([got[i] for i in range(180)], brute(x[:, None], np.arange(180) % 2), atol=1e-12)


def test_the_comparison_shares_its_distances_with_the_final_clusters(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(np.vstack([rng.normal(c, 1, size=(80, 2)) for c in (0, 4, 9)]), 2)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"]).assign(id=range(240)))
    final = np.array([[0.0, 0.0], [4.0, 4.0], [9.0, 9.0]])
    want = metrics.silhouette_by_labeling(km.assign(df, ["x", "y"], final), ["x", "y"], {"f": "Segment"}, "id").first().silhouette
    whole, passes = metrics._tiled, []
    monkeypatch.setattr(metrics, "_tiled", lambda *a: passes.append(1) or whole(*a))
    table, silhouette = selection.compare_with(df, ["x", "y"], 3, "id", n_init=2, final=final)
    assert silhouette == pytest.approx(want, abs=1e-12) and len(passes) == 1
    assert [r.algorithm for r in table.collect()] == ["K-Means", "Gaussian Mixture", "Agglomerative (Ward)"]
    # a comparison on a sample cannot serve all rows
    rules = {**fv.RULES, "k_scan_sample": 100}
    _, silhouette = selection.compare_with(df, ["x", "y"], 3, "id", n_init=2, rules=rules, final=final)
    assert silhouette == pytest.approx(want, abs=1e-12) and len(passes) == 3


def test_a_sum_that_is_no_number_stays_with_its_cell():
    held = np.array([[1.0, 0, 1], [0, 1, 0]])
    sums, to = np.array([[1.0, 2], [np.nan, 4], [3, 5]]), np.zeros((2, 2))
    metrics._fold(held, sums, to)
    assert np.array_equal(to, [[4, 7], [np.nan, 4]], equal_nan=True)
