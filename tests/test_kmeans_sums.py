import numpy as np
import pandas as pd

from kohort.operators import kmeans as km


def blocks(spark, x, bits):
    rows = [(*map(float, r), int(b)) for r, b in zip(x, bits)]
    df = spark.createDataFrame(rows, "a double, b double, c double, m long").coalesce(2)
    return km.packed_rows(df, ["a", "b", "c"], "m").toPandas()


def test_sums_of_packed_rows_equal_those_by_hand(spark):
    rng = np.random.default_rng(3)
    x, bits = rng.normal(size=(5_000, 3)).round(1), rng.integers(0, 4, 5_000)
    packed = blocks(spark, x, bits)
    # a scan is sent a few blocks, not a row for each customer
    assert len(packed) <= 6
    runs = [(0, x[:2].copy(), None), (1, x[[5, 5, 7]].copy(), 0), (2, x[9:12].copy(), 1), (3, x[20:22].copy(), None)]
    got = pd.concat(km._partial_sums(runs, 3)([packed])).set_index(["run", "cluster"])
    for run, centers, member in runs:
        mine = x if member is None else x[(bits >> member) & 1 == 1]
        dist = (centers * centers).sum(axis=1)[None, :] - 2 * mine @ centers.T
        label = dist.argmin(axis=1)
        for j in range(len(centers)):
            rows = mine[label == j]
            if not len(rows):
                assert (run, j) not in got.index
                continue
            want = [*rows.sum(axis=0), len(rows), ((rows - centers[j]) ** 2).sum()]
            assert np.allclose(got.loc[(run, j)].to_numpy(dtype=float), want, atol=1e-6)


def test_an_empty_table_packs_to_nothing(spark):
    empty = spark.createDataFrame([], "a double, b double, c double, m long")
    assert km.packed_rows(empty, ["a", "b", "c"], None).count() == 0
