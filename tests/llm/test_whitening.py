import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from kohort.llm.whitening import whiten

SCHEMA = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("x", "string").add("n", "integer").add("white", "integer")


def brute(rows, components=4, by_count=False):
    """Exact sums, covariance and eigenvectors of the distinct vectors: {id: [(n, deviation, whitened)]}, explained."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in kept] if by_count else sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for x in fit])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        apart = [n * x[j] - sums[j] for j in range(d)]
        out.append((i, n, sum(a * a for a in apart), (np.array(apart) / n) @ v / np.sqrt(e)))
    return out, e / np.trace(cov)


def check(got, rows, **how):
    want, explained = brute(rows, **how)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == 4 * len(want)
    for i, n, deviation, white in want:
        mine = [r for r in by[i]]
        assert {r.n for r in mine} == {n} and {int(r.deviation) for r in mine if abs(abs(r.whitened) - abs(white[r.component - 1])) < 1e-9} >= {deviation}
    assert {r.component: r.explained for r in got} == pytest.approx({k + 1: x for k, x in enumerate(explained)}, rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)
    signs = {}
    for i, _, deviation, white in want:
        for r in by[i]:
            if int(r.deviation) == deviation and abs(white[r.component - 1]) > 1e-6:
                signs.setdefault(r.component, set()).add(bool(r.whitened * white[r.component - 1] > 0))
    assert all(len(s) == 1 for s in signs.values())


def vectors(n=60, d=7, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) * np.arange(1, d + 1) / 3).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("by_count", [False, True])
def test_same_as_brute_force(spark, by_count):
    rows = vectors()
    same = rows[3][1]
    rows += [(100 + i, same) for i in range(40)] + [(200, None), (201, []), (202, [None] * 7), (203, [float("nan")] + [0.0] * 6), (204, [float("inf")] + [0.0] * 6), (205, [-0.0] * 7)]
    got = whiten(frame(spark, rows), by_count=by_count).collect()
    check(got, rows, by_count=by_count)


def test_hot_vector_is_dealt_out(spark, monkeypatch):
    import kohort.llm.whitening as module

    rows = vectors(30) + [(1000 + i, [0.5] * 7) for i in range(2500)]
    got = module.whiten(frame(spark, rows)).collect()
    assert len(got) == 4 * len(rows)
    hot = {(r.component, r.whitened, r.deviation) for r in got if r.vec_id >= 1000}
    assert len(hot) == 4


def test_odd_tables(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no spread
    rows = vectors(20, 5)
    other = rows + [(90, [1.0, 2.0]), (91, [3e18] * 5)]
    assert len(whiten(frame(spark, other)).collect()) == 80  # another length; out of range
    two = whiten(frame(spark, [(i, [float(i), float(i * i % 7)]) for i in range(9)])).collect()
    assert {r.component for r in two} == {1, 2}
    nulls = whiten(frame(spark, [(None, v) for _, v in rows])).collect()
    assert len(nulls) == 80 and {r.vec_id for r in nulls} == {None}


def test_large_numbers_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1e12, 1e12) for _ in range(5)]) for i in range(50)]
    check(whiten(frame(spark, rows)).collect(), rows)


def test_query_equals_brute_force(spark, folder):
    from kohort.llm.queries import QUERIES

    rows = [(int(i), [float(c) for c in v]) for i, v in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas().itertuples(index=False)]
    got = QUERIES["op12_whitening"](spark, folder)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), rows)
