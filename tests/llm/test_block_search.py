import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from kohort.llm.block_search import nearest, products, quantised

SCHEMA = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("id", "string").add("rank", "integer")


def brute(rows, wanted, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(float))
    out = []
    for q in sorted(i for i in good if wanted(i)):
        near = []
        for i, vs in good.items():
            for v in vs:
                if i != q and len(v) == len(good[q][0]):
                    total = 0.0
                    for d in v - good[q][0]:
                        total += d * d
                    near.append((np.sqrt(total), i))
        out += [(q, r, i, d) for r, (d, i) in enumerate(sorted(near)[:k], start=1)]
    return out


@pytest.mark.parametrize("blocks", [(1024, 4096), (5, 40)])
def test_same_as_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(500, [0.0] * 16), (501, None), (502, []), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15), (505, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    rows += [(510, [1.0, 2.0]), (511, [1.0, 3.0]), (520, [5.0, 5.0, 5.0]), (10, rows[10][1])]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in nearest(docs, F.col("vec_id") % 10 == 0, 7, query_block=blocks[0], candidate_block=blocks[1]).collect())
    want = brute(rows[:-1], lambda i: i % 10 == 0, 7)
    assert got == want
    assert nearest(docs.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 2500)), rng.normal(size=(40, 2500)) * 100
    qi, qs, qn, qe = quantised(a)
    xi, xs, xn, xe = quantised(b)
    assert np.array_equal(products(qi, xi), qi.astype(np.int64) @ xi.astype(np.int64).T)
    near = products(qi, xi) * qs[:, None] * xs
    assert (np.abs(near - a @ b.T) <= qe[:, None] * xn + (qn + qe)[:, None] * xe + 1e-9).all()
