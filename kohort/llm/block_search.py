"""Nearest neighbours by a block matrix join: int8 tiles bound the distances, survivors are recomputed.

Queries and candidates are dealt into blocks; every block of queries meets every block of candidates in a tile of its own (a
grid join: each side is repeated along the blocks of the other). In a tile both sides are int8 with a scale for each vector.
Their integer products give every distance up to an error that the rounding residuals bound. Beginning with the candidates
that look nearest, a query recomputes in double precision, with the original vectors, all whose lower bound is not above its
k-th best so far, which a heap holds; the rest can't be among the k. The heaps of a query's tiles are merged by Spark. So the
result is exact, not approximate.

Vectors that are null, zero, empty or hold null or non-finite components take no part; vectors of different dimensions are
never compared. Ties go to the smaller id. Repeated rows (same id and vector) count once; rows with a null id take no part. If
an id has several vectors, each is a row of its own. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERIES = 1024
CANDIDATES = 4096


def usable(vector: str) -> Column:
    v = F.col(f"`{vector}`")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the length of each row and of what rounding took from it."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None])
    rest = x - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((x * x).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows; the sums of 1,024 products fit the 24 bits of a float."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added one after another."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        d = x[:, c] - q[c]
        total += d * d
    return np.sqrt(total)


def search_tile(q_ids, q, x_ids, x, k: int) -> list[tuple[int, int, float, int]]:
    """(row of q, id, distance, row of x) of the k nearest of each query in this tile, fewer if there are fewer."""
    qi, qs, qn, qe = quantised(q)
    xi, xs, xn, xe = quantised(x)
    near = products(qi, xi) * qs[:, None] * xs[None, :]
    error = qe[:, None] * xn[None, :] + (qn + qe)[:, None] * xe[None, :]
    square = (qn * qn)[:, None] + (xn * xn)[None, :] - 2 * near
    slack = 1e-9 * ((qn * qn)[:, None] + (xn * xn)[None, :]) + 1e-300
    low = np.maximum(square - 2 * error - slack, 0)
    out = []
    for r in range(len(q)):
        others = np.flatnonzero(x_ids != q_ids[r])
        if not len(others):
            continue
        first = others[np.argpartition(low[r, others], min(k, len(others)) - 1)[:k]]
        heap = [(-d, -int(x_ids[c]), -int(c)) for c, d in zip(first, distances(q[r], x[first]), strict=True)]
        heapq.heapify(heap)
        limit = -heap[0][0] if len(heap) == k else math.inf
        rest = others[low[r, others] <= limit * limit * (1 + 1e-9)]
        rest = np.setdiff1d(rest, first)
        rest = rest[np.argsort(low[r, rest], kind="stable")]
        for a in range(0, len(rest), 256):
            part = rest[a : a + 256]
            if len(heap) == k and low[r, part[0]] > heap[0][0] ** 2 * (1 + 1e-9):
                break
            for c, d in zip(part.tolist(), distances(q[r], x[part]).tolist(), strict=True):
                item = (-d, -int(x_ids[c]), -c)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        out += [(r, -i, -d, -c) for d, i, c in sorted(heap, reverse=True)]
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", query_block: int = QUERIES, candidate_block: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` to each row for which ``queries`` holds."""
    rows = vectors.where(F.col(f"`{id_column}`").isNotNull() & usable(vector)).select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).distinct()
    n = rows.agg(F.count("*").alias("x"), F.sum(F.col("q").cast("long")).alias("q")).first()
    nq, nx = max(1, -(-(n.q or 0) // query_block)), max(1, -(-n.x // candidate_block))
    deal = F.xxhash64("id", "v")
    left = rows.where("q").select("id", "v", F.size("v").alias("dim"), F.pmod(deal, F.lit(nq).cast("long")).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))).alias("xb"))
    right = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(deal, F.lit(nx).cast("long")).alias("xb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            q, x = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            found = search_tile(a["id"].to_numpy(), q, b["id"].to_numpy(), x, k)
        return pd.DataFrame({"query_id": [int(a["id"].iloc[f[0]]) for f in found], "of": [int(a["of"].iloc[f[0]]) for f in found], "vec_id": [f[1] for f in found], "score": [f[2] for f in found]}).astype({"query_id": "int64", "of": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "qb", "xb"]
    found = left.withColumn("of", F.xxhash64("v")).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, "query_id long, of long, vec_id long, score double")
    best = Window.partitionBy("query_id", "of").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
