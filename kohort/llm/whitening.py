"""Whitening of embeddings by the covariance of their distinct values.

Vectors are turned into whole numbers, x = floor(scale * c), and equal x vectors are grouped first: a vector that a third of
all rows share leaves each task once, is fitted and whitened once, and its result is joined back to its rows. The fit gives
each distinct vector the weight one, or its number of rows (``by_count``). Sums are exact whole numbers; the covariance is
added up from products of centred blocks in the tasks (a matrix of dims x dims per task, summed by Spark), its eigenvectors
are found in the driver (dims x dims again, whatever the number of rows). Then every distinct vector is projected once.

Rows take no part if their vector is null or empty, holds null or non-finite entries or entries that leave the range of
bigint, or has another length than most (ties: the longer one). Components are numbered by falling eigenvalue and end where
the eigenvalues are 0 within rounding, so constant vectors give no rows. The sign of a component is that of its largest
entry. Null ids and repeated rows are kept. ``deviation`` is exact: decimal(38,0), null beyond 38 digits. An empty table gives
an empty one, and other columns play no part.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kohort.session import stage_table

#: Distinct vectors of more rows than one in so many of all get several places in the join; so there are at most so many.
HOT_SHARE = 1000
_LIMIT = 10**38


def whole_numbers(vector: Column, scale: int) -> Column:
    """array<bigint> of floor(scale * c), or null where the vector takes no part."""
    entries = F.transform(vector, lambda c: c.cast("double") * scale)
    sound = F.forall(entries, lambda c: F.coalesce(F.abs(c) < 9.2e18, F.lit(False)))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & sound, F.transform(F.when(sound, entries), lambda c: F.floor(c)))


@dataclass
class Fit:
    """``n`` (weight of the fit list), exact ``sums``, ``components`` (dims x k), ``eigenvalues`` (k) and ``trace``."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: int64 where it fits, whole numbers of any size otherwise."""
    most = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _blocks(batches, rows: int = 4096):
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _exact_sums(batches):
    """Per task and dimension: low 32 bits and the rest of all weighted entries."""
    total: np.ndarray | None = None
    weight = 0
    for part in _blocks(batches):
        x, w = _matrix(part.column(0)), part.column(1).to_numpy()
        weight += int(w.sum())
        high, low = x >> 32, x & 0xFFFFFFFF
        sums = [sum(a) for a in zip((int(v) << 32 for v in (high.astype(object) * w[:, None]).sum(axis=0)), map(int, (low.astype(object) * w[:, None]).sum(axis=0)), strict=True)] if (w > 1).any() else [(int(h) << 32) + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
        total = np.array(sums, dtype=object) if total is None else total + np.array(sums, dtype=object)
    if total is not None:
        at = pa.array(range(len(total)), pa.int32())
        numbers = pa.array([decimal.Decimal(int(v)) for v in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([at, numbers, pa.array([weight] * len(total), pa.int64())], names=["i", "s", "w"])


def _centred_products(n: int, sums: list[int]):
    def run(batches):
        total = np.zeros((len(sums), len(sums)))
        for part in _blocks(batches):
            centred = (_deviations(_matrix(part.column(0)), n, sums) / n).astype(np.float64)
            total += (centred * part.column(1).to_numpy()[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def fit(distinct: DataFrame, components: int) -> Fit | None:
    """``distinct``: x (array<bigint>) and w (its weight). None for an empty table."""
    parts = distinct.mapInArrow(_exact_sums, "i int, s decimal(38,0), w bigint").groupBy("i").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    found = sorted(parts.collect())  # a row for each dimension
    if not found:
        return None
    n, sums = int(found[0].w), [int(r.s) for r in found]
    rows = distinct.mapInArrow(_centred_products(n, sums), "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
    cov = np.zeros((len(sums), len(sums)))
    for r in cells.collect():  # a row for each dimension
        cov[r.i] = [c.v for c in r.row]
    cov = (cov + cov.T) / (2 * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > values[0] * len(sums) * 1e-14).sum()) if values[0] > 0 else 0
    vectors = vectors[:, :k] * np.where(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return Fit(n, sums, np.ascontiguousarray(vectors), values[:k].copy(), float(np.trace(cov)))


def _project(model: Fit):
    scaled = model.components / np.sqrt(model.eigenvalues)

    def run(batches):
        for part in _blocks(batches):
            apart = _deviations(_matrix(part.column(0)), model.n, model.sums)
            white = (apart / model.n).astype(np.float64) @ scaled
            squares = (apart.astype(object) ** 2).sum(axis=1)
            exact = pa.array([decimal.Decimal(int(v)) if v < _LIMIT else None for v in squares], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), exact, pa.array(white.tolist(), pa.list_(pa.float64()))], names=["x", "w", "copies", "deviation", "white"])

    return run


def _identity_error(white: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    z = [F.col("white")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = white.agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * z[i]).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("w") * z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    if r.n is None or not k:
        return None
    return max(abs(r[f"p{i}_{j}"] / r.n - r[f"s{i}"] * r[f"s{j}"] / r.n**2 - (i == j)) for i, j in pairs)


OUT = T.StructType().add("component", "integer").add("n", "long").add("deviation", T.DecimalType(38, 0)).add("whitened", "double").add("explained", "double").add("identity_error", "double")


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4, by_count: bool = False) -> DataFrame:
    """``id_column``, component (from 1), n, deviation (sum of (n*x-S)^2), whitened, explained, identity_error; see the module."""
    spark = rows.sparkSession
    source = rows.select(F.col(f"`{id_column}`").alias("id"), whole_numbers(F.col(f"`{vector}`"), scale).alias("x")).where("x is not null")
    grouped = stage_table(source.groupBy("x").agg(F.count("*").alias("copies")), "vectors")
    usual = grouped.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], T.StructType([T.StructField(id_column, source.schema["id"].dataType), *OUT.fields]))
    if usual is None:
        return empty
    weight = F.col("copies") if by_count else F.lit(1).cast("long")
    distinct = grouped.where(F.size("x") == usual.d).select("x", weight.alias("w"), "copies")
    model = fit(distinct.select("x", "w"), components)
    k = len(model.eigenvalues)
    if not k:
        return empty
    white = stage_table(distinct.mapInArrow(_project(model), "x array<bigint>, w bigint, copies bigint, deviation decimal(38,0), white array<double>"), "whitened")
    error = _identity_error(white, k)
    # rows of a hot vector are dealt over as many places as it is hot; HOT_SHARE such vectors at most, by their share of rows
    many = max(1000, usual.n // HOT_SHARE)
    places = F.ceil(F.col("copies") / many).cast("long")
    hot = grouped.where(F.col("copies") > many).select("x", places.alias("places"))
    dealt = source.join(F.broadcast(hot), "x", "left").withColumn("place", F.coalesce(F.pmod(F.monotonically_increasing_id(), "places"), F.lit(0).cast("long")))
    spread = white.withColumn("place", F.explode(F.when(F.col("copies") > many, F.sequence(F.lit(0).cast("long"), places - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    out = dealt.join(spread.select("x", "place", "deviation", "white"), ["x", "place"]).select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_column),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
