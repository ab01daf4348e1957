"""Gaussian mixtures with full covariances, fitted by expectation and maximisation in scans that all restarts share.

A scan is one Spark job: each task weighs its rows by the components of every restart that still runs and emits sums (weight,
first and second moments about the component's present mean, log-likelihood). The driver holds parameters only: runs x components x
dimensions squared, whatever the number of rows. A restart begins with the clusters of a K-Means run from a seed of its own.

Rows with a null or non-finite value in a column take no part in the fit and get a null component. Repeated rows count as often as
they occur. Rows that several components explain equally go to the lowest one. A table without usable rows raises ``ValueError``.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from kohort.operators import kmeans as km
from kohort.session import spread, task_count

register_pickle_by_value(sys.modules[__name__])

BLOCK = 4_096  # rows weighed at a time in a task


@dataclass
class Mixture:
    """Parameters of one mixture; ``log_likelihood`` is the mean per row that the last scan saw."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = float("-inf")
    converged: bool = False

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of weight times density, rows by components."""
        out = np.empty((len(x), len(self.weights)))
        for j, (w, mean, cov) in enumerate(zip(self.weights, self.means, self.covariances)):
            root = np.linalg.cholesky(cov)
            scaled = np.linalg.solve(root, (x - mean).T)
            norm = len(mean) * np.log(2 * np.pi) + 2 * np.log(np.diag(root)).sum()
            out[:, j] = np.log(w) - 0.5 * (norm + (scaled * scaled).sum(axis=0))
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each component in each row, and the row's log-likelihood."""
        logs = self.log_densities(x)
        top = logs.max(axis=1)
        shares = np.exp(logs - top[:, None])
        total = shares.sum(axis=1)
        return shares / total[:, None], top + np.log(total)


@dataclass
class Clusters:
    """Centres that a run starts from: every row belongs wholly to the nearest one."""

    means: np.ndarray

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = km._labels(x, self.means)
        return (near[:, None] == np.arange(len(self.means))).astype(float), np.full(len(x), -np.inf)


def _moments(active: list[tuple[int, Mixture | Clusters]], cols: list[str]):
    """Function for ``mapInPandas``: sums of every run, as (run, slot, value); slot 0 is the log-likelihood."""
    width = len(cols)
    upper = np.triu_indices(width)
    line = 1 + width + len(upper[0])

    def run(batches):
        sums = [np.zeros((len(m.means), line)) for _, m in active]
        logs = np.zeros(len(active))
        for batch in batches:
            values = batch[cols].to_numpy(dtype=float)
            for a in range(0, len(values), BLOCK):
                x = values[a : a + BLOCK]
                for i, (_, model) in enumerate(active):
                    shares, log = model.responsibilities(x)
                    logs[i] += log.sum()
                    for j, mean in enumerate(model.means):
                        gap = x - mean
                        held = shares[:, j, None] * gap
                        sums[i][j, 0] += shares[:, j].sum()
                        sums[i][j, 1 : 1 + width] += held.sum(axis=0)
                        sums[i][j, 1 + width :] += (held.T @ gap)[upper]
        for (number, _), log, block in zip(active, logs, sums):
            flat = np.concatenate([[log], block.ravel()])
            yield pd.DataFrame({"run": np.int32(number), "slot": np.arange(len(flat), dtype=np.int32), "value": flat})

    return run


def _maximised(model: Mixture | Clusters, flat: np.ndarray, reg: float) -> tuple[Mixture, float]:
    """Parameters after a scan, and the mean log-likelihood of those before it."""
    k, width = model.means.shape
    upper = np.triu_indices(width)
    block = flat[1:].reshape(k, -1)
    rows = block[:, 0].sum()
    n = block[:, 0] + 10 * np.finfo(float).eps
    shift = block[:, 1 : 1 + width] / n[:, None]
    cov = np.zeros((k, width, width))
    cov[:, upper[0], upper[1]] = block[:, 1 + width :] / n[:, None]
    cov[:, upper[1], upper[0]] = cov[:, upper[0], upper[1]]
    cov -= shift[:, :, None] * shift[:, None, :]
    cov[:, np.arange(width), np.arange(width)] += reg
    return Mixture(n / n.sum(), model.means + shift, cov), float(flat[0] / rows)


def usable(cols: list[str]) -> Column:
    """True where every column holds a finite number."""
    ok = F.lit(True)
    for c in cols:
        v = F.col(f"`{c}`").cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return ok


def fit_mixtures(
    df: DataFrame, cols: list[str], starts: list[Mixture | Clusters], tol: float = 1e-3, reg: float = 1e-6, max_iter: int | None = None
) -> list[Mixture]:
    """Every start carried on until its mean log-likelihood gains less than ``tol``, or for ``max_iter`` scans.

    ``df`` is read once per scan: persist it or read it from a table. ``reg`` is added to the variances.
    """
    rows = df.where(usable(cols)).select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    tasks = task_count(rows)
    # the sums of a few tasks can be added here; those of many tasks are added by the cluster first
    few = tasks is not None and max(tasks, df.sparkSession.sparkContext.defaultParallelism) <= km.DIRECT_TASKS
    dealt = spread(rows)
    if dealt is not rows:
        dealt.persist()
    models: list[Mixture | Clusters] = list(starts)
    try:
        for _ in itertools.count() if max_iter is None else range(max_iter):
            active = [(i, m) for i, m in enumerate(models) if not getattr(m, "converged", False)]
            if not active:
                break
            parts = dealt.mapInPandas(_moments(active, cols), "run int, slot int, value double")
            if not few:
                parts = parts.groupBy("run", "slot").agg(F.sum("value").alias("value"))
            totals = parts.toPandas().groupby(["run", "slot"])["value"].sum()
            for number, before in active:
                flat = totals[number].sort_index().to_numpy() if len(totals) else np.zeros(len(before.means) + 1)
                if not flat[1 :: (len(flat) - 1) // len(before.means)].sum() > 0:
                    raise ValueError("no usable rows to fit a mixture on")
                after, seen = _maximised(before, flat, reg)
                after.log_likelihood = seen
                after.converged = isinstance(before, Mixture) and abs(seen - before.log_likelihood) < tol
                models[number] = after
    finally:
        if dealt is not rows:
            dealt.unpersist()
    return models


def gaussian_mixture(
    df: DataFrame,
    cols: list[str],
    k: int,
    key: str,
    n_init: int = 3,
    seed: int = 42,
    tol: float = 1e-3,
    reg: float = 1e-6,
    max_iter: int | None = None,
) -> Mixture:
    """The likeliest of ``n_init`` mixtures of ``k`` components, numbered by their means' first coordinates."""
    clean = df.where(usable(cols))
    if clean.isEmpty():
        raise ValueError("no usable rows to fit a mixture on")
    runs = km.fit_runs(clean, cols, [km.Run(k, seed + i) for i in range(n_init)], key, seed=seed)
    fitted = fit_mixtures(clean, cols, [Clusters(r.centers) for r in runs], tol, reg, max_iter)
    best = max(fitted, key=lambda m: m.log_likelihood)
    order = np.lexsort(best.means.T[::-1])
    return Mixture(best.weights[order], best.means[order], best.covariances[order], best.log_likelihood, best.converged)


def assign_mixture(df: DataFrame, cols: list[str], model: Mixture, out: str = "component") -> DataFrame:
    """``df`` with the likeliest component, its probability (``out``_probability) and the row's log-likelihood."""
    @F.pandas_udf("component int, probability double, log_likelihood double")
    def judge(*values: pd.Series) -> pd.DataFrame:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        ok = np.isfinite(x).all(axis=1)
        shares, logs = model.responsibilities(x[ok])
        found = pd.DataFrame({"component": shares.argmax(axis=1), "probability": shares.max(axis=1), "log_likelihood": logs}, index=np.nonzero(ok)[0])
        return found.reindex(range(len(x))).astype({"component": "Int32"})

    judged = judge(*[F.col(f"`{c}`").cast("double") for c in cols])
    names = {"component": out, "probability": f"{out}_probability", "log_likelihood": f"{out}_log_likelihood"}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in names.values()]
    held = "_".join(["judged", *df.columns])
    return df.select(*keep, judged.alias(held)).select(*keep, *[F.col(f"`{held}`.{f}").alias(n) for f, n in names.items()])
