"""Ward's hierarchy over any number of rows, by clustering features.

A feature is (rows, mean, inner square sum) of rows that have been put together. Each task keeps at most ``leaves`` features: rows
that cost less to absorb than the dearest merge so far join the nearest feature, others open one, and when there are too many the
cheapest pairs that are nearest to each other are merged. Features of tasks are merged the same way, sixteen tasks at a time, until
one bounded list is left; Ward's merges over it are found by chains of nearest neighbours in the driver. Every row counts.

Where the distinct rows are no more than ``leaves``, features are single rows and the result is Ward's own; beyond, the upper part
of the hierarchy is Ward's over features, and may differ with the partitioning. Rows with a null or non-finite value take no part
and get a null label. Equal costs merge the lower-numbered features, which are in order of their means.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from kohort.operators import kmeans as km
from kohort.operators.mixture import usable
from kohort.session import spread, task_count

register_pickle_by_value(sys.modules[__name__])

LEAVES = 512
FAN_IN = 16
MANY = 4_096
PORTION = 512


def _costs(n: np.ndarray, means: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What merging each pair adds to the inner square sum."""
    gap = (means * means).sum(axis=1)[:, None] + (others * others).sum(axis=1)[None, :] - 2 * means @ others.T
    return np.maximum(gap, 0) * (n[:, None] * m[None, :] / (n[:, None] + m[None, :]))


class Features:
    """A bounded list of clustering features: rows, means, inner square sums."""

    def __init__(self, width: int, leaves: int):
        self.leaves, self.dearest = leaves, 0.0
        self.n, self.means, self.inner = np.zeros(0), np.zeros((0, width)), np.zeros(0)

    def _merge(self, n, means, inner, owner, size):
        """Fold features into ``size`` ones by ``owner``."""
        total = np.bincount(owner, n, size)
        mean = np.column_stack([np.bincount(owner, n * c, size) for c in means.T]) / total[:, None]
        spread_in = np.bincount(owner, inner + n * ((means - mean[owner]) ** 2).sum(axis=1), size)
        self.n, self.means, self.inner = total, mean, spread_in

    def add(self, n: np.ndarray, means: np.ndarray, inner: np.ndarray) -> None:
        for a in range(0, len(n), PORTION):
            self._add(n[a : a + PORTION], means[a : a + PORTION], inner[a : a + PORTION])

    def _add(self, n, means, inner):
        size = len(self.n)
        owner = np.arange(size, size + len(n))
        if size:
            cost = _costs(n, means, self.n, self.means)
            near = cost.argmin(axis=1)
            gap = ((means - self.means[near]) ** 2).sum(axis=1)
            join = (cost[np.arange(len(n)), near] < self.dearest) | (gap == 0)
            owner[join] = near[join]
        both = np.concatenate([self.n, n]), np.vstack([self.means, means]), np.concatenate([self.inner, inner])
        owner = np.concatenate([np.arange(size), owner])
        self._merge(*both, np.unique(owner, return_inverse=True)[1], len(np.unique(owner)))
        # equal means are one feature whatever their number
        _, same = np.unique(self.means, axis=0, return_inverse=True)
        self._merge(self.n, self.means, self.inner, same.ravel(), same.max() + 1)
        while len(self.n) > self.leaves:
            self._shrink()

    def _shrink(self):
        """Merge pairs that are nearest to each other, the cheapest first, as many as are needed."""
        cost = _costs(self.n, self.means, self.n, self.means)
        np.fill_diagonal(cost, np.inf)
        near = cost.argmin(axis=1)
        mine = np.arange(len(near))
        pairs = mine[(near[near] == mine) & (mine < near)]
        if not len(pairs):  # equal costs in a ring
            pairs = np.array([cost.min(axis=1).argmin()])
        pairs = pairs[np.argsort(cost[pairs, near[pairs]], kind="stable")][: len(near) - self.leaves]
        self.dearest = max(self.dearest, float(cost[pairs, near[pairs]].max()))
        owner = mine.copy()
        owner[near[pairs]] = pairs
        kept, owner = np.unique(owner, return_inverse=True)
        self._merge(self.n, self.means, self.inner, owner, len(kept))

    def frame(self, part: int, cols: list[str]):
        out = pd.DataFrame(self.means, columns=[f"m{i}" for i in range(len(cols))])
        return out.assign(n=self.n, inner=self.inner, part=np.int64(part))


def _folded(frames, cols: list[str], leaves: int, part: int):
    features = Features(len(cols), leaves)
    for frame in frames:
        features.add(frame["n"].to_numpy(), frame[[f"m{i}" for i in range(len(cols))]].to_numpy(), frame["inner"].to_numpy())
    return features.frame(part, cols)


def _leaves(cols: list[str], leaves: int):
    """Function for ``mapInPandas``: the features of a task's rows."""

    def run(batches):
        from pyspark import TaskContext

        features = Features(len(cols), leaves)
        for batch in batches:
            x, counts = np.unique(batch[cols].to_numpy(dtype=float), axis=0, return_counts=True)
            features.add(counts.astype(float), x, np.zeros(len(x)))
        if len(features.n):
            yield features.frame(TaskContext.get().partitionId(), cols)

    return run


def clustering_features(df: DataFrame, cols: list[str], leaves: int = LEAVES):
    """At most ``leaves`` features of all usable rows, as a pandas frame in order of their means."""
    rows = df.where(usable(cols)).select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    tasks = task_count(rows)
    # behind a shuffle the number is not known, and tasks are dealt over a fixed one
    tasks = MANY if tasks is None else max(tasks, df.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join([*[f"m{i} double" for i in range(len(cols))], "n double", "inner double", "part long"])
    found = spread(rows).mapInPandas(_leaves(cols, leaves), schema).withColumn("part", F.col("part") % tasks)

    def join(key, frame):
        order = [f"m{i}" for i in range(len(cols))]
        return _folded([frame.sort_values(["part", *order])], cols, leaves, key[0])

    while tasks > FAN_IN:
        found = found.groupBy(F.floor(F.col("part") / FAN_IN).alias("joined")).applyInPandas(join, schema)
        tasks = -(-tasks // FAN_IN)
    last = found.toPandas()  # at most FAN_IN x leaves rows
    means = [f"m{i}" for i in range(len(cols))]
    return _folded([last.sort_values(["part", *means])], cols, leaves, 0).sort_values(means, ignore_index=True) if len(last) else last


def ward_merges(n: np.ndarray, means: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, a, b) of all merges, cheapest first, by chains of nearest neighbours; a and b are members of the merged clusters."""
    n, means = n.astype(float).copy(), means.astype(float).copy()
    alive = np.ones(len(n), dtype=bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.nonzero(alive)[0][0])]
        a = chain[-1]
        cost = ((means - means[a]) ** 2).sum(axis=1) * (n * n[a] / (n + n[a]))
        cost[~alive] = np.inf
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((float(cost[b]), a, b))
            low, high = min(a, b), max(a, b)
            means[low] = (n[a] * means[a] + n[b] * means[b]) / (n[a] + n[b])
            n[low] = n[a] + n[b]
            alive[high] = False
        else:
            chain.append(b)
    return sorted(merges, key=lambda m: m[0])


@dataclass
class WardTree:
    """Features, and the merges that join them."""

    n: np.ndarray
    means: np.ndarray
    merges: list[tuple[float, int, int]]

    def labels(self, k: int) -> np.ndarray:
        """Cluster of each feature when ``k`` are left, numbered by the first feature of each."""
        top = np.arange(len(self.n))

        def root(i):
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for _, a, b in self.merges[: max(len(self.n) - k, 0)]:
            a, b = sorted((root(a), root(b)))
            top[b] = a
        return np.unique([root(i) for i in range(len(top))], return_inverse=True)[1]


def fit_ward(df: DataFrame, cols: list[str], leaves: int = LEAVES) -> WardTree:
    found = clustering_features(df, cols, leaves)
    n, means = found["n"].to_numpy(), found[[f"m{i}" for i in range(len(cols))]].to_numpy()
    return WardTree(n, means, ward_merges(n, means))


def assign_ward(df: DataFrame, cols: list[str], tree: WardTree, k: int, out: str = "cluster") -> DataFrame:
    """``df`` with the cluster of the feature whose mean is nearest; null where a value is missing."""
    labels, means = tree.labels(k), tree.means

    @F.pandas_udf("int")
    def judge(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        found = pd.Series(pd.array([None] * len(x), dtype="Int32"))
        ok = np.isfinite(x).all(axis=1)
        if len(means) and ok.any():
            found[ok] = labels[km._gaps(x[ok], means)[0]].astype("int32")
        return found

    return df.withColumn(out, judge(*[F.col(f"`{c}`").cast("double") for c in cols]))
