"""K-Means with many restarts and many k in the same scans.

Every Lloyd iteration is one Spark job for all runs that have not converged: each task assigns its rows to
the centres of every run and emits only sums per (run, cluster), so twenty restarts cost the scans of one.
The driver holds the centres, never the rows. Seeding is k-means|| over all rows: a few scans draw candidates by squared distance
from those drawn before, one more counts the rows nearest to each, and k-means++ runs on the weighted candidates.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from kohort.operators.metrics import add
from kohort.session import spread, task_count

# task functions travel with the job, so executors need numpy and pandas but not this package
register_pickle_by_value(sys.modules[__name__])

SEEDING_ROWS = 2_000  # tables with fewer rows are seeded from all of them
ROUND_ROWS = 256
ROUNDS = 4
DIRECT_TASKS = 64


@dataclass
class Run:
    """One K-Means run; ``member`` limits its rows to those with that bit set in the mask column."""

    k: int
    seed: int
    member: int | None = None
    centers: np.ndarray | None = field(default=None, repr=False)
    inertia: float = float("inf")
    done: bool = False


def seeding_sample(df: DataFrame, cols: list[str], key: str, mask: str | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``SEEDING_ROWS`` rows, picked by hash."""
    extra = [mask] if mask else []
    rows = df.select(key, *cols, *extra).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(SEEDING_ROWS).toPandas()
    bits = rows[mask].to_numpy(dtype=np.int64) if mask else np.zeros(len(rows), dtype=np.int64)
    return rows[cols].to_numpy(dtype=float), bits


def _gaps(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row and the squared distance to it, in blocks of rows."""
    label, gap = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for a in range(0, len(x), 1_000):
        part = x[a : a + 1_000]
        near = label[a : a + 1_000] = _labels(part, centers)
        gap[a : a + 1_000] = ((part - centers[near]) ** 2).sum(axis=1)
    return label, gap


def _draw(candidates: np.ndarray, cols: list[str], n: int):
    """Function for ``mapInPandas``: of each task the n rows that lead a draw by squared distance, without replacement."""

    def run(batches):
        import pandas as pd

        best = None
        for batch in batches:
            _, gap = _gaps(batch[cols].to_numpy(dtype=float), candidates)
            u = (batch["_u"].to_numpy() + 0.5) / (1 << 30)
            with np.errstate(divide="ignore"):
                batch = batch[cols].assign(_score=-np.log(u) / gap)[gap > 0]
            best = (batch if best is None else pd.concat([best, batch])).nsmallest(n, "_score")
        if best is not None:
            yield best

    return run


def _weigh(candidates: np.ndarray, cols: list[str], mask: str | None, members: list[int | None]):
    """Function for ``mapInPandas``: rows nearest to each candidate, of all and of each member."""

    def run(batches):
        import pandas as pd

        total = np.zeros((len(members), len(candidates)))
        for batch in batches:
            near, _ = _gaps(batch[cols].to_numpy(dtype=float), candidates)
            bits = batch[mask].to_numpy(dtype=np.int64) if mask else None
            for m, member in enumerate(members):
                mine = near if member is None else near[(bits >> member) & 1 == 1]
                total[m] += np.bincount(mine, minlength=len(candidates))
        at = np.nonzero(total)
        yield pd.DataFrame({"member": at[0], "candidate": at[1], "n": total[at]})

    return run


def seeding_candidates(df: DataFrame, cols: list[str], key: str, mask: str | None, members: list[int | None], seed: int) -> tuple[np.ndarray, dict]:
    """Candidates for centres, and the weight of each by member (None: all rows)."""
    points, bits = seeding_sample(df, cols, key, mask, seed)
    if len(points) < SEEDING_ROWS:
        return points, {m: np.ones(len(points)) if m is None else ((bits >> m) & 1).astype(float) for m in members}
    points = points[:ROUND_ROWS]
    rows = spread(df.select(key, *cols, *([mask] if mask else [])))
    schema = ", ".join(f"`{c}` double" for c in [*cols, "_score"])
    for i in range(ROUNDS):
        u = F.pmod(F.xxhash64(F.col(key), *cols, F.lit(seed + 7919 * (i + 1))), F.lit(1 << 30)).alias("_u")
        drawn = rows.select(*cols, u).mapInPandas(_draw(points, cols, ROUND_ROWS), schema).orderBy("_score", *cols).limit(ROUND_ROWS).toPandas()
        points = np.unique(np.vstack([points, drawn[cols].to_numpy(dtype=float)]), axis=0)
    counts = rows.mapInPandas(_weigh(points, cols, mask, members), "member int, candidate int, n double")
    weights = np.zeros((len(members), len(points)))
    for row in counts.groupBy("member", "candidate").agg(F.sum("n").alias("n")).collect():
        weights[row["member"], row["candidate"]] = row["n"]
    return points, dict(zip(members, weights))


def plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ seeding of weighted points: each next centre is the best of a few draws proportional to squared distance."""
    rng = np.random.default_rng(seed)
    share = weights / weights.sum()
    chosen = [points[rng.choice(len(points), p=share)]]
    closest = ((points - chosen[0]) ** 2).sum(axis=1)
    trials = 2 + int(np.log(k))
    while len(chosen) < k:
        cost = closest * weights
        total = cost.sum()
        picks = rng.choice(len(points), trials, p=share if total <= 0 else cost / total)
        options = np.minimum(closest, ((points[None, :, :] - points[picks][:, None, :]) ** 2).sum(axis=2))
        best = (options * weights).sum(axis=1).argmin()
        chosen.append(points[picks[best]])
        closest = options[best]
    return np.array(chosen)


#: Rows of a packed block, and cells of distances that are held at once while sums are made.
SUM_ROWS, SUM_CELLS = 2_000, 100_000


def _nearest_cells(dist: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
    """1.0 where a centre (second axis) is the first nearest of its run (first axis) to a row (third) that is in the run."""
    hot = dist == dist.min(axis=1, keepdims=True)
    if np.count_nonzero(hot) != hot.shape[0] * hot.shape[2]:  # ties, or numbers that are none
        hot = dist.argmin(axis=1)[:, None, :] == np.arange(dist.shape[1])[None, :, None]
    return (hot if inside is None else hot & inside[:, None, :]).astype(float)


def packed_rows(df: DataFrame, cols: list[str], mask: str | None) -> DataFrame:
    """(x, bits): the numbers and the masks of at most ``SUM_ROWS`` rows in one, so that a scan does not pay for each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols))], axis=1)
            bits = batch.column(len(cols)).to_numpy(zero_copy_only=False)
            places = range(0, len(x), SUM_ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[a : a + SUM_ROWS].tobytes() for a in places], pa.binary()) for v in (x, bits)], names=["x", "bits"]
            )

    bits = F.col(mask) if mask else F.lit(0)
    return df.select(*[F.col(c).cast("double") for c in cols], bits.cast("long").alias("_m")).mapInArrow(run, "x binary, bits binary")


def _partial_sums(runs: list[tuple[int, np.ndarray, int | None]], width: int):
    """Function for ``mapInPandas``: ``packed_rows`` to per-(run, cluster) sums. Runs of as many centres share their products."""
    begin = np.cumsum([0] + [len(c) for _, c, _ in runs])
    drawn = {m for _, _, m in runs}
    groups = []
    for k in dict.fromkeys(len(c) for _, c, _ in runs):
        alike = [i for i, (_, c, _) in enumerate(runs) if len(c) == k]
        step = max(1, SUM_CELLS // (SUM_ROWS * k))
        for a in range(0, len(alike), step):
            part = alike[a : a + step]
            centers = np.vstack([runs[i][1] for i in part])
            # squared distance without the row's own norm, as one product
            factor = np.hstack([-2 * centers, (centers * centers).sum(axis=1)[:, None]])
            places = (begin[part][:, None] + np.arange(k)).reshape(-1)
            groups.append((k, places, factor, [runs[i][2] for i in part]))

    def run(batches):
        import pandas as pd

        totals = np.zeros((begin[-1], width + 2))
        for batch in batches:
            for values, masks in zip(batch["x"], batch["bits"]):
                x, bits = np.frombuffer(values).reshape(-1, width), np.frombuffer(masks, dtype=np.int64)
                payload = np.hstack([x, np.ones((len(x), 1)), (x * x).sum(axis=1)[:, None]])
                ahead = np.ascontiguousarray(payload[:, : width + 1].T)
                within = {m: np.ones(len(x), dtype=bool) if m is None else (bits >> m) & 1 == 1 for m in drawn}
                for k, places, factor, members in groups:
                    dist = (factor @ ahead).reshape(-1, k, len(x))
                    inside = None if all(m is None for m in members) else np.stack([within[m] for m in members])
                    totals[places] += _nearest_cells(dist, inside).reshape(-1, len(x)) @ payload
        # squared distances of a cluster's rows follow from its sums
        for _, places, factor, _ in groups:
            mine = totals[places]
            totals[places, width + 1] += (mine[:, : width + 1] * factor).sum(axis=1)
        index = [(run_id, j) for run_id, centers, _ in runs for j in range(len(centers))]
        out = pd.DataFrame(totals, columns=[*[f"s{i}" for i in range(width)], "n", "cost"])
        out.insert(0, "cluster", [j for _, j in index])
        out.insert(0, "run", [r for r, _ in index])
        yield out[out["n"] > 0]

    return run


def fit_runs(
    df: DataFrame, cols: list[str], runs: list[Run], key: str, mask: str | None = None, max_iter: int | None = None, tol: float = 1e-4, seed: int = 42
) -> list[Run]:
    """Fit all ``runs`` on ``df`` (persist it or read it from a table). Fills in centres and inertia.

    Runs go on until they converge; with ``max_iter`` one may end earlier, and its ``done`` is False then.
    """
    members = [None, *sorted({r.member for r in runs if r.member is not None})]
    points, weights = seeding_candidates(df, cols, key, mask, members, seed)
    for r in runs:
        if r.centers is None:
            mine = weights[r.member]
            r.centers = plus_plus(points, mine if np.count_nonzero(mine) >= r.k else weights[None], r.k, r.seed)
    mean = np.average(points, axis=0, weights=weights[None])
    scale = tol * float(np.average((points - mean) ** 2, axis=0, weights=weights[None]).mean())
    width = len(cols)
    names = [*[f"s{i}" for i in range(width)], "n", "cost"]
    schema = "run int, cluster int, " + ", ".join(f"{c} double" for c in names)
    selected = df.select(*cols, *([mask] if mask else []))
    tasks = task_count(selected)
    dealt = spread(selected)
    packed = packed_rows(dealt, cols, mask).persist()  # else every iteration would deal and pack the rows anew
    # the sums of a few tasks can be added here; those of many tasks are added by the cluster first
    cores = df.sparkSession.sparkContext.defaultParallelism
    few_tasks = tasks is not None and max(tasks, cores) <= DIRECT_TASKS
    try:
        for _ in itertools.count() if max_iter is None else range(max_iter):
            active = [(i, r.centers, r.member) for i, r in enumerate(runs) if not r.done]
            if not active:
                break
            sums = packed.mapInPandas(_partial_sums(active, width), schema)
            if not few_tasks:
                sums = sums.groupBy("run", "cluster").agg(*[F.sum(c).alias(c) for c in names])
            rows = sums.toPandas()
            start = {i: at for (i, _, _), at in zip(active, np.cumsum([0] + [len(c) for _, c, _ in active]))}
            old = np.vstack([c for _, c, _ in active])
            owner = np.repeat([i for i, _, _ in active], [len(c) for _, c, _ in active])
            at = rows["run"].map(start).to_numpy() + rows["cluster"].to_numpy()
            total = np.zeros((len(old), width + 2))
            np.add.at(total, at, rows[names].to_numpy())
            seen = total[:, width] > 0
            fresh = np.where(seen[:, None], total[:, :width] / np.where(seen, total[:, width], 1)[:, None], old)
            moved = np.bincount(owner, ((fresh - old) ** 2).sum(axis=1), minlength=len(runs))
            cost = np.bincount(owner, total[:, width + 1], minlength=len(runs))
            for i, centers, _ in active:
                r = runs[i]
                r.centers = fresh[start[i] : start[i] + len(centers)]
                r.inertia = float(cost[i])  # cost of the centres used for this assignment
                r.done = not moved[i] > scale
    finally:
        packed.unpersist()
    return runs


def _labels(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1)[None, :] - 2 * x @ centers.T).argmin(axis=1)


def label_many(df: DataFrame, cols: list[str], models: dict[str, np.ndarray], key: str) -> DataFrame:
    """(key, cols…, one label column per model). For a single model ``assign`` stays in generated code;
    dozens of models would exceed the size of one generated method."""
    kinds = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            x = batch[cols].to_numpy(dtype=float)
            yield batch.assign(**{name: _labels(x, c).astype("int32") for name, c in models.items()})

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [key, *cols]] + [f"`{m}` int" for m in models])
    return df.select(key, *cols).mapInPandas(run, schema)


def label_agreement(df: DataFrame, cols: list[str], pairs: list[tuple[int, int, np.ndarray, np.ndarray]]) -> DataFrame:
    """(k, run, ref, label, n): contingency counts of two models per (k, run), combined inside each task."""

    def run(batches):
        import pandas as pd

        cells = [np.zeros((len(a), len(b)), dtype=np.int64) for _, _, a, b in pairs]
        for batch in batches:
            x = batch[cols].to_numpy(dtype=float)
            cached = {}
            for cell, (k, _, a, b) in zip(cells, pairs):
                if k not in cached:
                    cached[k] = _labels(x, a)
                np.add.at(cell, (cached[k], _labels(x, b)), 1)
        rows = [
            (k, r, i, j, int(cell[i, j])) for cell, (k, r, _, _) in zip(cells, pairs) for i, j in zip(*np.nonzero(cell))
        ]
        yield pd.DataFrame(rows, columns=["k", "run", "ref", "label", "n"])

    parts = df.select(*cols).mapInPandas(run, "k int, run int, ref int, label int, n long")
    return parts.groupBy("k", "run", "ref", "label").agg(F.sum("n").alias("n"))


def best_by_k(runs: list[Run]) -> dict[int, Run]:
    best: dict[int, Run] = {}
    for r in runs:
        if r.k not in best or r.inertia < best[r.k].inertia:
            best[r.k] = r
    return best


def kmeans(
    df: DataFrame, cols: list[str], k: int, key: str, n_init: int = 20, seed: int = 42, max_iter: int | None = None, start: np.ndarray | None = None
) -> np.ndarray:
    """Centres of the restart with the lowest inertia, ordered by their first coordinates for a stable labeling.

    ``start`` replaces the restarts by one run from given centres, such as the winner on a sample.
    """
    runs = [Run(k, seed + i) for i in range(n_init)] if start is None else [Run(k, seed, centers=np.asarray(start))]
    centers = best_by_k(fit_runs(df, cols, runs, key, max_iter=max_iter, seed=seed))[k].centers
    return centers[np.lexsort(centers.T[::-1])]


def distance_array(cols: list[str], centers) -> Column:
    """Array of Euclidean distances to literal centres: a projection, without shuffle or Python."""
    one = lambda center: F.sqrt(
        add([(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, center)])
    )
    return F.array(*[one(c) for c in centers])


def nearest(distances: Column) -> Column:
    """Index of the smallest distance, the lowest index on ties."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def assign(df: DataFrame, cols: list[str], centers, out: str = "Segment") -> DataFrame:
    return df.withColumn("_distances", distance_array(cols, centers)).withColumn(out, nearest(F.col("_distances"))).drop("_distances")


def relabel_by_size(df: DataFrame, label: str = "Segment") -> dict[int, int]:
    """Old label to new label, numbered from 0 by descending size (old label on ties); one row per label."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).collect()
    return {r[label]: i for i, r in enumerate(sizes)}
