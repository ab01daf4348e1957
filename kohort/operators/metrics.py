"""Cluster quality from a label column and numeric feature columns.

All metrics take ``by`` so that many candidate labelings (one per k) are scored in one job. The sums are
plain partial aggregates per (by, label); nothing is gathered per cluster.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kohort.operators.sampling import first_by_hash
from kohort.session import stage_table

# task functions travel with the job, so executors need numpy and pandas but not this package
register_pickle_by_value(sys.modules[__name__])


def feature_columns(df: DataFrame, vector: str, size: int, prefix: str = "x") -> tuple[DataFrame, list[str]]:
    """Spread an array column into DOUBLE columns (cast first: FLOAT subtraction would lose digits)."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.select("*", *[F.get(vector, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


def add(terms: list[Column]) -> Column:
    """Balanced sum, so a wide table does not give a deep expression."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def squared_distance(cols: list[str], to: list[str]) -> Column:
    return add([(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(cols, to)])


def centroids(df: DataFrame, cols: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.groupBy(*by, label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols])


def cluster_scatter(df: DataFrame, cols: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """One row per (by, label): size, centroid, within sum of squares and mean distance to the centroid."""
    keys = [*(by or []), label]
    means = centroids(df, cols, label, by).filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    found = means.collect()  # one row per (by, label)
    place = {tuple(r[k] for k in keys): i for i, r in enumerate(found)}
    centers = np.array([[r[f"m_{c}"] for c in cols] for r in found], dtype=float).reshape(len(found), len(cols))

    def partial(batches):
        import pandas as pd

        within, reach, n = np.zeros(len(place)), np.zeros(len(place)), np.zeros(len(place))
        for batch in batches:
            at = np.array([place.get(k, -1) for k in zip(*[batch[k].tolist() for k in keys])], dtype=int)
            d2 = ((batch[cols].to_numpy(dtype=float) - centers[at]) ** 2).sum(axis=1)
            known = (at >= 0) & ~np.isnan(d2)
            at, d2 = at[known], d2[known]
            np.add.at(n, at, 1)
            np.add.at(within, at, d2)
            np.add.at(reach, at, np.sqrt(d2))
        yield pd.DataFrame({"_at": range(len(place)), "_w": within, "_r": reach, "_n": n})

    # tasks emit a row per cluster, whatever the size of the clusters
    sums = df.select(*dict.fromkeys([*keys, *cols])).mapInPandas(partial, "_at int, _w double, _r double, _n double").groupBy("_at").agg(F.sum("_w").alias("within"), F.sum("_r").alias("_r"), F.sum("_n").alias("_n")).collect()
    total = {r["_at"]: r for r in sums}
    rows = [(*[r[k] for k in keys], r["n"], *[r[f"m_{c}"] for c in cols], total[i]["within"], total[i]["_r"] / total[i]["_n"] if total[i]["_n"] else None) for i, r in enumerate(found)]
    schema = T.StructType([*means.schema.fields, T.StructField("within", T.DoubleType()), T.StructField("spread", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema)


def inertia(df, cols, label, by=None) -> DataFrame:
    by = by or []
    return cluster_scatter(df, cols, label, by).groupBy(*by).agg(F.sum("within").alias("inertia"))


def partition_quality(df: DataFrame, cols: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """(by…, k, n, inertia, calinski_harabasz, davies_bouldin, min_segment_share) from one scatter table."""
    by = by or []
    scatter = cluster_scatter(df, cols, label, by)
    return quality_from_scatter(scatter, cols, label, by)


def quality_from_scatter(scatter: DataFrame, cols: list[str], label: str, by: list[str]) -> DataFrame:
    means = [f"m_{c}" for c in cols]
    w = Window.partitionBy(*by) if by else Window.partitionBy()  # one row per cluster
    grand = [(F.sum(F.col(m) * F.col("n")).over(w) / F.sum("n").over(w)).alias(f"g_{m}") for m in means]
    between = squared_distance(means, [f"g_{m}" for m in means])
    sums = (
        scatter.select(*by, label, "n", "within", *means, *grand)
        .withColumn("_between", F.col("n") * between)
        .groupBy(*by)
        .agg(
            F.count("*").alias("k"),
            F.sum("n").alias("n"),
            F.sum("within").alias("inertia"),
            F.sum("_between").alias("_b"),
            F.min("n").alias("_least"),
        )
    )
    ch = F.try_divide(F.col("_b") * (F.col("n") - F.col("k")), F.col("inertia") * (F.col("k") - 1))
    base = sums.select(
        *by,
        "k",
        "n",
        "inertia",
        F.coalesce(ch, F.lit(1.0)).alias("calinski_harabasz"),
        (F.col("_least") / F.col("n")).alias("min_segment_share"),
    )
    db = davies_bouldin_from(scatter, means, label, by)
    # a single cluster has no other to compare with
    if not by:
        return base.withColumn("davies_bouldin", F.coalesce(db.scalar(), F.lit(0.0)))
    return base.join(db, by, "left").withColumn("davies_bouldin", F.coalesce("davies_bouldin", F.lit(0.0)))


def davies_bouldin_from(scatter: DataFrame, means: list[str], label: str, by: list[str]) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij. Joins the k-row cluster table with itself."""
    left = scatter.select(*by, F.col(label).alias("_i"), F.col("spread").alias("_si"), *means)
    right = scatter.select(
        *[F.col(b).alias(f"_o_{b}") for b in by],
        F.col(label).alias("_j"),
        F.col("spread").alias("_sj"),
        *[F.col(m).alias(f"o_{m}") for m in means],
    )
    cond = reduce(lambda a, b: a & b, [F.col(b) == F.col(f"_o_{b}") for b in by], F.col("_i") != F.col("_j"))
    dist = F.sqrt(squared_distance(means, [f"o_{m}" for m in means]))
    ratio = F.coalesce(F.try_divide(F.col("_si") + F.col("_sj"), dist), F.lit(0.0))
    worst = left.join(right, cond).groupBy(*by, "_i").agg(F.max(ratio).alias("_r"))
    return worst.groupBy(*by).agg(F.avg("_r").alias("davies_bouldin"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample: the ``n`` rows with the smallest hashes."""
    return first_by_hash(df, n, F.xxhash64(F.col(key), F.lit(seed)), key)


def silhouette_values(
    df: DataFrame, cols: list[str], label: str, key: str, sample: int | None = None, seed: int = 42, distance: str = "euclidean"
) -> DataFrame:
    """(key, label, silhouette) of every row by Euclidean distances to all others; ``key`` must be unique.

    All pairs are compared, so the work grows with the square of the rows: ``sample`` limits the question to that many rows
    (only these are returned then). ``distance="squared"`` takes squared distances, which is linear in the rows.
    """
    rows = _scored(df, cols, {"": label}, key, sample, seed, distance)
    return rows.select(F.col("key").alias(key), F.col("label").alias(label), "silhouette")


def silhouette_by_labeling(
    df: DataFrame, cols: list[str], labelings: dict[str, str], key: str, sample: int | None = None, seed: int = 42, distance: str = "euclidean"
) -> DataFrame:
    """(labeling, silhouette): the mean of ``silhouette_values`` for several label columns, which share the distances."""
    rows = _scored(df, cols, labelings, key, sample, seed, distance)
    # the sums that tasks send each other are not left on disk behind these few rows
    return stage_table(rows.groupBy("labeling").agg(F.avg("silhouette").alias("silhouette")), "silhouettes")


def _scored(df, cols, labelings, key, sample, seed, distance):
    if distance == "squared":
        return _squared(df, cols, labelings, key)
    if distance != "euclidean":
        raise ValueError(f"unknown distance {distance!r}")
    return _tiled(sample_rows(df, key, sample, seed) if sample else df, cols, labelings, key)


#: Rows of a packed block, rows of the parts whose distances are held at once, and blocks that one task holds at most.
BLOCK, PART, STRIP = 4_096, 256, 64
#: Up to so many cells of a part are added up one after another, more by one product.
FEW_CELLS = 6


def _cluster_sums(df: DataFrame, cols: list[str], labelings: dict[str, str]) -> tuple[np.ndarray, dict[str, tuple]]:
    """The overall mean, and per labeling: labels, sizes, sums of squares and sums about that mean, a row for each cluster."""
    middle = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    center = np.array([middle[f"m{i}"] or 0.0 for i in range(len(cols))])
    shifted = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, center)]
    pairs = F.array(*[F.struct(F.lit(name).alias("labeling"), F.col(c).alias("label")) for name, c in labelings.items()])
    norms = add([s * s for s in shifted]).alias("_sq")
    long = df.select(*[s.alias(f"s{i}") for i, s in enumerate(shifted)], norms, F.explode(pairs).alias("p"))
    found = long.groupBy("p.labeling", "p.label").agg(F.count("*").alias("n"), F.sum("_sq").alias("sq"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(cols))]).collect()
    stats: dict[str, tuple] = {}
    for name in labelings:
        mine = sorted((r for r in found if r["labeling"] == name), key=lambda r: r["label"])
        stats[name] = (
            np.array([r["label"] for r in mine]),
            np.array([r["n"] for r in mine], dtype=float),
            np.array([r["sq"] for r in mine]),
            np.array([[r[f"s{i}"] for i in range(len(cols))] for r in mine]).reshape(len(mine), len(cols)),
        )
    return center, stats


def _undecided(x: np.ndarray, own: np.ndarray, n: np.ndarray, sq: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rows by clusters: the own one, and those that may be the nearest other one.

    The mean distance to a cluster is at least that to its mean, and at most the root of the mean squared distance.
    """
    means = total / n[:, None]
    square = np.maximum((x * x).sum(axis=1)[:, None] + (means * means).sum(axis=1)[None, :] - 2 * x @ means.T, 0.0)
    most = np.sqrt(square + np.maximum(sq / n - (means * means).sum(axis=1), 0.0)[None, :])
    row = np.arange(len(x))
    most[row, own] = np.inf
    need = np.sqrt(square) <= most.min(axis=1)[:, None] * (1 + 1e-9) + 1e-9
    need[row, own] = True
    return need


def _ahead(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as the left and the right factor of a product that gives squared distances, and their squared lengths."""
    sq = (x * x).sum(axis=1)[:, None]
    one = np.ones_like(sq)
    return np.hstack([x, sq, one]), np.hstack([-2 * x, one, sq]), sq


def _distances(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, sq: np.ndarray) -> np.ndarray:
    """Distances of the rows ``a`` (``left``, ``sq`` of ``_ahead``) to the rows ``b`` (``right``)."""
    gram = left @ right.T
    if not gram.min() > 2.1e-6 * sq.max():
        # cancellation: the very close pairs are computed directly; their lengths are about the same
        r, c = np.nonzero(gram < 2.1e-6 * sq)
        gram[r, c] = ((a[r] - b[c]) ** 2).sum(axis=1)
        np.maximum(gram, 0.0, out=gram)
    return np.sqrt(gram, out=gram)


class _Block:
    """Rows in order of their codes (a column for each labeling), cut into parts. ``need``: clusters by rows that need them."""

    def __init__(self, x: np.ndarray, code: np.ndarray, need: np.ndarray):
        self.x, self.rows, self.need = x, len(x), need
        self.left, self.right, self.sq = _ahead(x)
        self.wants = np.stack([need[:, a : a + PART].any(axis=1) for a in range(0, len(x), PART)]).astype(float)
        width = len(need)
        fresh = np.r_[True, (code[1:] != code[:-1]).any(axis=1)]
        cell = np.cumsum(fresh) - 1  # rows with the same labels everywhere
        held = np.zeros((width, cell[-1] + 1))
        held[code[fresh].T, np.arange(held.shape[1])] = 1.0
        self.parts = []
        for a in range(0, len(x), PART):
            mine = cell[a : a + PART]
            first, last = mine[0], mine[-1] + 1
            cut = np.searchsorted(mine, np.arange(first, last + 1))
            runs = [(c, slice(i, j), np.ones(j - i)) for c, i, j in zip(range(last - first), cut, cut[1:])]
            if last - first > FEW_CELLS:
                runs = (mine[None, :] == np.arange(first, last)[:, None]).astype(float)
            self.parts.append((slice(a, a + len(mine)), slice(first, last), runs))
        self.holds = np.stack([held[:, cells].max(axis=1) for _, cells, _ in self.parts])
        self.clusters = np.nonzero(held.any(axis=1))[0]
        self.held = held[self.clusters]


def _add_cells(runs, away: np.ndarray, to: np.ndarray) -> None:
    """Adds the rows of ``away`` to the rows of ``to``, by cells."""
    if not isinstance(runs, np.ndarray):
        for c, those, ones in runs:
            to[c] += ones @ away[those]
    else:
        _fold(runs, away, to)


def _fold(held: np.ndarray, sums: np.ndarray, to: np.ndarray) -> None:
    """Adds each row of ``sums`` to the rows of ``to`` that hold it; what is no number reaches no others."""
    sound = ~np.isnan(sums).any(axis=1)
    to += held[:, sound] @ sums[sound]
    for c in np.nonzero(~sound)[0]:
        to[held[:, c] > 0] += sums[c]


def _meet(here: _Block, there: _Block, to_here: np.ndarray, to_there: np.ndarray) -> None:
    """Sums of the distances between two blocks (or a block and itself), clusters by rows; each pair of rows is measured once."""
    alone = here is there
    wanted, offered = here.wants @ there.holds.T > 0, here.holds @ there.wants.T > 0
    # the sums by cells are folded into clusters once for a block of few cells, and after each part of one of many
    parts = list(enumerate(there.parts))
    for span in [parts] if there.held.shape[1] <= PART else [[p] for p in parts]:
        start, stop = span[0][1][1].start, span[-1][1][1].stop
        forth = np.zeros((stop - start, here.rows))
        for j, (these, cells, runs) in span:
            back = np.zeros((here.held.shape[1], these.stop - these.start))
            for i in range(j + 1 if alone else len(here.parts)):
                if not (wanted[i, j] or offered[i, j]):
                    continue
                those, own, mine = here.parts[i]
                away = _distances(here.x[those], there.x[these], here.left[those], there.right[these], here.sq[those])
                if wanted[i, j]:
                    _add_cells(runs, away.T, forth[cells.start - start : cells.stop - start, those])
                if offered[i, j] and not (alone and i == j):
                    _add_cells(mine, away, back[own])
            added = np.zeros((len(here.clusters), back.shape[1]))
            _fold(here.held, back, added)
            to_there[here.clusters, these] += added
        added = np.zeros((len(there.clusters), here.rows))
        _fold(there.held[:, start:stop], forth, added)
        to_here[there.clusters] += added


def _tiled(df: DataFrame, cols: list[str], labelings: dict[str, str], key: str) -> DataFrame:
    """(labeling, key, label, silhouette) from all pairs of rows, each measured once.

    Rows are put in order of their labels and packed, a block of them to a row, and blocks are dealt to strips. A task holds a
    strip and streams half of the other strips' blocks past it, so that all tasks together see each pair of strips once. Sums of
    the rows held stay in the task; those of a passing block leave it once, for the clusters of the strip that the block needs. A
    pair of parts of blocks is passed over if no row of either needs a cluster that the other holds (see ``_undecided``); distances
    are added up by the few cells (rows with the same labels everywhere) of a part, and serve all labelings.
    """
    kinds = dict(df.dtypes)
    first = next(iter(labelings.values()))
    center, stats = _cluster_sums(df, cols, labelings)
    names = list(labelings)
    starts = np.cumsum([0] + [len(stats[n][0]) for n in names])
    width = int(starts[-1])
    rows = int(stats[names[0]][1].sum()) if width else 0
    out = f"labeling string, key {kinds[key]}, label {kinds[first]}, silhouette double"
    if not rows:
        return df.sparkSession.createDataFrame([], out)
    labels = list(dict.fromkeys(labelings.values()))

    def pack(batches):
        import pandas as pd

        def block(frame):
            code = np.stack([starts[i] + np.searchsorted(stats[n][0], frame[f"_l{labels.index(labelings[n])}"].to_numpy()) for i, n in enumerate(names)], axis=1)
            order = np.lexsort(code.T[::-1])
            frame, code = frame.iloc[order], code[order].astype(np.int32)
            x = frame[[f"_x{i}" for i in range(len(cols))]].to_numpy(dtype=float) - center
            need = np.hstack([_undecided(x, code[:, i] - starts[i], *stats[n][1:]) for i, n in enumerate(names)])
            return {"keys": frame["_key"].tolist(), "x": x.tobytes(), "code": code.tobytes(), "need": np.packbits(need.T).tobytes()}

        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = len(held) // BLOCK * BLOCK
            if whole:
                yield pd.DataFrame([block(held.iloc[a : a + BLOCK]) for a in range(0, whole, BLOCK)])
                held = held.iloc[whole:]
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    def opened(batch, at: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, code, need = (batch.column(prefix + c)[at].as_py() for c in ("x", "code", "need"))
        x, code = np.frombuffer(x).reshape(-1, len(cols)), np.frombuffer(code, dtype=np.int32).reshape(-1, len(names))
        return x, code, np.unpackbits(np.frombuffer(need, dtype=np.uint8), count=width * len(x)).reshape(width, -1).astype(bool)

    def strip(batches):
        import pyarrow as pa

        held: dict[int, tuple[_Block, np.ndarray]] = {}
        mine, holds = None, None

        def sent(block: int, clusters: np.ndarray, sums: np.ndarray, need: np.ndarray):
            values = [[block], [mine], [clusters.astype(np.int32).tobytes()], [sums[clusters][need[clusters]].tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "strip", "clusters", "sums"])

        def passed(block: int, there: _Block):
            """Sums of a block of another strip with all blocks held; of one held, with those up to itself."""
            if block in held:
                there, sums = held[block]
                for other, (here, to_here) in held.items():
                    if other <= block:
                        _meet(here, there, to_here, sums)
                return
            sums = np.zeros((width, there.rows))
            for here, to_here in held.values():
                _meet(here, there, to_here, sums)
            clusters = np.nonzero(there.wants.any(axis=0) & holds)[0]
            if len(clusters):
                yield sent(block, clusters, sums, there.need)

        # all blocks of the strip come with the first block that passes
        waiting = None
        for batch in batches:
            for at, (turn, block, lead, here) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("turn", "block", "lead", "mine")))):
                if turn == 0:
                    own = _Block(*opened(batch, at, "my_"))
                    held[here] = own, np.zeros((width, own.rows))
                    if lead:
                        mine, meets = batch.column("my_strip")[at].as_py(), batch.column("meets")[at].as_py()
                        waiting = (block, _Block(*opened(batch, at))) if meets else None
                    continue
                if holds is None:
                    holds = np.any([b.holds.any(axis=0) for b, _ in held.values()], axis=0)
                    if waiting:
                        yield from passed(*waiting)
                yield from passed(block, _Block(*opened(batch, at)))
        if held and holds is None:
            holds = np.any([b.holds.any(axis=0) for b, _ in held.values()], axis=0)
            if waiting:
                yield from passed(*waiting)
        for block, (own, sums) in held.items():
            yield sent(block, np.nonzero(own.wants.any(axis=0))[0], sums, own.need)

    def scored(table):
        import pandas as pd
        import pyarrow as pa

        table = table.sort_by("strip")
        # the block itself comes before its sums
        keys = table.column("keys")[0].as_py()
        x, code, need = opened(table, 0)
        sums = np.zeros((width, len(x)))
        for clusters, part in zip(table.column("clusters").to_pylist()[1:], table.column("sums").to_pylist()[1:]):
            clusters = np.frombuffer(clusters, dtype=np.int32)
            held = sums[clusters]
            held[need[clusters]] += np.frombuffer(part)
            sums[clusters] = held
        sums, need, row = sums.T, need.T, np.arange(len(x))
        known = np.array([k is not None for k in keys])
        keys = pd.Series(list(keys))
        frames = []
        for i, name in enumerate(names):
            values, n, _, _ = stats[name]
            a, b = starts[i], starts[i + 1]
            own = code[:, i] - a
            inner = sums[row, code[:, i]] / np.maximum(n[own] - 1, 1)
            other = np.where(need[:, a:b], sums[:, a:b] / n, np.inf)
            other[row, own] = np.inf
            outer = other.min(axis=1) if len(n) > 1 else inner
            top = np.maximum(inner, outer)
            s = np.where((n[own] > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1), 0.0)
            frames.append(pd.DataFrame({"labeling": name, "key": keys, "label": values[own], "silhouette": s})[known])
        return pa.Table.from_batches([pa.RecordBatch.from_pandas(f, schema=wanted, preserve_index=False) for f in frames], schema=wanted)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(out)
    wanted = to_arrow_schema(schema)
    given = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)], *[F.col(c).alias(f"_l{i}") for i, c in enumerate(labels)])
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = -(-rows // BLOCK)
    by = [*[F.col(f"_l{i}") for i in range(len(labels))], F.xxhash64("_key")]
    ordered = given.repartitionByRange(max(1, min(blocks // 4, 4 * cores)), *by).sortWithinPartitions(*by)
    kept = f"keys array<{kinds[key]}>, x binary, code binary, need binary"
    packed = ordered.mapInPandas(pack, kept).withColumn("block", F.monotonically_increasing_id())
    packed = stage_table(packed, "blocks")
    ids = sorted(r[0] for r in packed.select("block").collect())  # one for each BLOCK rows
    # few strips send few sums; with an odd number each meets as many others
    strips = max(-(-len(ids) // STRIP), min(len(ids), 2 * cores - 1))
    dealt = spark.createDataFrame([(b, i * strips // len(ids), i == 0 or i * strips // len(ids) != (i - 1) * strips // len(ids)) for i, b in enumerate(ids)], "block long, strip int, lead boolean")
    dealt = packed.join(F.broadcast(dealt), "block")
    passing = dealt.select("block", "strip", "x", "code", "need").coalesce(1).withColumn("turn", F.monotonically_increasing_id())
    mine = dealt.select(F.col("block").alias("mine"), F.col("strip").alias("my_strip"), "lead", *[F.col(c).alias(f"my_{c}") for c in ("x", "code", "need")])
    mine = mine.repartitionById(strips, F.col("my_strip"))
    ahead = F.pmod(F.col("strip") - F.col("my_strip"), F.lit(strips)) * 2
    meets = (ahead < strips) | ((ahead == strips) & (F.col("my_strip") < F.col("strip")))
    begins = F.col("turn") == 0
    met = passing.join(mine.hint("shuffle_replicate_nl"), begins | (F.col("lead") & meets)).select(
        "turn", "block", "lead", "mine", "my_strip", meets.alias("meets"),
        *[F.when(F.col("lead"), F.col(c)).alias(c) for c in ("x", "code", "need")],
        *[F.when(begins, F.col(f"my_{c}")).alias(f"my_{c}") for c in ("x", "code", "need")],
    )
    sums = met.mapInArrow(strip, "block long, strip int, clusters binary, sums binary")
    both = packed.select("block", "keys", "x", "code", "need", F.lit(-1).alias("strip")).unionByName(sums, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(scored, schema)


def _squared(df: DataFrame, cols: list[str], labelings: dict[str, str], key: str) -> DataFrame:
    """(labeling, key, label, silhouette): linear in the rows.

    The mean squared distance from a row to a cluster follows from the cluster's size, sums and sum of squares; these are
    one row per cluster and labeling, taken about the overall mean.
    """
    kinds = dict(df.dtypes)
    first = next(iter(labelings.values()))
    center, stats = _cluster_sums(df, cols, labelings)

    def score(batches):
        import pandas as pd

        for batch in batches:
            x = batch[cols].to_numpy(dtype=float) - center
            own_sq = (x * x).sum(axis=1)
            row = np.arange(len(x))
            for name, column in labelings.items():
                values, n, sq, total = stats[name]
                own = np.searchsorted(values, batch[column].to_numpy())
                mean = np.maximum(own_sq[:, None] + (sq - 2 * x @ total.T) / n, 0.0)
                a = mean[row, own] * n[own] / np.maximum(n[own] - 1, 1)
                mean[row, own] = np.inf
                b = mean.min(axis=1) if len(n) > 1 else a
                top = np.maximum(a, b)
                s = np.where((n[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
                yield pd.DataFrame({"labeling": name, "key": batch[key], "label": values[own], "silhouette": s})

    chosen = list(dict.fromkeys([key, *cols, *labelings.values()]))
    return df.select(*chosen).mapInPandas(score, f"labeling string, key {kinds[key]}, label {kinds[first]}, silhouette double")


def adjusted_rand(pairs: DataFrame, a: str, b: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by…, ari) from the pair counts of the contingency table; ``weight`` counts rows already combined."""
    by = by or []
    n = F.sum(weight) if weight else F.count("*")
    cells = pairs.groupBy(*by, a, b).agg(n.cast("double").alias("_n"))
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2
    both = cells.groupBy(*by).agg(F.sum(choose("_n")).alias("_both"), F.sum("_n").alias("_all"))
    rows = cells.groupBy(*by, a).agg(F.sum("_n").alias("_n")).groupBy(*by).agg(F.sum(choose("_n")).alias("_rows"))
    cols = cells.groupBy(*by, b).agg(F.sum("_n").alias("_n")).groupBy(*by).agg(F.sum(choose("_n")).alias("_cols"))
    if by:
        joined = both.join(rows, by).join(cols, by)
    else:
        joined = both.select("*", rows.scalar().alias("_rows"), cols.scalar().alias("_cols"))
    expected = F.try_divide(F.col("_rows") * F.col("_cols"), F.col("_all") * (F.col("_all") - 1) / 2)
    limit = (F.col("_rows") + F.col("_cols")) / 2
    ari = F.coalesce(F.try_divide(F.col("_both") - expected, limit - expected), F.lit(1.0))
    return joined.select(*by, ari.alias("ari"))


def smallest_share(df: DataFrame, label: str) -> DataFrame:
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.agg((F.min("n") / F.sum("n")).alias("min_segment_share"))


def squared_silhouette(df: DataFrame, vector: str, label: str) -> float:
    """Whole-data variant (squared Euclidean), linear in the rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol=vector, predictionCol=label, distanceMeasure="squaredEuclidean").evaluate(df)

