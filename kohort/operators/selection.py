"""Choosing the number of segments, and comparing algorithms at the chosen number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kohort import fixed_values as fv
from kohort.operators import kmeans as km
from kohort.operators.metrics import adjusted_rand, partition_quality, sample_rows, silhouette_by_labeling
from kohort.operators.mixture import assign_mixture, gaussian_mixture
from kohort.operators.ward import assign_ward, fit_ward
from kohort.session import spread, stage_table


def find_elbow(metrics: DataFrame, k: str = "k", inertia: str = "inertia", by: list[str] | None = None) -> DataFrame:
    """(by…, elbow_k): the point furthest from the line between the first and last, the smallest k on ties."""
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy()  # one row per candidate k
    x = F.try_divide(F.col(k) - F.min(k).over(w), (F.max(k).over(w) - F.min(k).over(w)).cast("double"))
    y = F.try_divide(F.col(inertia) - F.min(inertia).over(w), F.max(inertia).over(w) - F.min(inertia).over(w))
    points = metrics.select(*by, F.col(k).alias("_k"), F.abs(y - (1 - x)).alias("_gap"))
    return points.groupBy(*by).agg(F.max_by("_k", F.struct("_gap", -F.col("_k"))).alias("elbow_k"))


def _minmax(c: str, w) -> Column:
    span = F.max(c).over(w) - F.min(c).over(w)
    return F.when(span == 0, F.lit(1.0)).otherwise(F.try_divide(F.col(c) - F.min(c).over(w), span))


def composite_score(metrics: DataFrame) -> DataFrame:
    """Adds the mean of the scaled silhouette, Calinski-Harabasz, inverted Davies-Bouldin and stability."""
    w = Window.partitionBy()  # one row per candidate k
    parts = _minmax("silhouette", w) + _minmax("calinski_harabasz", w) + (1 - _minmax("davies_bouldin", w)) + _minmax("stability_ari", w)
    return metrics.withColumn("composite_score", parts / 4)


def eligible(metrics: DataFrame, rules: dict = fv.RULES) -> DataFrame:
    gate = (
        (F.col("k") >= rules["min_business_k"])
        & (F.col("min_segment_share") >= rules["min_segment_share"])
        & (F.col("stability_ari") >= rules["min_stability_ari"])
    )
    return metrics.withColumn("eligible", gate)


def recommend_k(metrics: DataFrame, rules: dict = fv.RULES) -> DataFrame:
    """Metric table with elbow, candidates and the recommended row.

    The elbow wins when eligible and close enough to the best candidate silhouette; otherwise the best
    composite among the eligible rows, or among all rows if none is eligible.
    """
    w = Window.partitionBy()  # one row per candidate k
    scored = eligible(composite_score(metrics), rules)
    elbow = find_elbow(metrics).scalar()
    pool = F.col("eligible") | ~F.max("eligible").over(w)
    flagged = scored.withColumns({"elbow_k": elbow, "_pool": pool})
    floor = rules["silhouette_tolerance"] * F.max(F.when(F.col("_pool"), F.col("silhouette"))).over(w)
    accepted = F.max((F.col("k") == F.col("elbow_k")) & F.col("eligible") & (F.col("silhouette") >= floor)).over(w)
    best = F.max(F.when(F.col("_pool"), F.struct(F.col("composite_score").alias("s"), (-F.col("k")).alias("k")))).over(w)
    chosen = F.when(accepted, F.col("elbow_k")).otherwise(-best["k"])
    return (
        flagged.withColumn("recommended_k", chosen.cast("int"))
        .withColumn("recommended", F.col("k") == F.col("recommended_k"))
        .drop("_pool")
    )


def choose_k_any(metrics: DataFrame, min_share: float = fv.ANY_MIN_SHARE) -> DataFrame:
    """Any-table rule: share gate, prefer three or more groups unless clearly worse, then the best silhouette."""
    w = Window.partitionBy()  # one row per candidate k
    gated = metrics.withColumn("eligible", F.col("min_segment_share") >= min_share)
    pool = F.col("eligible") | ~F.max("eligible").over(w)
    best = F.max(F.when(F.col("_pool"), F.col("silhouette"))).over(w)
    richer = F.col("_pool") & (F.col("k") >= 3) & (F.col("silhouette") >= 0.6 * best)
    final = F.col("_richer") | (F.col("_pool") & ~F.max("_richer").over(w))
    pick = F.max(F.when(final, F.struct(F.col("silhouette").alias("s"), (-F.col("k")).alias("k")))).over(w)
    return (
        gated.withColumn("_pool", pool)
        .withColumn("_richer", richer)
        .withColumn("recommended", F.col("k") == -pick["k"])
        .drop("_pool", "_richer")
    )


def choose_k_rfm(metrics: DataFrame) -> DataFrame:
    """One row: highest silhouette, then the lowest Davies-Bouldin."""
    return metrics.orderBy(F.desc("silhouette"), F.asc("davies_bouldin"), F.asc("k")).limit(1)


def stability_mask(key: str, runs: int, fraction: float) -> Column:
    """One bit per subsample, set for about ``fraction`` of the rows, without replacement."""
    draw = lambda run: F.pmod(F.xxhash64(F.col(key), F.lit(run + 1)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    out = F.lit(0).cast("long")
    for run in range(runs):
        out = out + F.when(draw(run), F.lit(1 << run)).otherwise(F.lit(0)).cast("long")
    return out


def scan_rows(df: DataFrame, cols: list[str], key: str, n: int | None, seed: int) -> DataFrame:
    """The rows on which candidate k are scored: all of them, or ``n`` picked by hash."""
    rows = df.select(key, *cols)
    if n is None:
        return spread(rows)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return sample_rows(rows, key, n, seed).repartition(max(1, min(cores, 64)), key)


def evaluate_k_range(
    df: DataFrame,
    cols: list[str],
    key: str,
    ks=range(2, 11),
    n_init: int = 20,
    stability_runs: int = 10,
    rules: dict = fv.RULES,
    max_iter: int | None = None,
) -> tuple[DataFrame, dict]:
    """Metric table for every candidate k, and the centres behind it.

    All restarts of all k, plus all stability refits, run in the same iterations over the same persisted rows.
    """
    seed = rules["seed"]
    sample = scan_rows(df, cols, key, rules["k_scan_sample"], seed)
    if stability_runs:
        sample = sample.withColumn("_bits", stability_mask(key, stability_runs, rules["stability_fraction"]))
    sample = sample.persist()
    try:
        ks = list(ks)
        main = [km.Run(k, seed + i) for k in ks for i in range(n_init)]
        refits = [km.Run(k, seed + 1000 * (r + 1) + i, member=r) for k in ks for r in range(stability_runs) for i in range(5)]
        km.fit_runs(sample, cols, main + refits, key, mask="_bits" if stability_runs else None, max_iter=max_iter, seed=seed)
        best = km.best_by_k(main)
        labeled = stage_table(km.label_many(sample, cols, {f"k{k}": best[k].centers for k in ks}, key), "labelings")
        metrics = score_labelings(labeled, cols, {k: f"k{k}" for k in ks}, key, rules["silhouette_sample"], seed)
        if stability_runs:
            metrics = metrics.join(F.broadcast(_stability(sample, cols, ks, best, refits, stability_runs)), "k")
        rows = metrics.collect()  # one row per k
        table = df.sparkSession.createDataFrame(rows, metrics.schema).orderBy("k")
    finally:
        sample.unpersist()
    return table, {k: best[k].centers for k in ks}


def score_labelings(df: DataFrame, cols: list[str], labelings: dict[int, str], key: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette, calinski_harabasz, davies_bouldin, min_segment_share) per label column."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("int").alias("label")) for k, c in labelings.items()])
    long = df.select(*cols, F.explode(pairs).alias("p")).select(*cols, F.col("p.k").alias("scan_k"), F.col("p.label").alias("label"))
    quality = partition_quality(long, cols, "label", ["scan_k"]).select(
        F.col("scan_k").alias("k"), "inertia", "calinski_harabasz", "davies_bouldin", "min_segment_share"
    )
    sil = silhouette_by_labeling(df, cols, {str(k): c for k, c in labelings.items()}, key, sample, seed).select(
        F.col("labeling").cast("int").alias("k"), "silhouette"
    )
    return quality.join(sil, "k").select(
        "k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin", "min_segment_share"
    )


def _stability(sample, cols, ks, best, refits, runs):
    """(k, stability_ari): mean agreement of the reference labels with those of the refitted subsamples."""
    winners = {}
    for r in refits:
        if (r.k, r.member) not in winners or r.inertia < winners[(r.k, r.member)].inertia:
            winners[(r.k, r.member)] = r
    pairs = [(k, m, best[k].centers, winners[(k, m)].centers) for k in ks for m in range(runs)]
    cells = km.label_agreement(sample, cols, pairs)
    ari = adjusted_rand(cells, "ref", "label", ["k", "run"], weight="n")
    return ari.groupBy("k").agg(F.avg("ari").alias("stability_ari"))


def compare_algorithms(
    df: DataFrame, cols: list[str], k: int, key: str, n_init: int = 20, rules: dict = fv.RULES, start=None
) -> DataFrame:
    """Quality of K-Means, Gaussian mixture and Ward's hierarchy on the same rows.

    ``start`` gives K-Means the winning centres of an earlier scan instead of fresh restarts."""
    return compare_with(df, cols, k, key, n_init, rules, start)[0]


def compare_with(
    df: DataFrame, cols: list[str], k: int, key: str, n_init: int = 20, rules: dict = fv.RULES, start=None, final=None
) -> tuple[DataFrame, float | None]:
    """``compare_algorithms``, and the silhouette of all rows by the nearest of the ``final`` centres.

    Where the comparison is over all rows too, both silhouettes come from the same distances."""
    seed = rules["seed"]
    shared = final is not None and rules["k_scan_sample"] is None
    sample = scan_rows(df, cols, key, rules["k_scan_sample"], seed).persist()
    try:
        centers = km.kmeans(sample, cols, k, key, n_init, seed, start=start)
        labeled = km.assign(sample.select(key, *cols), cols, centers, "kmeans")
        labeled = assign_mixture(labeled, cols, gaussian_mixture(sample, cols, k, key, seed=seed), "gmm")
        labeled = assign_ward(labeled, cols, fit_ward(sample, cols), k, "tree").select(key, *cols, "kmeans", "gmm", "tree")
        names = {1: "kmeans", 2: "gmm", 3: "tree"}
        if shared:
            labeled, names = km.assign(labeled, cols, final, "final"), {**names, 4: "final"}
        labeled = stage_table(labeled, "labelings")
        scored = {r["k"]: r for r in score_labelings(labeled, cols, names, key, rules["silhouette_sample"], seed).collect()}
    finally:
        sample.unpersist()
    titles = {1: "K-Means", 2: "Gaussian Mixture", 3: "Agglomerative (Ward)"}
    rows = [
        (titles[i], r["silhouette"], r["calinski_harabasz"], r["davies_bouldin"], r["min_segment_share"], i != 3)
        for i, r in sorted(scored.items()) if i in titles
    ]
    table = df.sparkSession.createDataFrame(
        rows,
        "algorithm string, silhouette double, calinski_harabasz double, davies_bouldin double, "
        "min_segment_share double, assigns_new_customers boolean",
    )
    if final is None:
        return table, None
    if shared:
        return table, scored[4]["silhouette"]
    whole = km.assign(df.select(key, *cols), cols, final, "final")
    return table, silhouette_by_labeling(whole, cols, {"final": "final"}, key, rules["silhouette_sample"], seed).first()["silhouette"]
