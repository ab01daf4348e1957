"""Registered queries against DuckDB on the same files. ``ALL_ORACLES=1`` runs every one of them."""

import math
import os

import duckdb
import pytest

from kohort.checks import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = """a1_read_delimited a9_sanitize_text b1_to_number b3_parse_date b6_canonical_label c1_decode_one_hot c8_crosstab_share d6_compare_numeric
d9_record_warnings e6_customer_360 g2_table_profile g4_column_stats g9_zscore_profile g11_segment_profiles g13_cramers_v g36_spearman
j2_silhouette j6_adjusted_rand k2_mixture_scans l1_archetype_scores l2_name_segments m4_analyze_text p3_winsorizer r3_predict s2_drop_duplicate_ids
s3_fill_missing_ids w1_rank_pct""".split()
NAMES = [n for n, (_, sql) in REGISTRY.items() if sql and (n in CORE or os.environ.get("ALL_ORACLES"))]


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v != v:
        return "NULL"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, duck, name):
    fn, sql = REGISTRY[name]
    got, want = fn(spark, folder).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_query_has_a_plain_name():
    assert len(REGISTRY) > 150
    assert all(n == n.lower() and math.isfinite(len(n)) for n in REGISTRY)


def test_fitted_queries_use_the_defaults_of_their_operators(spark, monkeypatch):
    """The registered queries ask for no fewer restarts, refits or candidates than the operators do by themselves."""
    from kohort.checks import clusters, names
    from kohort.operators import kmeans, selection
    from kohort.plans import auto, rfm, segmenter

    asked = {}

    class Called(Exception):
        pass

    def record(name):
        def call(*args, **options):
            asked[name] = (len(args), set(options))
            raise Called

        return call

    for module, name in ((kmeans, "kmeans"), (selection, "compare_algorithms"), (selection, "evaluate_k_range"), (segmenter, "fit_customers"), (rfm, "train_rfm"), (auto, "auto_segment")):
        monkeypatch.setattr(module, name, record(name))
    for module in (clusters, names):
        monkeypatch.setattr(module, "_models", {})
    for name in ("_matrix", "c360"):
        monkeypatch.setattr(clusters, name, lambda *_: None)
    monkeypatch.setattr(names, "_parts", lambda *_: None)
    for query in (clusters.fit_kmeans, clusters.algorithms, clusters.stability, clusters.fit_customers, clusters.rfm, names.auto):
        with pytest.raises(Called):
            query(spark, "")
    assert asked == {"kmeans": (4, set()), "compare_algorithms": (4, set()), "evaluate_k_range": (3, set()), "fit_customers": (1, {"as_of"}), "train_rfm": (1, set()), "auto_segment": (1, set())}
