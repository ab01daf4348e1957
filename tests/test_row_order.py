"""Load order over files, parts of files and frames without files."""

import pytest
from pyspark.sql import functions as F

from kohort import fixed_values as fv
from kohort.operators import dedup
from kohort.operators.reshape import to_canonical
from kohort.sources.readers import read_delimited, with_row_order


@pytest.fixture()
def small_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _files(folder, sizes):
    """Files of the given numbers of rows; values count up over the files in order of their names."""
    folder.mkdir()
    v = 0
    for i, n in enumerate(sizes):
        lines = [f"{v + j},{'x' * (j % 7)}" for j in range(n)]
        (folder / f"{i:03}.csv").write_text("\n".join(["v,text", *lines]) + "\n")
        v += n
    return v


def _values(df):
    return [(r["v"], r[fv.ROW_ORDER]) for r in df.orderBy(fv.ROW_ORDER).select(F.col("v").cast("long").alias("v"), fv.ROW_ORDER).collect()]


def test_rows_of_many_files_are_numbered_as_they_stand(spark, tmp_path, small_parts):
    n = _files(tmp_path / "in", [3, 900, 0, 40, 2_000, 1, 700, 15, 1_200, 5])
    df = read_delimited(spark, str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() > 10  # large files in parts, small ones packed together, largest parts first
    raw = df.withColumn("place", F.monotonically_increasing_id()).orderBy("place").select(F.col("v").cast("long").alias("v")).collect()
    assert [r["v"] for r in raw] != list(range(n))
    assert _values(with_row_order(df)) == [(i, i) for i in range(n)]
    assert _values(with_row_order(df.select("v"))) == [(i, i) for i in range(n)]


def test_first_rows_and_new_ids_follow_the_files(spark, tmp_path, small_parts):
    n = _files(tmp_path / "in", [5, 800, 30, 1_500])
    ordered = with_row_order(read_delimited(spark, str(tmp_path / "in")))
    first = dedup.drop_duplicate_ids(ordered.withColumn("ID", F.col("v").cast("long") % 7)).select("ID", F.col("v").cast("long").alias("v"))
    assert sorted(tuple(r) for r in first.collect()) == [(i, i) for i in range(7)]
    blank = read_delimited(spark, str(tmp_path / "in")).select("v", *[F.lit("1").alias(c) for c in fv.REQUIRED if c != fv.ID])
    if fv.ID not in fv.REQUIRED:
        ids = to_canonical(blank).orderBy(fv.ID).select(fv.ID, F.col("v").cast("long").alias("v")).collect()
        assert [tuple(r) for r in ids] == [(i + 1, i) for i in range(n)]


def test_frames_without_files_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "t") for i in range(500)], "v long, mark string").repartition(9, "v")
    got = with_row_order(df.withColumn(fv.ROW_ORDER, F.lit(-1)))
    assert sorted(p for _, p in _values(got)) == list(range(500)) and set(got.columns) == {"v", "mark", fv.ROW_ORDER}
    twice = with_row_order(df.select("v").unionAll(df.select("v")))
    assert sorted(p for _, p in _values(twice)) == list(range(1_000))
    assert with_row_order(df.where("v < 0")).count() == 0
    assert [r[0] for r in with_row_order(df, "v").select(fv.ROW_ORDER).where(f"{fv.ROW_ORDER} <> v").collect()] == []
