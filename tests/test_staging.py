import glob
import time

from pyspark.sql import functions as F

from kohort.session import shuffles_dropped, stage_table

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    df = spark.range(20_000).select((F.col("id") % 1_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(5, "k")
    table = stage_table(df, "staging-test", compression="zstd")
    for _ in range(40):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    assert not left
    assert spark.conf.get(CLEANUP) == setting
    # neither the table nor the frame is hurt by it
    assert table.count() == df.count() == 20_000
    assert stage_table(df, "staging-test").exceptAll(table).count() == 0


def test_the_setting_comes_back_after_an_error(spark):
    before = spark.conf.get(CLEANUP)
    try:
        with shuffles_dropped(spark):
            assert spark.conf.get(CLEANUP) == "true"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(CLEANUP) == before
