import glob
import time

from panelloom.operators.store import remove, scratch_root, written


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They go with the query, without the driver collecting garbage; the setting of the session stays as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(name, None)
    df = spark.range(10_000).selectExpr("id % 997 AS k").groupBy("k").count()
    twice = [written(df.repartition(3), "counts") for _ in range(2)]
    assert spark.conf.get(name, None) == setting
    late = time.time() + 30
    while shuffle_files(spark) - before and time.time() < late:  # they go in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert [x.count() for x in twice] == [997, 997]


def test_removed_tables_are_gone(spark):
    path = f"{scratch_root(spark)}/panelloom/{spark.sparkContext.applicationId}/removed-by-test"
    assert written(spark.range(5), "removed", path).count() == 5
    assert remove(spark, path) and not remove(spark, path)
