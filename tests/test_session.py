import time

from pyspark.sql import functions as F

from streetlens import session
from streetlens.session import stage_table


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_shuffle_files_of_a_written_table_go_at_once(spark):
    before, setting = shuffle_files(spark), spark.conf.get(session.CLEANUP)
    summed = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("total"))
    table = stage_table(summed.join(summed.select("k").repartition(3, "k"), "k"), "summed")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(session.CLEANUP) == setting
    assert table.count() == summed.count() == 100


def test_a_frame_is_read_again_after_its_table_was_written(spark):
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().cache()
    assert stage_table(frame, "counted").count() == frame.count() == stage_table(frame.repartition(2), "counted").count() == 7
    frame.unpersist()
    assert sorted(map(tuple, frame.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
