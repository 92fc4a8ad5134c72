import time

from pyspark.sql import functions as F

from ledgerline.llm.common import release


def _keys(statuses):
    it = statuses.keysIterator()
    while it.hasNext():
        yield it.next()


def test_shuffles_of_finished_steps_go(spark):
    """Frames in a cycle of Python's hold their shuffles until Python's garbage is collected as well."""
    statuses = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    step = spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count()
    step.itself = [step]
    step.collect()
    held = set(_keys(statuses()))
    assert held
    del step
    for _ in range(20):
        release(spark.range(1))
        if len(held & set(_keys(statuses()))) < len(held):
            return
        time.sleep(0.5)
    raise AssertionError("no shuffle was dropped")
