"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor loses nothing.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset a temporary one is set on a single
    machine (tests); on a cluster this raises, as executors can't share a folder of one machine.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-checkpoint-"))
    return df.checkpoint(eager=True)


def counted(df: DataFrame, rows: int = 4096) -> tuple[DataFrame, int]:
    """``durable``, and its number of rows, which is counted on the way.

    A table with far fewer than ``rows`` rows a partition comes in fewer partitions, so that what reads it has no more
    tasks than there is work: a small table behind a wide shuffle would go on as many tiny tasks otherwise.
    """
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get.get("n", 0)
    enough = max(1, -(-n // rows))
    return (out.coalesce(enough) if 2 * enough <= out.rdd.getNumPartitions() else out), n


def compact(df: DataFrame) -> DataFrame:
    """``counted`` without the count."""
    return counted(df)[0]


def release(df: DataFrame) -> None:
    """Let the driver collect its garbage, so that Spark drops the shuffles and broadcasts of queries that are done.

    Spark does that only when the driver's heap runs full; a loop of many small queries keeps all of them till then.
    Python's own garbage goes first, as its frames hold the JVM's.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def by_place(df: DataFrame) -> DataFrame:
    """The table with its columns named c0, c1, ... by their places, so that no name can clash with another."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> str:
    """What ``by_place`` calls a column."""
    return f"c{df.columns.index(name)}"


def own_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only the wanted columns; further columns, whatever their names (dots, another case), go."""
    return by_place(df).select(*[F.col(place_of(df, c)).alias(c) for c in wanted])


def among(df: DataFrame, ids: DataFrame, key: str, kept: bool = True, most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose key is (``kept``) or isn't among ``ids`` (one column of that name, distinct).

    The ids are checkpointed and counted: up to ``most`` are broadcast, so that wide rows stay where they are; beyond,
    both sides are shuffled.
    """
    ids, n = counted(ids)
    return df.join(F.broadcast(ids) if n <= most else ids, key, "left_semi" if kept else "left_anti")


def unit_buckets(rows: int, per_bucket: int = 1000, least: int = 256, most: int = 65_536) -> int:
    """How many hash or range buckets rank ``rows`` rows: from the row count alone."""
    return max(least, min(most, -(-rows // per_bucket)))


def md5_number(text: Column, hex_digits: int = 8) -> Column:
    """The first hex digits of a text's MD5 as a long: uniform, seeded by what the text holds."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("long")


def running_totals(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that come before this one.

    The order inside a group is (``bucket``, ``order``).  A group may hold any share of all rows: no
    task gets more of it than one bucket.  Bucket sums are made with map-side combining, prefix sums
    run over those (buckets x groups rows at most), and rows meet their bucket's prefix in the
    partitioning that the inner window needs anyway, so the rows are shuffled once.
    Groups and buckets must not be null.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(sums, keys, "left").withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in")
