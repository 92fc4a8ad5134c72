"""Operators over ordered rows: runs, carry-forward, look-ahead, first occurrences, batches.

Order is always given by columns; no operator relies on the order in which rows happen to lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = Sequence[str]


def islands(df: DataFrame, by: Names, order: Names, value: str, name: str = "island") -> DataFrame:
    """Number the runs of equal values within each group, from 1; nulls are equal to each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    new = first | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn(name, F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def carried_forward(df: DataFrame, by: Names, order: Names, value: Column, name: str) -> DataFrame:
    """Last value that isn't null, up to this row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def look_ahead(df: DataFrame, by: Names, order: str, who: str, only: Column, limit: int) -> DataFrame:
    """For each row that meets ``only``: its next ``limit`` rows in the group by somebody else.

    Returns the group columns, ``order``, later_<order> and place (1 to limit).  The other-person condition
    comes before the limit.  Rows are packed into runs of one person with their first ``limit`` rows each.  Of any
    2 * limit runs in a row at least ``limit`` are by somebody else, so a frame of that many runs is all that a run's
    rows can need: the work is linear however long a group or a run is.
    """
    numbered = islands(df.select(*by, order, who, only.alias("_only")), by, [order], who, "_run")
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order))
    first = F.sort_array(F.collect_list(F.when(F.col("_k") <= limit, F.col(order))))
    runs = numbered.withColumn("_k", place).groupBy(*by, "_run").agg(F.first(who).alias("_who"), first.alias("_rows"))
    next_ = Window.partitionBy(*by).orderBy("_run").rowsBetween(1, 2 * limit)
    runs = runs.withColumn("_next", F.collect_list(F.struct("_who", "_rows")).over(next_))
    others = F.slice(F.flatten(F.transform(F.filter("_next", lambda r: ~r["_who"].eqNullSafe(F.col("_who"))), lambda r: r["_rows"])), 1, limit)
    same = [numbered[c].eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    runs = runs.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_run").alias("_its"), others.alias("_others"))
    found = numbered.filter("_only").join(runs, [*same, numbered["_run"] == runs["_its"]])
    return found.select(*by, order, F.posexplode("_others").alias("_p", f"later_{order}")).select(*by, order, f"later_{order}", (F.col("_p") + 1).alias("place"))


def first_of(df: DataFrame, key: Names, order: Names) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def most_common_first_seen(df: DataFrame, key: Names, value: str, seq: Names) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones that which was seen first.

    Returns the key, the value and n.  Counts are combined before the shuffle; ``mode`` and ``max_by`` would
    leave ties to chance.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*seq)).alias("_seen"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "_seen")
    return counted.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_seen")


def ordered_distinct(df: DataFrame, by: Names, order: Names, value: str, name: str) -> DataFrame:
    """Distinct values of each group as an array, in order of their first appearance."""
    seen = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_o"))
    return seen.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(name))


def nested(df: DataFrame, by: Names, order: Names, fields: Names, name: str) -> DataFrame:
    """One row a group with its rows as an ordered array of structs."""
    rows = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("_o"), F.struct(*fields).alias("_v"))))
    return df.groupBy(*by).agg(F.transform(rows, lambda x: x["_v"]).alias(name))


def numbered_ids(df: DataFrame, key: str, order: Names, name: str = "id") -> DataFrame:
    """Ids "<key>#<n>" with n counted from 1 within the key, over the rows that are there."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(name, F.concat_ws("#", F.col(key).cast("string"), F.row_number().over(w).cast("string")))


def _bounds(df: DataFrame, order: Names, pieces: int, seed: int) -> Column:
    """At most ``pieces`` - 1 values of the order columns that cut the rows into pieces of about the same size, as an array.

    They are taken from a sample of about 32 rows a piece, whatever the table's size, and are constants from then on:
    where they lie decides the pieces' sizes, never a result.
    """
    rows = df.count()
    key = F.struct(*[F.col(c) for c in order])
    some = df.select(key.alias("k")).sample(min(1.0, 32 * pieces / max(rows, 1)), seed).agg(F.sort_array(F.collect_list("k")).alias("k"))
    step = F.greatest(F.ceil(F.size("k") / pieces), F.lit(1)).cast("int")
    cuts = F.array_distinct(F.filter("k", lambda _, i: (i % step == 0) & (i > 0)))
    kinds = [df.schema[c].dataType for c in order]
    found = [F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, row, kinds, strict=True)]) for row in some.select(cuts).first()[0]]
    return F.array(*found) if found else F.array().cast(T.ArrayType(T.StructType([T.StructField(c, t) for c, t in zip(order, kinds, strict=True)])))


def rows_numbered(df: DataFrame, by: Names, order: Names, name: str, pieces: int | None = None, seed: int = 7) -> DataFrame:
    """Number the rows of each group from 1, for groups too large for one task.

    Rows are cut into ranges of the order columns (``pieces`` of them; without a number four times the shuffle partitions,
    1,024 at most); they are numbered within group and range, and each range begins where the counts of those before
    it end.  Only the counts, one a group and range, meet in one place a group.  Nulls come first in the order and form a
    group of their own.  The order must tell all rows of a group apart (equal rows would get any of their numbers),
    and rows that share all order columns share a range.
    """
    pieces = pieces or min(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1024)
    cuts, key = _bounds(df, order, pieces, seed), F.struct(*[F.col(c) for c in order])
    steps = F.array(*[F.lit(2**k) for k in reversed(range(pieces.bit_length()))])
    piece = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= key, at + step).otherwise(at))
    cut = df.withColumn("_piece", piece)
    counts = cut.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_piece").alias("_its"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order)))
    same = [within[c].eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    out = within.join(starts, [*same, within["_piece"] == F.col("_its")])
    return out.select(*[within[c] for c in df.columns], (F.col("_start") + F.col("_n")).alias(name))


def batches(df: DataFrame, by: Names, order: Names, size: int, name: str = "batch", hot: bool = False) -> DataFrame:
    """Number batches of at most ``size`` rows within each group, from 0.

    ``hot``: groups may be too large for one task and are numbered in pieces (``rows_numbered``), which takes a count
    and a sample of the table first.
    """
    if hot:
        numbered = rows_numbered(df, by, order, "_place")
    else:
        numbered = df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.withColumn(name, F.floor((F.col("_place") - 1) / size).cast("int")).drop("_place")


def cut_at(df: DataFrame, by: Names, order: str, ends: Column) -> DataFrame:
    """Rows of each group before the first that meets a condition (all rows if none does)."""
    w = Window.partitionBy(*by)
    return df.withColumn("_end", F.min(F.when(ends, F.col(order))).over(w)).filter(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).drop("_end")


def first_failure(rules: Sequence[tuple[Column, str]]) -> Column:
    """Name of the first rule that a row breaks, null if it breaks none; a rule is (condition that fails, name)."""
    reason = F.lit(None).cast("string")
    for fails, name in reversed(rules):
        reason = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(reason)
    return reason


def descending(df: DataFrame, by: Names, order: Names, value: str, name: str = "ok") -> DataFrame:
    """Per group: whether values never rise along the order."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_up", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False)))
    return marked.groupBy(*by).agg((~F.bool_or("_up")).alias(name))
