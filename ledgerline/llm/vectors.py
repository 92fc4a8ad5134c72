"""What the two vector searches share: valid vectors, their dimension, and merging of partial results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import own_columns


def finite(vector: Column) -> Column:
    """Whether a vector has components and all of them are numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """(vec_id, v as doubles; dimension; rows) of the rows that take part.

    Rows with a null id or a vector that is null, empty or not finite take no part.  Of several dimensions
    the most common one counts (of equally common ones the largest); vectors of others take no part.
    """
    rows = own_columns(vectors, [key, vector]).toDF("vec_id", "v").withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("v")))
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if found is None:
        return rows, 0, 0
    return rows.filter(F.size("v") == found["d"]), int(found["d"]), int(found["count"])


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """An array column of fixed length as a matrix of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):  # pyarrow gives none for an empty column
        return np.zeros((0, d))
    return np.asarray(whole.flatten(), np.float64).reshape(-1, d)


def best(partial: DataFrame, k: int, order: Column) -> DataFrame:
    """The k best rows of each query, ranked from 1; a pair that was found more than once counts once."""
    once = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    window = Window.partitionBy("query_id").orderBy(order, F.col("vec_id"))
    return once.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
