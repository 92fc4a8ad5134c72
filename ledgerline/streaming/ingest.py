"""Incremental extraction: each new file of an archive becomes its block before the next is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerline.sources.corpus import doc_id_of, doc_type_of, plain_text


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of (doc_id, doc_type, text) of an archive's text files, as they come."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_trigger).load(path)
    docs = files.select(F.col("value").alias("text"), doc_id_of(F.col("_metadata.file_path")).alias("doc_id")).filter("doc_id <> ''")
    return docs.select("doc_id", doc_type_of(F.col("doc_id")).alias("doc_type"), plain_text(F.col("text")).alias("text"))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``handle(documents, batch number)`` on every micro-batch; ``once``: end when all there is has been read."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
