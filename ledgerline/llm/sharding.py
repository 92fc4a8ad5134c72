"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash inside each source; a row's fractional rank is its place in that
shuffle over the size of its source.  Sorting all rows by fractional rank interleaves the sources in
proportion, so every contiguous cut of that order holds the mixture of the whole.  Cutting at equal
row counts gives the law ``rows``: shard sizes are at most one row apart.

At scale: texts are read once, into a table of (id, size, checksum, source, hash) that is checkpointed; only
that is shuffled.  Both rankings are done in hash or range buckets (``common.running_totals``), so a source
that holds a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import durable, md5_number, own_columns, running_totals, unit_buckets

SEED = "interleave-1"


def keyed(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, source and the seeded hash ``_h`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = own_columns(documents, ["doc_id", "text", "source"]).select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_source"),
    )
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))
    return slim.withColumn("_h", F.md5(key))


def interleave(documents: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """Put every row into one of ``shards`` shards, each a proportional sample of all sources.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, shard (0 on) and slot (the place in the
    shard, without gaps from 0).  Defined results: a null text counts as empty; a null source is a
    source of its own; a null id is ranked like any other; rows that are equal in every way are
    interchangeable; an empty table gives no rows; further columns are not looked at.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    slim = durable(keyed(documents, seed))
    rows = slim.count()
    buckets = unit_buckets(rows)
    slim = slim.withColumn("_b", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int"))
    # A constant part of the order keeps equal rows from being told apart by chance where it matters.
    order = [F.col("_h"), F.col("doc_id"), F.col("size")]
    ranked = running_totals(slim, ["_source"], "_b", order, F.lit(1), "_rank")
    sizes = slim.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    # Each source starts at an offset of its own: sources of one row don't all meet in the middle.
    start = md5_number(F.concat_ws("|", F.lit(seed), F.col("_source"))) / F.lit(2.0**32)
    part = ((F.col("_rank") + start) / F.col("_n")).alias("_part")
    placed = ranked.join(sizes, "_source").select("doc_id", "size", "text_crc32", "_source", "_rank", part)
    placed = durable(placed.withColumn("_b", F.floor(F.col("_part") * buckets).cast("int")))
    placed = running_totals(placed, [], "_b", [F.col("_part"), F.col("_source"), F.col("_rank")], F.lit(1), "_place")
    place = F.col("_place").cast("decimal(38,0)")
    shard = F.floor(place * shards / F.lit(max(rows, 1)).cast("decimal(20,0)")).cast("int")
    first = F.ceil(F.col("shard").cast("decimal(38,0)") * rows / shards).cast("long")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_place").cast("long") - first).select("doc_id", "size", "text_crc32", "shard", "slot")
