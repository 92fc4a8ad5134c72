"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets: sources share the whole mix by weight; none may go beyond ``max_epochs`` times its own size.
Clamping the sources that would, and sharing the rest again by weight until it fits, has a closed form:
with sources in ascending order of cap over weight, the clamped ones are a prefix.  So the fixed point is
found with running sums over the source table instead of a loop.

Sampling: a source with target t and size s is taken floor(t / s) whole times; what is missing is taken
from its documents in a seeded order until the target is met; the document at the cut is taken in part.

At scale: words are counted in one pass over the texts, into a table of (id, size, source, hash) that is
checkpointed; only that is shuffled, and a source that holds a third of all rows is spread over hash buckets
(``common.running_totals``).  The mix itself (``sampled``) shuffles no text: a source's whole repetitions and
the hash at which its last one ends decide for each row where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerline.llm.common import by_place, durable, own_columns, place_of, running_totals, unit_buckets

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of runs of anything but the six ASCII white-space characters; null counts as none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(spaced, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to a table of one row a source (_source, source_size).

    Sources by code point, the null source last, have the weights in turn.  The table has a row a
    source, so its windows run in one task on that many rows.
    """
    by_name = Window.orderBy(F.col("_null"), F.col("_source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    t = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_null"), F.col("_source"))
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    later = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = total - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    t = t.withColumn("_level", left / F.sum("_w").over(later))
    # The first source whose own cap allows the level sets it for itself and all after it.
    free = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_null"), F.col("_source"), F.col("_level")))).over(Window.partitionBy())
    level = free.getField("_level")
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return t.withColumn("target", target).select("_null", "_source", "source_size", "target")


def _keyed(rows: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """Add what a row is mixed by: _null and _source (the source, null or not) and _h (seeded hash of id and text)."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("string")
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), crc)
    return rows.withColumns({"_null": F.col(source).isNull(), "_source": F.coalesce(F.col(source), F.lit("")), "_h": F.md5(key)})


def _placed(documents: DataFrame, weights: tuple[int, ...], max_epochs: float, seed: str) -> DataFrame:
    """What the mix takes of every document: whole repetitions and ``extra`` words of one more."""
    slim = _keyed(own_columns(documents, ["doc_id", "text", "source"]), "doc_id", "text", "source", seed)
    slim = durable(slim.select("doc_id", word_count(F.col("text")).alias("size"), "_null", "_source", "_h"))
    buckets = unit_buckets(slim.count())
    slim = slim.withColumn("_b", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int"))
    sizes = targets(slim.groupBy("_null", "_source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    order = [F.col("_h"), F.col("doc_id"), F.col("size")]
    placed = running_totals(slim, ["_null", "_source"], "_b", order, F.col("size"), "_before")
    joined = placed.join(sizes, ["_null", "_source"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    extra = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("_before")))
    return joined.withColumn("whole", whole).withColumn("extra", extra.cast("long"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """How much of every document the mix takes.

    Returns doc_id, size (words), source_size, target (both of its source), copies (whole repetitions),
    extra (words of one more repetition, below size) and taken (copies x size + extra).  Defined results:
    a null text is empty; an empty document is taken 0 words and one copy for each whole repetition;
    a null source is a source of its own, last in order; a source without words has target 0; repeated
    rows each count; an empty table gives no rows; further columns are not looked at.
    """
    out = _placed(documents, weights, max_epochs, seed)
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    copies = F.col("whole") + full.cast("long")
    return out.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), F.when(full, F.lit(0)).otherwise(F.col("extra")).cast("long").alias("extra"),
        (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
    )


def sampled(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, in the columns of ``documents``.

    A document that is taken in part counts as one more copy if at least half of it is.  Rows with equal id and
    text at a source's cut are told apart by their place among each other: as many of them as are due get one
    more copy.  Defined results as those of ``mix``; columns of any name stay as they are.

    No text is shuffled: of each source only its repetitions and its cut (the smallest hash that isn't taken
    whole once more) are joined, by broadcast unless there are very many sources.
    """
    placed = durable(_placed(documents, weights, max_epochs, seed).select("_null", "_source", "_h", "size", "whole", "extra"))
    short = F.col("extra") < F.col("size")
    per_source = placed.groupBy("_null", "_source").agg(F.max("whole").alias("_whole"), F.min(F.when(short, F.col("_h"))).alias("_cut"))
    due = placed.filter("size > 0").groupBy("_null", "_source", "_h").agg(F.count(F.lit(1)).alias("_rows"), F.sum((F.col("extra") * 2 >= F.col("size")).cast("long")).alias("_due"))
    at_cut = due.join(per_source.select("_null", "_source", F.col("_cut").alias("_h")), ["_null", "_source", "_h"]).drop("_h")
    plan = durable(per_source.join(at_cut, ["_null", "_source"], "left").na.fill(0, ["_rows", "_due"]))
    few = plan.count() <= 100_000
    rows = by_place(documents)
    own = rows.columns
    keyed = _keyed(rows, *[place_of(documents, c) for c in ("doc_id", "text", "source")], seed)
    keyed = keyed.join(F.broadcast(plan) if few else plan, ["_null", "_source"])
    words = F.coalesce(F.col(place_of(documents, "text")), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    before = F.coalesce(F.col("_h") < F.col("_cut"), F.lit(True))
    once_more = (words & F.when(F.col("_h") == F.col("_cut"), F.col("_due") > 0).otherwise(before)).cast("long")
    if plan.filter("_rows > 1 and _due > 0 and _due < _rows").isEmpty():
        taken = keyed.withColumn("_times", F.col("_whole") + once_more)
    else:  # equal rows share a cut: they alone are ranked
        split = (F.col("_h") == F.col("_cut")) & (F.col("_rows") > 1) & words
        place = F.row_number().over(Window.partitionBy("_null", "_source").orderBy(*[F.xxhash64(c) for c in own]))
        alone = keyed.filter(~F.coalesce(split, F.lit(False))).withColumn("_times", F.col("_whole") + once_more)
        ranked = keyed.filter(split).withColumn("_times", F.col("_whole") + (place <= F.col("_due")).cast("long"))
        taken = alone.unionByName(ranked)
    repeated = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    return taken.filter("_times > 0").select(*own, repeated.alias("_copy")).drop("_copy").toDF(*documents.columns)
