"""Prefix trie of conversations, rolled up by pointer jumping.

1. Places: turns are dealt out by ranges of (conversation, turn), so a conversation of any length is spread; a turn's
   place is its place within its range plus the rows of the ranges before.  Texts are replaced by digests first.
2. Nodes: a prefix is named by its depth and the running sums of the digests of (place, turn), 128 bits; the sums are
   taken in buckets of places, so no task holds a whole conversation.  Equal names are one node, with an edge to the
   name of the prefix that is one turn shorter.
3. Rollup: each node holds what its descendants nearer than 2^r add up to and a pointer to its ancestor 2^r above.  A
   round adds every node's sum to the one its pointer names (sums are combined before they are shuffled, so a node may
   have any number of children) and doubles the pointers by one join of the table with itself.  Only nodes deeper
   than 2^r take part, so the rounds are logarithmic in the depth and shrink.
4. Members that end at a node are hashed in order: pieces of up to PIECE ids by ranges of (node, id), then a stream of
   pieces for each node, in bounded memory.

Joins on a pointer have a checkpointed table on both sides: a hot parent is a skewed join, which Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import compact, counted, own_columns

#: Places of a conversation whose sums are taken in one group; ids of a piece that is hashed as a whole.
BUCKET, PIECE = 4096, 1024
#: Groups of conversations of the contract, and the number of openings a conversation can have.
BLOCK, OPENINGS = 100, 6
#: 32-bit words of a running digest.
WORDS = [f"s{k}" for k in range(4)]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (place of the turn from 0), t (digest of role and text) and n (code points of the text).

    Turns are ordered by ``turn``, null first; of equal turns by role and the digest.  Null roles and texts are empty;
    rows with a null conv_id take no part; further columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = own_columns(conversations, ["conv_id", "turn", "role", "text"]).filter("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long"), "turn", role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("t"), F.length(text).cast("long").alias("n"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("t")]
    # A row's number within its range has the range's number in its high bits.
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t", "n", F.monotonically_increasing_id().alias("at"))
    placed = compact(placed.withColumn("range", F.shiftright("at", 33)))
    pieces = placed.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("conv_id", "range", (F.col("first") - before).alias("zero"))
    return compact(placed.join(pieces, ["conv_id", "range"]).select("conv_id", (F.col("at") - F.col("zero")).alias("idx"), "t", "n"))


def rebuilt(turns: DataFrame, block: int = BLOCK, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, t, n) and (conv_id, total): conversations that open like the first of their block.

    Of ``numbered`` turns: conversation c gets the first h turns of conversation c - c % block (all if it has fewer,
    none if it isn't there) and then its own after its first h; h is the CRC-32 of c in decimal, modulo ``openings``.
    """
    own = turns.groupBy("conv_id").agg(F.max("idx").alias("last"))
    own = own.select("conv_id", (F.col("last") + 1).alias("rows"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings).alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    heads = turns.filter((F.col("conv_id") % block == 0) & (F.col("idx") < openings - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("idx", "t", "n"))).alias("head"))
    opened = own.join(heads, "base", "left").withColumn("head", F.filter(F.coalesce("head", F.expr("array()")), lambda x: x["idx"] < F.col("h")))
    total = F.size("head") + F.greatest(F.lit(0).cast("long"), F.col("rows") - F.col("h"))
    opened = compact(opened.select("conv_id", "h", "head", total.cast("long").alias("total")))
    first = opened.select("conv_id", F.explode("head").alias("x")).select("conv_id", (F.col("x.idx") + 1).alias("pos"), "x.t", "x.n")
    shift = opened.select("conv_id", "h", F.size("head").alias("k"))
    rest = turns.join(shift, "conv_id").filter("idx >= h").select("conv_id", (F.col("idx") - F.col("h") + F.col("k") + 1).alias("pos"), "t", "n")
    return first.union(rest), opened.select("conv_id", "total")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, t, n) and (conv_id, total): conversations as they are."""
    return turns.select("conv_id", (F.col("idx") + 1).alias("pos"), "t", "n"), turns.groupBy("conv_id").agg((F.max("idx") + 1).alias("total"))


def _named(steps: DataFrame) -> DataFrame:
    """steps with key and parent: the names of the prefix that ends here and of the one that is a turn shorter."""
    mixed = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("t")))
    steps = steps.withColumn("m", mixed).withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    steps = steps.select("conv_id", "pos", "n", "bucket", *[F.conv(F.substring("m", 8 * k + 1, 8), 16, 10).cast("long").alias(w) for k, w in enumerate(WORDS)])
    sums = steps.groupBy("conv_id", "bucket").agg(*[F.sum(w).alias(w) for w in WORDS])
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "bucket", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_base") for w in WORDS])
    inside = Window.partitionBy("conv_id", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select("conv_id", "bucket", "pos", "n", *WORDS, *[F.sum(w).over(inside).alias(f"{w}_in") for w in WORDS]).join(sums, ["conv_id", "bucket"])
    upto = [F.col(f"{w}_base") + F.col(f"{w}_in") for w in WORDS]
    return run.select("conv_id", "pos", "n", _name(F.col("pos"), upto).alias("key"), _name(F.col("pos") - 1, [u - F.col(w) for u, w in zip(upto, WORDS, strict=True)]).alias("parent"))


def _name(depth, sums):
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]))


def _root_name():
    return _name(F.lit(0), [F.lit(0)] * len(WORDS))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id) to pieces (key, first, ids)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        code = keys.indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])).tolist()
        found = [(int(code[a]), k, ids[k : min(k + PIECE, b)]) for a, b in zip(starts, [*starts[1:], len(code)], strict=True) for k in range(a, b, PIECE)]
        yield pa.RecordBatch.from_arrays(
            [keys.dictionary.take(pa.array([c for c, _, _ in found])), pa.array([int(x[0]) for _, _, x in found], pa.int64()), pa.array([",".join(map(str, x.tolist())).encode() for _, _, x in found], pa.binary())],
            names=["key", "first", "ids"],
        )


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (key, first) to (key, ends_sha256)."""
    current, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if key != current:
                if current is not None:
                    done.append((current, state.hexdigest()))
                current, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def ended(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 of rows (key, conv_id): the SHA-256 of the ids in decimal, ascending, joined by commas."""
    pieces = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key string, first long, ids binary")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key string, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """key, n_children, n_leaves and saved_tokens of nodes (key, parent, depth, saved), the last two of whole subtrees.

    The root's parent is null.  Rounds are logarithmic in the depth.
    """
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("key")).distinct()
    leaf = F.when(F.col("inner").isNull(), 1).otherwise(0).cast("long")
    own = compact(nodes.join(parents.withColumn("inner", F.lit(1)), "key", "left").select("key", F.col("parent").alias("above"), "depth", leaf.alias("n_leaves"), F.col("saved").alias("saved_tokens")))
    given, active, step = [own.select("key", F.lit(0).cast("long").alias("n_children"), "n_leaves", "saved_tokens")], own.filter("above is not null"), 1
    while True:
        given.append(active.select(F.col("above").alias("key"), F.lit(int(step == 1)).cast("long").alias("n_children"), "n_leaves", "saved_tokens"))
        gain = active.groupBy(F.col("above").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        further = active.select(F.col("key").alias("above"), F.col("above").alias("next"))
        deeper = active.filter(F.col("depth") >= 2 * step).join(gain, "key", "left")
        deeper = deeper.select("key", "above", "depth", *[(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_leaves", "l"), ("saved_tokens", "s"))])
        active, left = counted(deeper.join(further, "above").select("key", F.col("next").alias("above"), "depth", "n_leaves", "saved_tokens"))
        if not left:
            break
        step *= 2
    everything = given[0]
    for part in given[1:]:
        everything = everything.union(part)
    return everything.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])


def rollup(steps: DataFrame, totals: DataFrame) -> DataFrame:
    """One row for each distinct prefix of conversations, of steps (conv_id, pos from 1, t, n) and (conv_id, total).

    Returns key (digest of the prefix), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves
    and saved_tokens over the subtree (``n`` of a node's last turn for each member beyond the first), and ends_sha256
    of the members that end here.  A conversation without turns is a member of the root alone; without any conversation
    there are no rows.
    """
    paths = compact(_named(steps))
    nodes = paths.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("pos").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.min("n").alias("n"))
    nodes = nodes.select("key", "conv_id", "depth", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    top = totals.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    nodes = compact(nodes.union(top.select(_root_name(), "conv_id", zero, F.lit(None).cast("string"), "n_convs", zero)))
    stops = paths.join(totals.select("conv_id", F.col("total").alias("pos")), ["conv_id", "pos"], "left_semi").select("key", "conv_id")
    stops = ended(stops.union(totals.filter("total = 0").select(_root_name(), "conv_id")))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, "parent", "left").join(rolled_up(nodes.select("key", "parent", "depth", "saved")), "key").join(stops, "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
