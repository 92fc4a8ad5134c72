"""SimHash near-duplicate groups with bit-sliced comparison.

1. Fingerprints: every word shingle of a text is hashed with XXH64; a bit of the fingerprint is set if it
   is set in over half of the hashes.  One pass, no shuffle.
2. Candidates: two 64-bit words that differ in at most r bits agree wholly in at least p of b bands if
   r <= b - p, so each distinct fingerprint goes to the C(b, p) buckets of p bands' values.  Every link is
   found (no caps).  b grows with the number of fingerprints, so that a bucket's expected size stays small.
3. Comparison, bit-sliced: a task sorts its fingerprints by bucket and stores them as 64 bit planes, 64
   fingerprints to a machine word.  For each shift d it compares every fingerprint with the one d places
   on: each plane is XORed with itself shifted, and carry-save adders count the differing bits of 64 pairs
   at once in a few words.  Blocks in which all pairs exceed the radius are abandoned; so are blocks whose
   pairs are already known to be connected, which keeps a large group of near copies from being compared
   pair by pair.  A bucket gives each member's smallest linked fingerprint, not its pairs.
   Buckets beyond ``split`` fingerprints are dealt out as pairs of chunks, so no task holds a whole one.
4. Groups: connected components over distinct fingerprints by alternating large-star and small-star steps
   on DataFrames, checkpointed, until nothing changes.  Neither links nor fingerprints go to the driver.

Joins on a group's root or on a fingerprint meet tables that are checkpointed first, so that a hot root or
fingerprint is a skewed join, which Spark splits, and never one task behind an aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import among, by_place, compact, counted, own_columns, place_of

#: Words of a shingle and most differing bits of a link.
WORDS, RADIUS = 4, 4
#: XXH64 seed of the shingle hash.
SEED = 42
#: Fingerprints of a bucket that one task compares as a whole.
SPLIT = 16_384
#: Edges that one task contracts at a time.
STARS = 1 << 21
#: Fingerprints up to which a number of bands is used: bands, bands that agree, fingerprints.
BANDS = ((6, 2, 1 << 25), (7, 3, 1 << 31), (8, 4, 1 << 62))


# -- fingerprints ------------------------------------------------------------------------------------


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Fingerprint of a UTF-8 text; 0 for a text without words."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: -words]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], ">u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    set_ = np.packbits(votes * 2 > len(hashes))
    return int(set_.view(">u8")[0])


def fingerprints(documents: DataFrame, words: int = WORDS, more: Sequence[str] = ()) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every document, and ``more`` of its columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *more])

    source = own_columns(documents, ["doc_id", "text", *more])
    kinds = [*T._parse_datatype_string("doc_id long, fp long").fields, *[source.schema[c] for c in more]]
    return source.mapInArrow(work, T.StructType(kinds))


# -- comparison --------------------------------------------------------------------------------------


def _shifted(planes: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    """The words ``at`` of the planes moved by d lanes: bit i is bit i + d (lanes beyond the end are 0)."""
    words, bits = divmod(d, 64)
    n = planes.shape[1]
    near, far = at + words, at + words + 1
    out = np.where(near < n, planes[:, np.minimum(near, n - 1)], np.uint64(0)) >> np.uint64(bits)
    if bits:
        out |= np.where(far < n, planes[:, np.minimum(far, n - 1)], np.uint64(0)) << np.uint64(64 - bits)
    return out


def _lanes(flags: np.ndarray, width: int) -> np.ndarray:
    """Booleans as packed words, lane 0 in the lowest bit."""
    padded = np.zeros(width * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)


def _close(planes: np.ndarray, d: int, live: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i of ``live`` whose fingerprints i and i + d differ in at most ``radius`` bits."""
    width = max(1, int(radius + 1).bit_length())
    out = np.zeros_like(live)
    at = np.flatnonzero(live)
    lanes = live[at]
    a, b = planes[:, at], _shifted(planes, at, d)
    count = [np.zeros(len(at), np.uint64) for _ in range(width)]
    over = np.zeros(len(at), np.uint64)  # lanes that have passed 2 ** width - 1
    for k in range(0, len(planes), 2):
        x, y = a[k] ^ b[k], a[k + 1] ^ b[k + 1]
        # Two differences and the lowest counter word go in, a sum and a carry come out.
        half = x ^ y
        carry = (x & y) | (half & count[0])
        count[0] = count[0] ^ half
        for j in range(1, width):
            count[j], carry = count[j] ^ carry, count[j] & carry
        over |= carry
        if k % 8 == 6:
            still = lanes & ~(over | _above(count, radius))
            if not still.any():
                return out
            keep = np.flatnonzero(still)
            if len(keep) < 0.7 * len(at):
                at, lanes, over = at[keep], still[keep], over[keep]
                a, b, count = a[:, keep], b[:, keep], [c[keep] for c in count]
            else:
                lanes = still
    out[at] = lanes & ~(over | _above(count, radius))
    return out


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius: a bitwise comparison with a constant, highest bit first."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for j in reversed(range(len(count))):
        if radius >> j & 1:
            equal &= count[j]
        else:
            above |= equal & count[j]
            equal &= ~count[j]
    return above


def near_pairs(bucket: np.ndarray, words: np.ndarray, side: np.ndarray, radius: int, label: np.ndarray, unite: bool = True, fits: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, labels): pairs of rows of a bucket with at most ``radius`` differing bits.

    ``words`` has a row of 64-bit words for each fingerprint, ``bucket`` numbers are sorted.  Rows of one label aren't
    compared; with ``unite`` a pair's labels become one, so that the pairs are a forest and not all pairs of a group.
    ``side`` is 0 where a row is compared with all others of its bucket; buckets of two chunks carry 1 and 2, and
    only pairs of different sides are compared.  ``fits`` (i, j) may turn pairs down.
    """
    n = len(bucket)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), label
    room = np.searchsorted(bucket, bucket, "right") - np.arange(n)  # lanes i .. i + room - 1 are of the same bucket
    width = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(words, ">u8").view(np.uint8).reshape(n, -1), axis=1)
    planes = np.stack([_lanes(bits[:, k], width) for k in range(bits.shape[1])])
    label, alone, index = label.copy(), not side.any(), np.arange(n)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(room.max(initial=1))):
        index = index[room[index] > d]
        if not len(index):
            break
        pair = index[label[index] != label[index + d]]
        if not alone:
            pair = pair[(side[pair] != side[pair + d]) | (side[pair] == 0)]
        if fits is not None:
            pair = pair[fits(pair, pair + d)]
        if not len(pair):
            continue
        flags = np.zeros(n, bool)
        flags[pair] = True
        hit = _close(planes, d, _lanes(flags, width), radius)
        if not hit.any():
            continue
        i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[:n])
        found_i.append(i)
        found_j.append(i + d)
        if unite:
            _unite(label, i, i + d)
    return np.concatenate(found_i), np.concatenate(found_j), label


def nearest_roots(bucket: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fp, root) for every fingerprint that links to another in a bucket; root: the smallest it reaches there.

    ``fp`` are distinct within a bucket; ``bucket`` and ``side`` as in ``near_pairs``.
    """
    _, _, label = near_pairs(bucket, fp[:, None], side, radius, np.arange(len(fp)))
    low = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(low, label, fp.view(np.int64))
    root = low[label]
    own = root != fp.view(np.int64)
    return fp.view(np.int64)[own], root[own]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked lanes the smallest label of their component, by hooking and pointer jumping."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        low, high = np.minimum(x[differ], y[differ]), np.maximum(x[differ], y[differ])
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _bands(b: int) -> list[tuple[int, int]]:
    """(shift, width) of b bands that cover 64 bits."""
    edges = [64 * k // b for k in range(b + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, count: int, radius: int = RADIUS, split: int = SPLIT, table: tuple = BANDS) -> DataFrame:
    """(fp, root): for each distinct fingerprint with a link in some bucket, the smallest it reaches there.

    ``table`` says which bands are used up to how many fingerprints.
    """
    b, p, _ = next(x for x in table if count <= x[2])
    if b - p < radius:
        b, p = radius + 1, 1
    bands = _bands(b)
    keys = []
    for k, chosen in enumerate(combinations(range(b), p)):
        value, size = F.lit(0).cast("long"), 0
        for c in chosen:
            shift, width = bands[c]
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)), size))
            size += width
        # The choice's number in the low bits keeps choices apart.
        keys.append(value * F.lit(128) + F.lit(k))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    compare = lambda rows: _compare(rows, radius)
    return by_bucket(rows, "fp", compare, "fp long, root long", split).distinct()


def by_bucket(rows: DataFrame, node: str, compare: Callable[[pa.Table], pa.RecordBatch], schema: str, split: int = SPLIT, weight: Column | None = None) -> DataFrame:
    """``compare`` on whole buckets (``key``) of rows, which it gets sorted by key, lo, hi and ``node`` with their ``side``.

    Buckets beyond ``split`` rows (or that sum of ``weight``) are dealt out: a chunk meets itself and each other chunk of its bucket, in cell
    (lo, hi), on side 1 or 2 (0: with itself).
    """
    # Only the buckets beyond the split size are known apart: (rows / split) of them at most, usually none.
    hot = rows.groupBy("key").agg(F.sum(F.lit(1) if weight is None else weight).alias("n_")).filter(F.col("n_") > split)
    hot, buckets = counted(hot.select("key", F.ceil(F.col("n_") / F.lit(split)).cast("int").alias("chunks_")))
    whole = F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(0).alias("side"))
    if not buckets:
        cell = rows.select(*rows.columns, F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(0).alias("side"))
    else:
        own = F.pmod(F.xxhash64(node), F.col("chunks_")).cast("int")
        dealt = rows.join(F.broadcast(hot) if buckets <= 100_000 else hot, "key", "left").withColumn("c_", own)
        cells = F.when(F.col("chunks_").isNull(), F.array(whole)).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.coalesce(F.col("chunks_"), F.lit(1)) - 1),
                lambda o: F.struct(F.least("c_", o).alias("lo"), F.greatest("c_", o).alias("hi"), F.when(o == F.col("c_"), F.lit(0)).when(F.col("c_") < o, F.lit(1)).otherwise(F.lit(2)).alias("side")),
            )
        )
        cell = dealt.withColumn("cell_", F.explode(cells)).select(*rows.columns, "cell_.*")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket may go over the edge of a batch: whole buckets are compared, the last waits.
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= 1 << 17 or sum(b.nbytes for b in waiting) >= 1 << 26:
                whole = pa.Table.from_batches(waiting).combine_chunks()
                last = _bucket_start(whole)
                if last:
                    yield compare(whole.slice(0, last))
                waiting, held = whole.slice(last).to_batches(), whole.num_rows - last
        if held:
            yield compare(pa.Table.from_batches(waiting).combine_chunks())

    placed = cell.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", node)
    return placed.mapInArrow(work, schema)


def numbered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that aren't alone in their bucket, number of their bucket, side)."""
    key, lo, hi, side = (rows.column(c).to_numpy() for c in ("key", "lo", "hi", "side"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    bucket = np.cumsum(new)
    some = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    # The cell of a chunk with itself is compared as a whole.
    return some, bucket[some], np.where(lo == hi, 0, side)[some]


def _bucket_start(rows: pa.Table) -> int:
    """First row of the last bucket."""
    cols = [rows.column(c).to_numpy() for c in ("key", "lo", "hi")]
    same = np.logical_and.reduce([c == c[-1] for c in cols])
    return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0


def _compare(rows: pa.Table, radius: int) -> pa.RecordBatch:
    some, bucket, side = numbered(rows)
    fp = np.ascontiguousarray(rows.column("fp").to_numpy()[some]).view(np.uint64)
    a, b = nearest_roots(bucket, fp, side, radius)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["fp", "root"])


# -- components --------------------------------------------------------------------------------------


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v as stars: each task hangs the nodes of its edges below the smallest that they reach there.

    A task takes a bounded number of edges at a time; what it gives has the same components with shorter paths.
    """

    def stars(table: pa.Table) -> pa.RecordBatch:
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        _unite(label, place[: len(u)], place[len(u) :])
        own = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= STARS:
                yield stars(pa.Table.from_batches(waiting))
                waiting = []
        if waiting:
            yield stars(pa.Table.from_batches(waiting))

    return edges.mapInArrow(work, "u long, v long")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one other and none of those below another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, a: str = "fp", b: str = "root") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node it reaches.

    Each task first contracts the edges it has.  While more are left than a task contracts at a time, alternating
    large-star and small-star steps follow: in each a node's neighbours are hung below the smallest of them.  Only
    minima are aggregated (with map-side combining), never neighbour lists, and they are checkpointed before the join,
    so a hub of any degree is a skewed join at most.  The steps are logarithmic in the longest path.
    """
    current, left = counted(_contracted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")))
    if left > STARS:
        current, left = counted(_contracted(current.distinct()))
    while left > STARS and not _is_forest_of_stars(current):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = compact(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = compact(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = compact(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        current, left = counted(_contracted(small.distinct()))
    if 0 < left <= STARS:  # what fits one contraction is done with it
        current = compact(_contracted(current.coalesce(1)))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Fingerprint and near-duplicate group of every document.

    Returns doc_id, fp (signed long) and component_id: the smallest doc_id that is reached over links of at
    most ``radius`` differing bits, the document itself included.  Defined results: a text that is null or
    has no word has fingerprint 0 and links like any other; a text with fewer words than a shingle is hashed
    whole; rows with equal fingerprints are one group; a null id never is the smallest (a group of null ids
    alone has a null component_id); repeated rows come back as often; an empty table gives no rows.
    """
    return _grouped(documents, words, radius, split).select("doc_id", "fp", "component_id")


def _grouped(documents: DataFrame, words: int, radius: int, split: int) -> DataFrame:
    """doc_id, fp, root (the group's smallest fingerprint) and component_id of every document."""
    prints = compact(fingerprints(documents, words))
    per_fp, n = counted(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(per_fp.select("fp"), n, radius, split))
    grouped = compact(per_fp.join(roots, per_fp.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = compact(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = compact(grouped.join(named, "root").select("fp", "root", "component_id"))
    return prints.join(by_fp, "fp")


def representatives(documents: DataFrame, words: int = WORDS, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """The documents with one of each near-duplicate group: the one with the smallest id.

    Columns of any name stay as they are.  Of several texts with that id in one group the one with the smallest
    fingerprint stays, of repeated rows with that id and fingerprint one.  Rows with a null id can't be named as
    anyone's copy: all of them stay.
    """
    found = _grouped(documents, words, radius, split).filter("doc_id is not null")
    best = compact(found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("best")).select("best.*"))
    return kept_rows(documents, compact(found.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))), best, lambda docs: fingerprints(docs, words, ["row"]))


def kept_rows(documents: DataFrame, rows_of: DataFrame, kept: DataFrame, prints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``documents`` that are kept: one for each (doc_id, fp) of ``kept``, and all with a null id.

    ``rows_of`` holds n, the number of rows, of each (doc_id, fp).  Where an id has one text, once, its rows are
    told by the id alone and no text is shuffled unless very many ids go (``common.among``); only repeated ids have
    their texts read again (``prints`` of them gives doc_id and fp, row by row).
    """
    many, repeated = counted(rows_of.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 1").select("doc_id"))
    gone = rows_of.join(kept, ["doc_id", "fp"], "left_anti").select("doc_id").union(many).distinct()
    names, plain = documents.columns, by_place(documents)
    key = place_of(documents, "doc_id")
    single = among(plain, gone.withColumnRenamed("doc_id", key), key, kept=False)
    if not repeated:
        return single.toDF(*names)
    # Repeated ids: their rows carry their fingerprint as one more column, and one row of each kept pair stays.
    few = among(plain, many.withColumnRenamed("doc_id", key), key)
    packed = few.select(F.col(key).alias("doc_id"), F.col(place_of(documents, "text")).alias("text"), F.struct(*plain.columns).alias("row"))
    with_fp = prints(packed).join(kept, ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"])
    return single.unionByName(with_fp.select("row.*")).toDF(*names)
