"""Near copies by word shingles: SimHash candidates, each checked on the whole shingle sets.

1. Sets: a text is the set of XXH64 hashes of its word shingles; texts with equal sets are one row from here on.
   A set's fingerprint has 64 * PLANES bits, a bit being set if it is in over half of the hashes (or of a mixture of
   them).  Two sets of Jaccard similarity s and like size differ in about acos(2 s / (1 + s)) / pi of the bits: 15 %
   at 0.8, and in at most RADIUS bits with a probability of 0.997 there, more above.
2. Candidates: a radius that wide can't be covered by bands without buckets that hold most fingerprints.  Instead a
   fingerprint goes to one bucket in each of several tables, keyed by bits drawn at random; a pair of similarity 0.8
   shares a bucket in at least one table with a probability of 0.994 (``TABLES``).  Buckets are compared bit-sliced, as
   in ``simhash``; there are no caps.
3. Check: a pair is linked if its shingle sets have a Jaccard similarity of at least ``similarity``, counted exactly in
   DataFrame functions; only the sets of candidates are made again for that.  Groups are connected components.
4. A bucket gives a forest of candidates and not all pairs of a group, first from CHAINED tables, then from all tables
   among sets that aren't connected yet.  Where a tree of the forest had a link that the check turned down, its members
   that aren't connected are compared once more, all with all, so that a wrong candidate hides no right one: there the
   sets travel with their fingerprints and the task that compares them checks them too, so that only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import among, compact, counted, own_columns, release
from ledgerline.llm.overlap import product
from ledgerline.llm.simhash import SEED, SPLIT, by_bucket, components, kept_rows, near_pairs, numbered

#: Words of a shingle and least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, and most differing bits of a candidate.
PLANES, RADIUS = 2, 30
WORDS_OF = [f"w{k}" for k in range(PLANES)]
#: Bits of a table's key and tables, by the number of sets up to which they are used.
TABLES = ((10, 24, 1 << 21), (16, 64, 1 << 27), (20, 136, 1 << 62))
#: Tables of the first pass.
CHAINED = 3
#: Hashes of a bucket, with HEAD more for each set, whose sets one task compares as a whole.
SETS, HEAD = 1 << 20, 1024
#: Rounding slack of a comparison of whole numbers with a share.
SLACK = 1e-9


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text; a text of fewer words is hashed whole, one without words is empty."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-words]]]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)), np.uint64, len(starts)))


def fingerprint(hashes: np.ndarray) -> list[int]:
    """The words of a set's fingerprint as signed numbers."""
    out = []
    for plane in range(PLANES):
        votes = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 1 << 16):
            part = _mixed(hashes[k : k + (1 << 16)], plane).astype(">u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0]))
    return out


def _mixed(hashes: np.ndarray, plane: int) -> np.ndarray:
    """The hashes themselves, or another hash made of each."""
    if not plane:
        return hashes
    x = hashes ^ (hashes >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD + 2 * plane)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _made(documents: DataFrame, words: int, what: str, more: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp (a hash of the shingle set), n (its size) and ``values``: the fingerprint ("print") or the set ("set"); ``more`` columns."""
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                found = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in part.column(1)]
                fp = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64).view(np.int64)
                lists = pa.array([h.view(np.int64) if what == "set" else fingerprint(h) for h in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), pa.array([len(h) for h in found], pa.int32()), lists, *part.columns[2:]], names=["doc_id", "fp", "n", "values", *more])

    source = own_columns(documents, ["doc_id", "text", *more])
    kinds = [*T._parse_datatype_string("doc_id long, fp long, n int, values array<long>").fields, *[source.schema[c] for c in more]]
    return source.mapInArrow(work, T.StructType(kinds))


def _keyed(nodes: DataFrame, bits: int, tables: range) -> DataFrame:
    """Nodes (sid, n, root, w0, w1) once for each table, with ``key``: the number of the table and the drawn bits."""
    drawn = [np.random.default_rng([SEED, t]).choice(64 * PLANES, bits, replace=False) for t in tables]
    power = (1 << np.arange(bits)).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                words = np.stack([part.column(3 + k).to_numpy() for k in range(PLANES)], axis=1)
                lit = np.unpackbits(words.astype(">i8").view(np.uint8).reshape(part.num_rows, -1), axis=1)
                keys = [lit[:, places] @ power + (t << bits) for t, places in zip(tables, drawn, strict=True)]
                for key in keys:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key)], names=[*part.schema.names, "key"])

    return nodes.select("sid", "n", "root", *WORDS_OF).mapInArrow(work, f"sid long, n int, root long, {', '.join(f'{w} long' for w in WORDS_OF)}, key long")


def _pairs(table: pa.Table, similarity: float, unite: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the table that share a bucket, i, j, labels): near pairs of those rows whose roots differ.

    Sizes that are too far apart are no candidates.
    """
    some, bucket, side = numbered(table)
    n, root = (table.column(c).to_numpy()[some] for c in ("n", "root"))
    words = np.stack([table.column(w).to_numpy()[some] for w in WORDS_OF], axis=1).view(np.uint64)
    # One label for each root of a bucket: the first row that has it.
    order = np.lexsort((root, bucket))
    new = np.ones(len(order), bool)
    new[1:] = (root[order][1:] != root[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    label = np.empty(len(order), np.int64)
    label[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else order
    fits = lambda i, j: np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - SLACK
    return some, *near_pairs(bucket, words, side, RADIUS, label, unite, fits)


def _close(rows: DataFrame, similarity: float, split: int) -> DataFrame:
    """(a, b, tree): a forest of candidate pairs within the buckets of rows (sid, n, root, w0, w1, key).

    ``tree`` names the tree; each of its members is paired with itself as well.
    """

    def compare(table: pa.Table) -> pa.RecordBatch:
        some, i, j, label = _pairs(table, similarity, True)
        sid, key = (table.column(c).to_numpy()[some] for c in ("sid", "key"))
        # Members of the trees, those that were connected before included, as pairs with themselves.
        member = np.flatnonzero(np.isin(label, label[i]))
        i, j = np.concatenate([i, member]), np.concatenate([j, member])
        tree = sid[label[i]] * np.int64(-7046029254386353131) ^ key[i]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[i], sid[j])), pa.array(np.maximum(sid[i], sid[j])), pa.array(tree)], names=["a", "b", "tree"])

    return by_bucket(rows, "sid", compare, "a long, b long, tree long", split)


def _linked(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all sets of a bucket of rows (sid, n, root, w0, w1, key, values) that links connect.

    The sets of a bucket are multiplied as in ``overlap``: only sets that share one of their rarest shingles and fit in
    size are looked at, and none that is connected already.
    """
    percent = round(100 * similarity)

    def compare(table: pa.Table) -> pa.RecordBatch:
        some, bucket, side = numbered(table)
        sid, root, lists = table.column("sid").to_numpy()[some], table.column("root").to_numpy()[some], table.column("values").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else []
        a, b = [], []
        for s, e in zip(edges, [*edges[1:], len(bucket)], strict=True):
            sets = [flat[offsets[k] : offsets[k + 1]] for k in some[s:e].tolist()]
            for i, j in product(sets, percent, side[s:e] if side[s:e].any() else None, root[s:e]):
                a.append(sid[s + i])
                b.append(sid[s + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return by_bucket(rows, "sid", compare, "a long, b long", SETS, F.col("n") + HEAD)


def _values(members: DataFrame, sets: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """fp and ``values``, the whole shingle set, of the sets named by ``members`` (sid)."""
    ids = sets.join(members, "sid", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    return compact(_made(among(documents, ids, "doc_id"), words, "set").dropDuplicates(["fp"]).select("fp", "values"))


def _similar(pairs: DataFrame, sets: DataFrame, documents: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough."""
    made = _values(pairs.select(F.explode(F.array("a", "b")).alias("sid")), sets, documents, words)
    both = pairs.join(made.select(F.col("fp").alias("a"), F.col("values").alias("x")), "a").join(made.select(F.col("fp").alias("b"), F.col("values").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - SLACK).select("a", "b")


def _with_roots(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Sets with the smallest set that each reaches over links."""
    roots = components(links, "a", "b")
    return compact(sets.drop("root").join(roots, sets.sid == roots.node, "left").withColumn("root", F.coalesce("root", "sid")).drop("node"))


def _grouped(documents: DataFrame, words: int, similarity: float, split: int) -> DataFrame:
    """doc_id, fp (of its shingle set), root and component_id of every row with an id."""
    named = own_columns(documents, ["doc_id", "text"]).filter("doc_id is not null")
    prints = compact(_made(named, words, "print"))
    sets, size = counted(prints.groupBy(F.col("fp").alias("sid")).agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), *[F.first(F.col("values")[k]).alias(w) for k, w in enumerate(WORDS_OF)]))
    sets = sets.withColumn("root", F.col("sid"))
    bits, tables, _ = next(x for x in TABLES if size <= x[2])

    def new(found: DataFrame, known: DataFrame | None) -> tuple[DataFrame, int]:
        pairs = found.filter("a <> b").select("a", "b").distinct()
        return counted(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"))

    # First a few tables, so that large groups are connected; then all, among what isn't connected.
    pairs, _ = new(_close(_keyed(sets.filter("n > 0"), bits, range(CHAINED)), similarity, split), None)
    links = compact(_similar(pairs, sets, named, words, similarity))
    sets = _with_roots(sets, links)
    release(sets)
    found = compact(_close(_keyed(sets.filter("n > 0"), bits, range(tables)), similarity, split))
    more, fresh = new(found, pairs)
    if fresh:
        links = compact(links.union(_similar(more, sets, named, words, similarity)))
        sets = _with_roots(sets, links)
    release(sets)
    # Trees with a link that was turned down: their members are compared all with all.
    broken, trees = counted(found.filter("a <> b").join(links, ["a", "b"], "left_anti").select("tree").distinct())
    if trees:
        again = compact(found.filter("a = b").join(broken, "tree", "left_semi").select(F.col("tree").alias("key"), F.col("a").alias("sid")).distinct())
        made = _values(again, sets, named, words).withColumnRenamed("fp", "sid")
        whole = again.join(sets.select("sid", "n", "root", *WORDS_OF), "sid").join(made, "sid")
        apart, fresh = counted(_linked(whole.select("sid", "n", "root", *WORDS_OF, "key", "values"), similarity))
        if fresh:
            links = links.union(apart)
            sets = _with_roots(sets, links)
        release(sets)
    least = compact(sets.groupBy("root").agg(F.min("least").alias("component_id")))
    by_set = compact(sets.join(least, "root").select(F.col("sid").alias("fp"), "root", "component_id"))
    return prints.select("doc_id", "fp").join(by_set, "fp")


def near_copies(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, split: int = SPLIT) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that is reached over links of similar shingle sets.

    Defined results: rows with a null id take no part; case (A-Z) and the kind of white space between words don't
    count; texts that are null or have no word are one group; repeated rows come back as often; further columns are
    not looked at; an empty table gives no rows.
    """
    return _grouped(documents, words, similarity, split).select("doc_id", "component_id")


def representatives(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each group of near copies: the one with the smallest id.

    Columns of any name stay as they are.  Of several texts with that id in one group one stays (that whose set hashes
    to the smallest number), of repeated rows one; rows with a null id all stay.  Only ids and fingerprints are
    shuffled, texts only where ``common.among`` says so or an id is repeated.
    """
    found = compact(_grouped(documents, words, similarity, SPLIT))
    best = compact(found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("best")).select("best.*"))
    rows_of = compact(found.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")))
    return kept_rows(documents, rows_of, best, lambda docs: _made(docs, words, "print", ["row"]))
