"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix with itself, exact.

1. Rows: a document is the set of hashes of its distinct word n-grams; documents with equal sets are one row of the
   matrix from here on, named by a hash of the set.  Sets are made from the texts again wherever they are needed, and
   texts are all that is shuffled of a row: a set takes several times its text's room and can't be packed.
2. Peeling: a partner of a row of n columns shares ceil(0.85 n) of them at least, so a row with n - ceil(0.85 n) + 1
   columns that no other row has links with nothing and leaves the matrix.  First a hashed share (SAMPLED) of all
   columns is looked at, the same for every row, then all columns of the rows that are left.  Columns are counted in
   buckets, ranges of hashes: a task sends a bucket the sorted hashes of many rows at once, as differences and without
   the bits that few columns need, and gets back how frequent each is.  What is taken for shared by mistake stays.
3. Blocks: two rows that link share one of each one's first n - ceil(0.85 n) + 1 columns, in any common order.  Columns
   of one row come first and then the others, rarest first (by powers of two), so that only a row's first few shared
   columns are entries.  Rows that meet in a column with
   sizes that may link are joined by a chain and not by pairs; blocks are the chains' components.
4. Product: a task holds the whole rows of a block, renumbers its columns rarest first, and multiplies one row at a time
   with the block: entries of the leading columns find the partners whose sizes fit, then overlaps are accumulated over
   ranges of columns, and pairs whose remaining columns can't reach their bound are dropped after each.  Rows that are
   linked already aren't compared again, so a family of near copies costs little more than one row of the product.
5. Blocks beyond SETS entries are cut into chunks.  First each chunk is multiplied with itself and with a few hubs of
   its block, which connects what is near to a hub; then rows that aren't connected with the most of their block meet
   all chunks, in cells of two chunks.  No cap and no sampling of rows: every link that could join two groups is computed.

Tasks combine equal columns before they are shuffled, so a column that a third of all rows have costs a hash a block of
rows, and two bytes or so a row.  Rows of 2^40 columns or more never meet here; overlaps are counted in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import compact, counted, own_columns, release
from ledgerline.llm.simhash import SEED, components, numbered

#: Words of an n-gram, and the similarity of a link in hundredths.
WORDS, PERCENT = 4, 85
#: Entries of a block (HEAD more a row) that one task multiplies as a whole; hubs of a larger block.
SETS, HEAD, HUBS = 1 << 20, 64, 4
#: Share of columns that the first peeling looks at.
SAMPLED = 0.25
#: Columns of a bucket; columns and rows that a task sends off together.
BUCKET, BLOCK, TOGETHER = 1 << 21, 1 << 20, 1 << 16
#: Bits of a hash beyond those that number all columns: one column in 2^SPARE_BITS is taken for shared by mistake.
SPARE_BITS = 10
#: Most bits of the filter of ids, as a power of two.
FILTER_BITS = 28
#: Bytes of texts whose words a task hashes at a time; entries that it combines at a time; rows that it remembers.
AT_ONCE, ENTRIES, REMEMBERED = 1 << 18, 1 << 18, 1 << 20
#: Ranges of columns between which pairs are dropped.
RANGES = 4
#: Stands for the larger size where a row is a link of a chain.
CHAIN = -1


# -- rows --------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sets of word n-gram hashes of a column of texts.

    A word's hash is the sum, modulo 2^64, of drawn numbers of its bytes times drawn numbers of their places, mixed
    with its length; words of more than 64 bytes are hashed by XXH64.  An n-gram's hash is made likewise of its words'.
    """

    def __init__(self, words: int):
        drawn = np.random.default_rng(SEED)
        self.words = words
        self.letter = drawn.integers(1, 1 << 64, 256, np.uint64)
        self.letter[65:91] = self.letter[97:123]
        self.place = drawn.integers(1, 1 << 64, 64, np.uint64) | np.uint64(1)
        self.turn = drawn.integers(1, 1 << 64, words, np.uint64) | np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True

    def hashed(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of some bytes, and their places; no word goes over one of ``starts``."""
        import xxhash

        word = ~self.space[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        at = starts[starts < len(data)]
        first[at] = word[at]
        s = np.flatnonzero(first)
        if not len(s):
            return np.empty(0, np.uint64), s
        inside = np.arange(len(data)) - s[np.cumsum(first) - 1]
        values = self.letter[data] * self.place[inside & 63]
        values[~word] = 0
        length = np.add.reduceat(word, s, dtype=np.int64)
        out = _mix(np.add.reduceat(values, s) + length.astype(np.uint64))
        for k in np.flatnonzero(length > len(self.place)).tolist():
            out[k] = xxhash.xxh64_intdigest(data[s[k] : s[k] + length[k]].tobytes().lower(), SEED)
        return out, s

    def gram(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out += words[k : len(words) - n + 1 + k] * self.turn[k]
        return _mix(out)

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of the word n-grams of each text; fewer words are one n-gram, none (and nulls) none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
        k = 0
        while k < len(texts):
            last = max(k + 1, int(np.searchsorted(offsets, offsets[k] + AT_ONCE, "right")) - 1)
            part, edges = data[offsets[k] : offsets[last]], offsets[k : last + 1] - offsets[k]
            if last == k + 1 and len(part) > AT_ONCE:
                words = np.concatenate([self.hashed(piece, np.zeros(1, np.int64))[0] for piece in self.pieces(part)])
                counts = np.array([len(words)])
            else:
                words, s = self.hashed(part, edges[:-1])
                counts = np.diff(np.searchsorted(s, edges))
            grams = self.gram(words, self.words) if len(words) >= self.words else None
            at = 0
            for n in counts.tolist():
                if n >= self.words:
                    found = np.sort(grams[at : at + n - self.words + 1])
                    new = np.ones(len(found), bool)
                    np.not_equal(found[1:], found[:-1], out=new[1:])
                    yield found[new]
                else:
                    yield self.gram(words[at : at + n], n) if n else np.empty(0, np.uint64)
                at += n
            k = last

    def pieces(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text cut at white space."""
        a = 0
        while a < len(data):
            b = a + AT_ONCE
            while b < len(data) and not self.space[data[b : b + AT_ONCE]].any():
                b += AT_ONCE
            b = b + int(np.argmax(self.space[data[b : b + AT_ONCE]])) if b < len(data) else len(data)
            yield data[a:b]
            a = b


def _sid(found: list[np.ndarray]) -> np.ndarray:
    """Names of sets."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64).view(np.int64)


def _documents(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, sid and n of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(words)
        for batch in batches:
            found = [(int(_sid([h])[0]), len(h)) for h in grams.of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in found], pa.int64()) for k in range(2)]], names=["doc_id", "sid", "n"])

    return documents.select("doc_id", "text").mapInArrow(work, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, sid long, n long")


# -- texts of rows -----------------------------------------------------------------------------------


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of ids, which are hashes, in a filter of 2^bits bits."""
    ids = ids.view(np.uint64)
    return [((ids ^ (ids >> np.uint64(29 + k))) * np.uint64(m)) >> np.uint64(64 - bits) for k, m in enumerate((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))]


def _filter(rows: DataFrame, n: int):
    """A broadcast Bloom filter of the ids (``least``, null like any other) that name n rows: of a document that it lets by mistake nothing depends."""
    bits = min(FILTER_BITS, max(16, (8 * n).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(bitmap, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(bitmap)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bitmap[some].view(np.int64))], names=["word", "bits"])

    words = rows.select(F.xxhash64("least").alias("id")).mapInArrow(work, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return rows.sparkSession.sparkContext.broadcast((bits, bitmap.view(np.uint64)))


def _sets(documents: DataFrame, words: int, wanted, work, schema: str) -> DataFrame:
    """``work`` over (sid, set, text) of the documents that a filter lets by (all without one), of each set once a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets():
            grams, seen = Grams(words), set()
            for batch in batches:
                texts = batch.column(1)
                if wanted is not None:
                    bits, bitmap = wanted.value
                    let = [(bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) for at in _places(batch.column(0).to_numpy(), bits)]
                    texts = texts.filter(pa.array((let[0] & let[1] & let[2]).astype(bool)))
                for k, h in enumerate(grams.of(texts)):
                    if not len(h) or (sid := int(_sid([h])[0])) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sid)
                    yield sid, h, texts[k]

        yield from work(sets())

    return documents.select(F.xxhash64("doc_id").alias("id"), "text").mapInArrow(each, schema)


def _texts(documents: DataFrame, words: int, wanted) -> DataFrame:
    """(sid, text) of the rows that a filter lets by; a row may come several times."""

    def work(sets) -> Iterator[pa.RecordBatch]:
        sids, texts, held = [], [], 0
        for sid, _, text in sets:
            sids.append(sid)
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(texts, pa.string())], names=["sid", "text"])
                sids, texts, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(texts, pa.string())], names=["sid", "text"])

    return _sets(documents, words, wanted, work, "sid long, text string")


# -- peeling -----------------------------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs, so that equal high bytes lie side by side."""
    values = values.astype(np.uint64)
    planes = (int(values.max(initial=0)).bit_length() + 7) // 8
    return bytes([planes]) + values.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes() + (len(values).to_bytes(8, "little") if not planes else b"")


def _unpacked(data: bytes) -> np.ndarray:
    planes = data[0]
    if not planes:
        return np.zeros(int.from_bytes(data[1:], "little"), np.uint64)
    found = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((found.shape[1], 8), np.uint8)
    out[:, :planes] = found.T
    return out.view(np.uint64).ravel()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that are sorted by their first column, all of one value at a time."""
    waiting: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            key = batch.schema.names[0]
            if waiting and waiting[0][key] != row[key]:
                yield waiting
                waiting = []
            waiting.append(row)
    if waiting:
        yield waiting


def _frequencies(documents: DataFrame, words: int, wanted, columns: int, share: float, whole: bool) -> DataFrame:
    """(sid, own, classes): how many of a row's columns, among the first ``share`` of all hashes, no other row has.

    ``columns``: about how many the rows have in all.  classes (``whole``): for each column of the row, in order, 0 if it
    is its own, else the power of two of the number of rows that have it, a byte each.
    """
    bits = min(64, max(32, columns.bit_length() + SPARE_BITS))
    span = int(share * 2**32)
    buckets = max(1, -(-int(columns * share) // BUCKET), 2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) if columns * share > BUCKET else 1)

    def give(sets) -> Iterator[pa.RecordBatch]:
        number, waiting, held = TaskContext.get().partitionId() << 32, [], 0
        for sid, h, _ in sets:
            h = h[: int(np.searchsorted(h >> np.uint64(32), np.uint64(span)))] if share < 1 else h
            waiting.append((sid, h))
            held += len(h)
            if held >= BLOCK or len(waiting) >= TOGETHER:
                yield sent(number, waiting)
                number, waiting, held = number + 1, [], 0
        if waiting:
            yield sent(number, waiting)

    def sent(number: int, waiting) -> pa.RecordBatch:
        sids = np.array([sid for sid, _ in waiting], np.int64)
        # Named by its rows as well: should a task that is run again get them in another order, nothing is put together with what it sent before.
        origin = int(_sid([np.append(sids, number)])[0])
        key = np.concatenate([h for _, h in waiting]) >> np.uint64(64 - bits)
        row = np.repeat(np.arange(len(waiting)), [len(h) for _, h in waiting])
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(key))
        unique = key[starts]
        bucket = ((unique >> np.uint64(bits - 32)) * np.uint64(buckets) // np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else [0]
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(unique)], strict=True):
            names = sids.tobytes() if a == cuts[0] else None
            lo, hi = (int(starts[a]), int(ends[b - 1])) if b > a else (0, 0)
            place = int(bucket[a]) if b > a else 0
            base = np.uint64(place * span // buckets << bits - 32)
            rows.append((place, origin, names, _packed(np.diff(unique[a:b], prepend=base)), _packed(ends[a:b] - starts[a:b]), _packed(row[lo:hi])))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "origin", "sids", "keys", "counts", "rows"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _groups(batches):
            keys = [np.cumsum(_unpacked(p["keys"]), dtype=np.uint64) for p in pieces]
            counts = [_unpacked(p["counts"]).astype(np.int64) for p in pieces]
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            frequency = np.bincount(place, weights=np.concatenate(counts))
            classes = (np.frexp(frequency)[1] - 1).astype(np.uint8)[place]
            at = 0
            for p, k, n in zip(pieces, keys, counts, strict=True):
                mine = np.repeat(classes[at : at + len(k)], n)
                at += len(k)
                row = _unpacked(p["rows"]).astype(np.int64)
                if whole:
                    first, second = _packed(np.bincount(row)), mine[np.argsort(row, kind="stable")].tobytes()
                else:
                    first, second = _packed(np.bincount(row[mine == 0])), None
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((p["origin"], p["bucket"], p["sids"], first, second), kinds, strict=True)], names=["origin", "bucket", "sids", "counts", "classes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _groups(batches):
            sids = np.frombuffer(pieces[0]["sids"], np.int64)
            counts = [_unpacked(p["counts"]).astype(np.int64) for p in pieces]
            if not whole:
                own = np.zeros(len(sids), np.int64)
                for n in counts:
                    own[: len(n)] += n
                yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(own), pa.nulls(len(sids), pa.binary())], names=["sid", "own", "classes"])
                continue
            row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in counts])
            classes = np.concatenate([np.frombuffer(p["classes"], np.uint8) for p in pieces])[np.argsort(row, kind="stable")]
            sizes = np.bincount(row, minlength=len(sids))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            own = np.bincount(np.repeat(np.arange(len(sids)), sizes)[classes == 0], minlength=len(sids))
            lists = pa.Array.from_buffers(pa.binary(), len(sids), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(classes.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(own), lists], names=["sid", "own", "classes"])

    given = _sets(documents, words, wanted, give, "bucket int, origin long, sids binary, keys binary, counts binary, rows binary")
    found = given.repartition("bucket").sortWithinPartitions("bucket", "origin").mapInArrow(count, "origin long, bucket int, sids binary, counts binary, classes binary")
    return found.repartition("origin").sortWithinPartitions("origin", "bucket").mapInArrow(gather, "sid long, own long, classes binary")


def _leading(n, percent: int):
    """How many of a row's first columns hold one that any partner shares."""
    return n - (percent * n + 99) // 100 + 1


def _left(found: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Rows (sid, n, ...) with classes and ``spare``, those whose own columns are too few to rule out a link."""
    # A row that came twice, by a document that the filter let by, has no column of its own there: it counts as that says.
    least = found.groupBy("sid").agg(F.min(F.struct("own", "classes")).alias("f"))
    need = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    return rows.join(least, "sid").withColumn("spare", (need - F.col("f.own")).cast("long")).filter("spare > 0").withColumn("classes", F.col("f.classes")).drop("f")


# -- blocks ------------------------------------------------------------------------------------------


def _runs(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, sid: np.ndarray, percent: int):
    """(order, starts of runs): rows of a column whose ranges of sizes may hold a link, as runs in the order of key and size."""
    order = np.lexsort((sid, lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    # The largest size so far of the column: sizes are below 2^40, the column's number goes above.
    top = np.maximum.accumulate((np.cumsum(new).astype(np.int64) << 40) + hi) & ((1 << 40) - 1)
    new[1:] |= percent * lo[1:] > 100 * top[:-1]
    return order, np.flatnonzero(new)


def _entries(keyed: DataFrame, percent: int, words: int) -> DataFrame:
    """Leading shared columns of rows (sid, n, spare, classes, text) as runs (key, lo, hi, sid), and the chains inside of runs as rows (sid, sid, CHAIN, sid)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, waiting, held = Grams(words), [], 0
        for batch in batches:
            for sid, n, spare, classes, h in zip(*[batch.column(k).to_pylist() for k in range(4)], grams.of(batch.column(4)), strict=True):
                classes = np.frombuffer(classes, np.uint8)
                if len(classes) != len(h):
                    raise RuntimeError("columns were counted in part: rows came in another order when a task was run again")
                shared = np.flatnonzero(classes)
                first = h[shared[np.argsort(classes[shared], kind="stable")[:spare]]].view(np.int64)
                waiting.append((first, np.full(len(first), n), np.full(len(first), sid)))
                held += len(first)
                if held >= ENTRIES:
                    yield combined(waiting)
                    waiting, held = [], 0
        if waiting:
            yield combined(waiting)

    def combined(waiting) -> pa.RecordBatch:
        key, n, sid = (np.concatenate(c) for c in zip(*waiting, strict=True))
        return _combined(key, n, n, sid, percent, False)

    return keyed.select("sid", "n", "spare", "classes", "text").mapInArrow(work, "key long, lo long, hi long, sid long")


def _combined(key, lo, hi, sid, percent: int, last: bool) -> pa.RecordBatch:
    """Runs as one row each (not the last time), and their chains."""
    order, starts = _runs(key, lo, hi, sid, percent)
    head = np.repeat(starts, np.diff(np.append(starts, len(order))))
    ends = np.unique(np.stack([sid[order][head], sid[order]], axis=1), axis=0)
    a, b = ends[ends[:, 0] != ends[:, 1]].T
    if last:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    most = np.maximum.reduceat(hi[order], starts) if len(starts) else hi[:0]
    runs, chains = (key[order][starts], lo[order][starts], most, sid[order][starts]), (a, a, np.full(len(a), CHAIN), b)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(runs, chains, strict=True)], names=["key", "lo", "hi", "sid"])


def _chains(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): rows that meet in a column with sizes that may link, as chains."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            key, lo, hi, sid = (c.to_numpy() for c in batch.columns)
            done = hi == CHAIN
            yield pa.RecordBatch.from_arrays([pa.array(lo[done]), pa.array(sid[done])], names=["a", "b"])
            cols = [c[~done] for c in (key, lo, hi, sid)]
            if not len(cols[0]):
                continue
            if left is not None and left[0] == cols[0][0]:
                cols = [np.concatenate([[x], c]) for x, c in zip(left, cols, strict=True)]
            yield _combined(*cols, percent, True)
            # A column may go on in the next batch: what reaches farthest there is in its last run.
            same = np.flatnonzero(cols[0] == cols[0][-1])
            left = [c[same[np.argmax(cols[2][same])]] for c in cols]

    return entries.repartition("key").sortWithinPartitions("key", "lo", "sid").mapInArrow(work, "a long, b long")


# -- product -----------------------------------------------------------------------------------------


def product(sets: list[np.ndarray], percent: int = PERCENT, side: np.ndarray | None = None, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all rows of a block that links connect; exact.

    ``side``: rows of side 1 are compared with rows of side 2 alone.  ``root``: rows of one root are connected
    already; what it takes to connect different roots is given.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if m else np.empty(0, np.uint64)
    _, inverse, load = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(load), np.int64)
    rank[np.lexsort((np.arange(len(load)), load))] = np.arange(len(load))
    row = np.repeat(np.arange(m), sizes)
    columns = rank[inverse]
    order = np.lexsort((columns, row))
    columns = columns[order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # Postings of leading entries, by column.
    place = np.arange(len(columns)) - np.repeat(starts[:-1], sizes)
    leading = np.flatnonzero(place < np.repeat(_leading(sizes, percent), sizes))
    by_column = leading[np.argsort(columns[leading], kind="stable")]
    post_rows, bounds = row[by_column], np.searchsorted(columns[by_column], np.arange(len(load) + 1))
    groups = np.arange(m) if root is None else np.unique(root, return_inverse=True)[1]
    members = np.argsort(groups, kind="stable")
    group_bounds = np.searchsorted(groups[members], np.arange(groups.max() + 2 if m else 1))
    marked, free, links = np.zeros(len(load), bool), np.ones(m, bool), []
    for seed in range(m):
        if not free[seed]:
            continue
        # A group is reached as a whole; its rows are expanded one by one.
        ahead = members[group_bounds[groups[seed]] : group_bounds[groups[seed] + 1]].tolist()
        free[ahead] = False
        while ahead:
            if not free.any():
                return links
            i = ahead.pop()
            mine = columns[starts[i] : starts[i + 1]]
            wanted = mine[: int(_leading(int(sizes[i]), percent))]
            total = int((bounds[wanted + 1] - bounds[wanted]).sum())
            rest = np.flatnonzero(free)
            near = rest if len(rest) <= total else np.unique(np.concatenate([post_rows[bounds[c] : bounds[c + 1]] for c in wanted.tolist()]))
            near = near[free[near] & (100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i]))]
            if side is not None and side[i]:
                near = near[side[near] != side[i]]
            if not len(near):
                continue
            marked[mine] = True
            near = near[_reaches(near, columns, starts, sizes, marked, int(sizes[i]), percent)]
            marked[mine] = False
            for j in near.tolist():
                if free[j]:
                    links.append((i, j))
                    reached = members[group_bounds[groups[j]] : group_bounds[groups[j] + 1]].tolist()
                    free[reached] = False
                    ahead += reached
    return links


def _reaches(near: np.ndarray, columns, starts, sizes, marked, n: int, percent: int) -> np.ndarray:
    """Which rows' overlap with the marked columns (n of them) reaches the bound; given as positions in ``near``."""
    # |x & y| * (100 + percent) >= percent * (|x| + |y|)
    need = -(-percent * (sizes[near] + n) // (100 + percent))
    alive, overlap, done = np.arange(len(near)), np.zeros(len(near), np.int64), 0
    for k in range(1, RANGES + 1):
        rows = near[alive]
        lo, hi = starts[rows] + sizes[rows] * (k - 1) // RANGES, starts[rows] + sizes[rows] * k // RANGES
        width = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        sums = np.concatenate([[0], np.cumsum(marked[columns[at]])])
        ends = np.cumsum(width)
        overlap[alive] += sums[ends] - sums[ends - width]
        done = sizes[rows] * k // RANGES
        alive = alive[overlap[alive] + sizes[rows] - done >= need[alive]]
    return alive


def _multiplied(cells: DataFrame, percent: int, words: int, labelled: bool) -> DataFrame:
    """(a, b) of rows (sid, root, side, key, lo, hi, text) dealt out to cells (key, lo, hi)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.nbytes for b in waiting) >= 1 << 25:
                table = pa.Table.from_batches(waiting).combine_chunks()
                cols = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
                same = np.logical_and.reduce([c == c[-1] for c in cols])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield compare(table.slice(0, cut))
                waiting = table.slice(cut).to_batches()
        if waiting:
            yield compare(pa.Table.from_batches(waiting).combine_chunks())

    def compare(table: pa.Table) -> pa.RecordBatch:
        some, cell, side = numbered(table)
        sid, roots, texts = table.column("sid").to_numpy()[some], table.column("root").to_numpy()[some], table.column("text").combine_chunks().take(pa.array(some))
        a, b, grams = [], [], Grams(words)
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist() if len(cell) else []
        for s, e in zip(edges, [*edges[1:], len(cell)], strict=True):
            sets = list(grams.of(texts.slice(s, e - s)))
            for i, j in product(sets, percent, side[s:e] if side[s:e].any() else None, roots[s:e] if labelled else None):
                a.append(sid[s + i])
                b.append(sid[s + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = cells.select("sid", "root", "side", "key", "lo", "hi", "text").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "sid")
    return placed.mapInArrow(work, "a long, b long")


def _links(met: DataFrame, rows: DataFrame, percent: int, words: int, most: int) -> DataFrame:
    """(a, b): links that connect all rows of a block (key) that links connect; ``met`` has their (sid, n, key), ``rows`` their text as well."""
    weights = met.groupBy("key").agg(F.sum(F.col("n") + HEAD).alias("w"))
    big, blocks = counted(weights.filter(F.col("w") > most).select("key", F.ceil(F.col("w") / F.lit(most)).cast("int").alias("chunks")))
    zero, one = F.lit(0), F.lit(-1)
    alone = rows if not blocks else rows.join(F.broadcast(big) if blocks <= 100_000 else big, "key", "left_anti")
    links = _multiplied(alone.select("sid", F.col("sid").alias("root"), zero.alias("side"), "key", one.alias("lo"), one.alias("hi"), "text"), percent, words, False)
    if not blocks:
        return compact(links)
    large = rows.join(F.broadcast(big) if blocks <= 100_000 else big, "key").dropDuplicates(["sid"])
    large = compact(large.withColumn("c", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")))
    # Each chunk with itself and the hubs of its block.
    hubs = compact(large.groupBy("key", F.pmod("sid", F.lit(HUBS)).alias("part")).agg(F.min("sid").alias("sid")).select("key", "sid"))
    guests = large.join(F.broadcast(hubs) if blocks <= 25_000 else hubs, ["key", "sid"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own = large.select("key", "sid", "text", "c").union(guests.filter("o <> c").select("key", "sid", "text", "o"))
    links = compact(links.union(_multiplied(own.select("sid", F.col("sid").alias("root"), zero.alias("side"), "key", F.col("c").alias("lo"), F.col("c").alias("hi"), "text"), percent, words, False)))
    # What isn't connected with the most of its block meets all chunks.
    roots = components(links, "a", "b")
    labelled = compact(large.select("key", "sid", "n", "c", "chunks").join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")).drop("node"))
    heads = compact(labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main")))
    marked = labelled.join(F.broadcast(heads) if blocks <= 100_000 else heads, "key").withColumn("minor", F.col("root") != F.col("main"))
    groups = marked.filter("minor").groupBy("key").agg(F.ceil(F.sum(F.col("n") + HEAD) / F.lit(most)).cast("int").alias("minors"))
    groups, apart = counted(groups)
    if not apart:
        return links
    # Minor chunks are numbered from 0, the chunks of the main part after them.
    marked = marked.join(F.broadcast(groups) if apart <= 100_000 else groups, "key")
    place = F.when(F.col("minor"), F.pmod(F.xxhash64("sid"), F.col("minors"))).otherwise(F.col("c") + F.col("minors")).cast("int")
    marked = marked.withColumn("at", place)
    others = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("minors") + F.col("chunks") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    cells = marked.withColumn("o", F.explode(others)).select("key", "sid", "root", F.least("at", "o").alias("lo"), F.greatest("at", "o").alias("hi"), F.when(F.col("at") == F.col("o"), 0).when(F.col("at") < F.col("o"), 1).otherwise(2).alias("side"))
    dealt = compact(cells).join(large.select("key", "sid", "text"), ["key", "sid"])
    return compact(links.union(_multiplied(dealt, percent, words, True)))


def similarity_groups(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, most: int = SETS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of word n-grams; component_id is the
    smallest doc_id that is reached over links, the document's own included.  Defined results: A-Z and the kind of
    white space don't count; fewer words than an n-gram are one n-gram; texts that are null or have no word have an
    empty set and link with nothing, not even with each other; a null id is never the smallest (a group of null
    ids alone has a null component_id); repeated rows come back as often; further columns are not looked at; an
    empty table gives no rows.
    """
    named = own_columns(documents, ["doc_id", "text"])
    docs, every = counted(_documents(named, words))
    rows, distinct = counted(docs.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")))
    columns = lambda df: df.agg(F.sum("n")).first()[0] or 0
    # Each step is checkpointed: its shuffles go before the next one makes its own, however large the driver's heap is.
    release(named)
    named_once = None if every == distinct else _filter(rows, distinct)
    first, some = counted(_left(_frequencies(named, words, named_once, columns(rows), SAMPLED, False), rows, percent).select("sid", "least", "n"))
    release(named)
    wanted = _filter(first, some)
    keyed, some = counted(_left(_frequencies(named, words, wanted, columns(first), 1, True), first, percent).select("sid", "least", "n", "spare", "classes"))
    release(named)
    wanted = _filter(keyed, some)
    blocks = compact(components(_chains(_entries(_texts(named, words, wanted).join(keyed, "sid"), percent, words), percent), "a", "b"))
    # A block's root is named by the others alone.
    blocks = blocks.union(blocks.select("root", "root").distinct())
    release(named)
    met, some = counted(keyed.select("sid", "n").join(blocks, F.col("sid") == F.col("node")).select("sid", "n", F.col("root").alias("key")))
    release(named)
    links = _links(met, _texts(named, words, wanted).join(F.broadcast(met) if some <= 1_000_000 else met, "sid"), percent, words, most)
    roots = components(links, "a", "b")
    grouped = compact(rows.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("root", "sid").alias("root")))
    least = compact(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    by_set = compact(grouped.join(least, "root").select("sid", "component_id"))
    release(named)
    full = docs.filter("n > 0").join(by_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(docs.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))

