"""BPE encoding and decoding of whole texts by tree concatenation.

A long text is halved again and again, at any character, into leaves.  Leaves are encoded side by side;
then neighbours are joined up the tree.  A join re-encodes a window around the cut and grows it until the
window's first and last piece equal those of the left and of the right side; then the two sides and the
window are spliced.  There are two grains:

* Text.  ASCII white space always ends a token of a tokenizer that drops white space, so a text's
  encoding is that of its white-space-separated words one after another (Unicode normalisation and case
  folding never reach over white space).  Leaves are lists of encoded words; a window that begins and ends
  with words that both encodings share is exact.
* Run.  A piece that the tokenizer's own pattern leaves unsplit and that is longer than ``run_leaf`` bytes
  is halved inside.  A sequence of BPE tokens is the encoding of its string exactly if each adjacent pair
  is the encoding of the pair's string; so a window that shares its first token with the left side and its
  last with the right side makes every adjacent pair valid.  Only the last leaf carries the word-end mark.

Encodings of short words are kept in a bounded table a worker, so frequent words are encoded once.
No shuffle: texts are encoded where they are read.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerline.llm.common import by_place, place_of

#: Bytes of a leaf of a text and of an unsplit run; words of up to KEPT bytes are remembered, up to TABLE of them
#: and TABLE parts of words.
TEXT_LEAF, RUN_LEAF, KEPT, TABLE = 16_384, 512, 48, 200_000
#: Rows and bytes of text that are encoded before they are handed on.
ROWS, BYTES = 256, 1 << 20
SPACE = b" \t\n\x0b\x0c\r"

#: The tokenizer pattern and normaliser whose effect on plain words is worked out here, and what
#: plain words are made of (printable ASCII and the letters of Latin-1, in UTF-8).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
PLAIN = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")

SCHEMA = "n_tokens long, ids binary, decoded string"


def tree(leaves: list, join: Callable):
    """Join neighbours, then neighbours of the results, until one is left."""
    while len(leaves) > 1:
        pairs = [join(leaves[i], leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) // 2 * 2 :]
    return leaves[0]


def sliced(items: list, size: int = 2048) -> Iterator[list]:
    """A list in slices: what the library makes of one is freed before the next."""
    return (items[k : k + size] for k in range(0, len(items), size))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


def unpacked(data: bytes) -> array | list[int]:
    """Ids of what ``packed`` gave."""
    return array("I", data) if sys.byteorder == "little" else [int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)]


class Codec:
    """The encoder of one worker, made from the text of a tokenizer file."""

    def __init__(self, tokenizer_json: str, text_leaf: int = TEXT_LEAF, run_leaf: int = RUN_LEAF):
        from tokenizers import Tokenizer, models

        self.full = Tokenizer.from_str(tokenizer_json)
        self.full.no_truncation()
        self.full.no_padding()
        self.text_leaf, self.run_leaf = max(2, text_leaf), max(2, run_leaf)
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        size = self.full.get_vocab_size(with_added_tokens=True)
        self.token = [self.full.id_to_token(i) or "" for i in range(size)]
        self.spelt = [x.encode() for x in self.token]
        self.mark = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # The bare model, over strings that have one symbol a byte: with and (made when needed) without the mark.
        self.closed = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.mark or None))
        self._open = None
        self.source = tokenizer_json
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # A word of the usual characters is split here, as the tokenizer's own pattern would; the parts of all
        # words, which are far fewer than the words, go to the bare model.
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        usual = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == NORMALISERS
        self.plain = usual and [p.get("type") for p in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": PATTERN} and bool(self.mark) and all("<|" in t["content"] for t in spec.get("added_tokens", []))
        # One symbol for each byte: printable ones stand for themselves, the others follow from 256 on.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in kept]
        self.symbols = {b: 256 + k for k, b in enumerate(others)}
        self.parts: dict[str, bytes] = {}
        self.ids: dict[bytes, bytes] = {}

    @property
    def open(self):
        """The bare model without the word-end mark."""
        if self._open is None:
            from tokenizers import Tokenizer, models

            model = json.loads(self.source)["model"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self._open = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        return self._open

    # -- words -------------------------------------------------------------------------------------

    def learn(self, words: set[bytes]) -> None:
        """Encode the words that the table lacks, in one parallel call; long unsplit ones by their own tree."""
        new = [w for w in words if w not in self.ids]
        plain, short = [], []
        for w in new:
            if len(w) > self.run_leaf:
                self.ids[w] = packed(self.long_word(w.decode()))
            elif self.plain and PLAIN.fullmatch(w) and b"<|" not in w:
                plain.append(w)
            else:
                short.append(w)
        # All plain words in one string: split, and looked up part by part.
        found = PLAIN_PARTS.findall(b"\n".join(plain).decode().lower()) if plain else []
        parts = self.parts
        fresh = list({p for p in found if p not in parts and p != "\n"})
        for some in sliced(fresh):
            for p, e in zip(some, self.closed.encode_batch_fast([p if p.isascii() else p.encode().decode("latin-1").translate(self.symbols) for p in some], add_special_tokens=False), strict=True):
                parts[p] = packed(e.ids)
        ids, k = b"", 0
        for p in found:
            if p == "\n":
                self.ids[plain[k]] = ids
                ids, k = b"", k + 1
            else:
                ids += parts[p]
        if plain:
            self.ids[plain[k]] = ids
        for some in sliced(short):
            for w, e in zip(some, self.full.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.ids[w] = packed(e.ids)
        if len(parts) > TABLE:
            parts.clear()

    def forget_long(self) -> None:
        """Drop the words too long to be worth keeping."""
        for w in [w for w in self.ids if len(w) > KEPT]:
            del self.ids[w]

    # -- long unsplit runs -------------------------------------------------------------------------

    def long_word(self, word: str) -> list[int]:
        """Ids of a word of any length: special tokens and the pattern split it, runs are concatenated."""
        out: list[int] = []
        for part in self.special.split(word) if self.special else [word]:
            if self.special and self.special.fullmatch(part):
                out.append(self.full.token_to_id(part))
            elif part:
                text = self.full.normalizer.normalize_str(part) if self.full.normalizer else part
                for run, _ in self.full.pre_tokenizer.pre_tokenize_str(text):
                    out += self.run(run)
        return out

    def run(self, run: str) -> list[int]:
        """Ids of an unsplit run of byte symbols."""
        if len(run) <= self.run_leaf:
            return self.closed.encode(run, add_special_tokens=False).ids
        parts = self._halves(run)
        *inner, last = parts
        leaves = [e.ids for e in self.open.encode_batch_fast(inner, add_special_tokens=False)] if inner else []
        leaves.append(self.closed.encode(last, add_special_tokens=False).ids)
        return tree([(x, k == len(leaves) - 1) for k, x in enumerate(leaves)], self.join_runs)[0]

    def _halves(self, run: str) -> list[str]:
        if len(run) <= self.run_leaf:
            return [run]
        cut = len(run) // 2
        return self._halves(run[:cut]) + self._halves(run[cut:])

    def join_runs(self, left: tuple[list[int], bool], right: tuple[list[int], bool]) -> tuple[list[int], bool]:
        (a, _), (b, ends) = left, right
        k = 2
        while True:
            i, j = min(k, len(a)), min(k, len(b))
            whole = ends and j == len(b)
            string = "".join([self.token[x] for x in a[len(a) - i :] + b[:j]])
            model = self.closed if whole else self.open
            if whole and self.mark:
                string = string.removesuffix(self.mark)
            window = model.encode(string, add_special_tokens=False).ids
            if (i == len(a) or window[0] == a[-i]) and (j == len(b) or window[-1] == b[j - 1]):
                return a[: len(a) - i] + window + b[j:], ends
            k *= 2

    # -- whole texts -------------------------------------------------------------------------------

    @staticmethod
    def _last_space(data: bytes, lo: int, hi: int) -> int:
        """Place of the last white space in data[lo:hi], else lo - 1."""
        return max([lo - 1, *(data.rfind(SPACE[k : k + 1], lo, hi) for k in range(len(SPACE)))])

    @staticmethod
    def _next_space(data: bytes, lo: int, hi: int) -> int:
        """Place of the first white space in data[lo:hi], else hi."""
        return min([hi, *(x for k in range(len(SPACE)) if (x := data.find(SPACE[k : k + 1], lo, hi)) >= 0)])

    def cuts(self, data: bytes, lo: int, hi: int) -> list[tuple[int, int]]:
        """Halves of data[lo:hi] down to leaves; a long unsplit word is never cut here."""
        if hi - lo <= self.text_leaf:
            return [(lo, hi)]
        cut = (lo + hi) // 2
        while cut > lo and data[cut] & 0xC0 == 0x80:
            cut -= 1
        before, after = self._last_space(data, lo, cut), self._next_space(data, cut, hi)
        if cut - before > self.run_leaf or after - cut > self.run_leaf:  # inside a long unsplit word
            cut = before + 1 if before >= lo else after
        if not lo < cut < hi:
            return [(lo, hi)]
        return self.cuts(data, lo, cut) + self.cuts(data, cut, hi)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of every text."""
        if len(self.ids) > TABLE:
            self.ids.clear()
        trees, words = [], set()
        for text in texts:
            data = (text or "").encode()
            leaves = []
            for lo, hi in self.cuts(data, 0, len(data)):
                part = data[lo:hi].split()
                words.update(part)
                leaves.append((part, bool(part) and data[lo] not in SPACE, bool(part) and data[hi - 1] not in SPACE))
            trees.append(leaves)
        self.learn(words)
        out = []
        for leaves in trees:
            part = tree(leaves, self.join_texts)[0]
            if len(leaves) > 1:  # words that came about where leaves meet
                self.learn(set(part).difference(self.ids))
            ids = b"".join(map(self.ids.__getitem__, part))
            out.append((ids, b" ".join(map(self.spelt.__getitem__, unpacked(ids)))))
        self.forget_long()
        return out

    def join_texts(self, left: tuple, right: tuple) -> tuple:
        """Each side: its words in order, and whether a word touches its first and its last byte."""
        (a, opens, at_cut), (b, after_cut, closes) = left, right
        if not a or not b:
            return a or b, bool(a) and opens, bool(b) and closes
        k = 2
        while True:
            i, j = min(k, len(a)), min(k, len(b))
            near, far = a[len(a) - i :], b[:j]
            if at_cut and after_cut:
                window = [*near[:-1], near[-1] + far[0], *far[1:]]
            else:
                window = near + far
            self.learn(set(window))
            sides = {near[0], far[-1]}
            self.learn(sides)
            if (i == len(a) or self.ids[window[0]] == self.ids[near[0]]) and (j == len(b) or self.ids[window[-1]] == self.ids[far[-1]]):
                return a[: len(a) - i] + window + b[j:], opens, closes
            k *= 2


def encode(documents: DataFrame, tokenizer: str, text: str = "text", text_leaf: int = TEXT_LEAF, run_leaf: int = RUN_LEAF) -> DataFrame:
    """Encode a text column and decode it again.

    ``tokenizer`` is the path of a tokenizer file on the driver; its content goes to the workers by
    broadcast (one file of fixed size).  Adds n_tokens, ids (little-endian unsigned 32-bit integers) and
    decoded (tokens joined as the tokenizer's decoder-less decode does) to every row.  Defined results: a
    null text is encoded as an empty one (0 tokens, empty binary, empty string); any other column may be
    null or missing; repeated rows are encoded alike; an empty table gives no rows.  The three names
    replace columns of the same name in any case; columns of any other name stay.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in documents.columns if c.lower() not in ("n_tokens", "ids", "decoded")]
    source = by_place(documents).select(*[place_of(documents, c) for c in keep])
    at = keep.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Leaves are encoded side by side by the library's threads; each thread keeps memory of its own, so a
        # task starts few of them.  Spark's tasks are what fills the cores.
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        codec = Codec(shared.value, text_leaf, run_leaf)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                size, stop, column = 0, start, batch.column(at)
                while stop < batch.num_rows and stop - start < ROWS and size < BYTES:
                    size += len(column[stop].as_buffer() or b"") if column[stop].is_valid else 0
                    stop += 1
                part = batch.slice(start, stop - start)
                done = codec.encode(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([len(x) // 4 for x, _ in done], pa.int64()),
                        pa.array([x for x, _ in done], pa.binary()),
                        pa.array([y.decode() for _, y in done], pa.string()),
                    ],
                    names=[*part.schema.names, "n_tokens", "ids", "decoded"],
                )
                start = stop

    schema = T.StructType([*source.schema.fields, *T._parse_datatype_string(SCHEMA).fields])
    return source.mapInArrow(work, schema).toDF(*keep, "n_tokens", "ids", "decoded")
