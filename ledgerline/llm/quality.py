"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each).  Every passage of the whole text is encoded: the
shares of kinds of bytes, and how words look and repeat.  A small network, trained from document labels alone,
embeds each passage, weighs it by gated attention (tanh gate times sigmoid gate, softmax over the document),
and scores the weighted sum of the embeddings.

At scale: the fit uses a bounded sample of labelled rows (``PER_CLASS`` documents of a class with ``BUDGET`` passages
in all, every chosen document with all its passages), so its cost is the same for any corpus.  Scoring is one pass without a shuffle; very long texts are
encoded piece by piece, and the softmax is merged over pieces, so memory doesn't follow a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import by_place, durable, own_columns, place_of

#: Words of a passage; bytes of a piece of a long text; bytes encoded at once.
PASSAGE, PIECE = 100, 1 << 20
#: The bounds of the training sample for each class: documents, and passages of all of them.
PER_CLASS, BUDGET = 3000, 60_000
EMBED, GATE, EPOCHS, SEED = 24, 12, 240, 11

#: Kinds of bytes whose shares are features; the rest is one more kind.  Letters are not told apart, nor those
#: beyond ASCII from a-z, so that no language looks better than another.
LOWER = b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
KINDS = (LOWER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"'\"", b"#", b"$", b"%", b"&", b"*", b"|", b"@", b"/\\", b":;", b"-", b"_", b"()[]{}", b"<>", b"=+~^`")
_KIND = np.full(256, len(KINDS), np.uint8)
for _k, _bytes in enumerate(KINDS):
    _KIND[list(_bytes)] = _k
N_KINDS = len(KINDS) + 1
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
WORD_FEATURES = 9
FEATURES = N_KINDS + WORD_FEATURES


def pieces(data: bytes, size: int = PIECE) -> list[bytes]:
    """A text in pieces of about ``size`` bytes, cut at white space where there is some."""
    out, at = [], 0
    while len(data) - at > size:
        cut = max(data.rfind(b" ", at + size // 2, at + size), data.rfind(b"\n", at + size // 2, at + size))
        cut = cut if cut > at else at + size
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def encode(texts: list[bytes], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of its text), for texts that fit in memory together.

    A text without words is one passage.  Vectorised over all bytes of all texts.
    """
    n = len(texts)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(begin, start, "right") - 1
    words = np.bincount(doc, minlength=n)
    count = np.maximum(1, -(-words // passage))
    base = np.concatenate([[0], np.cumsum(count)[:-1]])
    total = int(count.sum())
    owner = np.repeat(np.arange(n), count)
    index = np.arange(len(start)) - np.concatenate([[0], np.cumsum(words)[:-1]])[doc]
    at = base[doc] + index // passage
    # A byte belongs to the passage of the last word of its text that has begun, what comes before to the first passage.
    of_text = np.repeat(np.arange(n), sizes)
    word = np.repeat(np.arange(-1, len(start)), np.diff(np.concatenate([[0], start, [len(data)]])))
    begun = np.append(doc, -1)[word] == of_text
    of_byte = np.where(begun, np.append(at, 0)[word], base[of_text])
    kinds = np.bincount(of_byte * N_KINDS + _KIND[data], minlength=total * N_KINDS).reshape(total, N_KINDS).astype(np.float64)
    shares = kinds / np.maximum(1, kinds.sum(1, keepdims=True))
    # Words: hashes by prefix sums of powers modulo 2**64, which are invertible for an odd base.
    with np.errstate(over="ignore"):
        power = np.empty(len(data), np.uint64)
        power[0], power[1:] = 1, _BASE
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(power))])
        back = np.empty(len(data), np.uint64)
        back[0], back[1:] = 1, _INVERSE
        hashed = (prefix[stop] - prefix[start]) * np.cumprod(back)[start] * np.uint64(0xFF51AFD7ED558CCD)
    length = (stop - start).astype(np.float64)
    each = np.maximum(1, np.bincount(at, minlength=total))

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=x, minlength=total) / each

    def sums(flag: np.ndarray) -> np.ndarray:
        total_ = np.concatenate([[0], np.cumsum(flag)])
        return (total_[stop] - total_[start]).astype(np.float64)

    kind = _KIND[data]
    upper, letters = sums(kind == 1), sums(kind <= 1)
    marks = sums((kind >= 6) & (kind < len(KINDS)))
    known = np.sort((at.astype(np.uint64) << np.uint64(36)) | (hashed >> np.uint64(28)))
    fresh = np.ones(len(known), bool)
    fresh[1:] = known[1:] != known[:-1]
    distinct = np.bincount((known[fresh] >> np.uint64(36)).astype(np.int64), minlength=total) / each
    same = np.zeros(len(start))
    same[1:] = (hashed[1:] == hashed[:-1]) & (at[1:] == at[:-1])
    average = mean(length)
    more = np.stack(
        [
            average / 10,
            np.sqrt(np.maximum(0, mean(length**2) - average**2)) / 10,
            mean((length > 20).astype(float)),
            mean(((upper > 1) & (upper == letters)).astype(float)),
            mean((marks > 1).astype(float)),
            mean((letters == 0).astype(float)),
            distinct,
            mean(same),
            np.log1p(each) / 5,
        ],
        axis=1,
    )
    return np.concatenate([shares, more], axis=1).astype(np.float32), owner


@dataclass
class Network:
    """Embedding, gated attention and score; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding and attention logit of each passage."""
        w = self.weights
        h = np.tanh(((x - self.mean) / self.scale).clip(-6, 6) @ w["W"] + w["b"])
        gate = np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])
        return h, gate @ w["w"]

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from their passages (owners sorted, none without a passage)."""
        h, logit = self.parts(x)
        begin = np.searchsorted(owner, np.arange(n))
        top = np.maximum.reduceat(logit, begin)
        e = np.exp(logit - top[owner])
        z = np.add.reduceat(e[:, None] * h, begin, axis=0) / np.add.reduceat(e, begin)[:, None]
        return _sigmoid(z @ self.weights["c"] + self.weights["d"][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(x: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit by Adam on the weighted cross entropy of document labels, all gradients written out."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-2
    data = ((x - mean) / scale).clip(-6, 6)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"W": draw(x.shape[1], EMBED), "b": np.zeros(EMBED), "V": draw(EMBED, GATE), "U": draw(EMBED, GATE), "w": draw(GATE), "c": draw(EMBED), "d": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    decay = 1e-4
    for t in range(1, epochs + 1):
        _, grad = gradients(w, data, owner, labels, weight)
        for k in w:
            step = grad[k] + decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * step
            second[k] = 0.999 * second[k] + 0.001 * step**2
            w[k] -= 0.02 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, w)


def gradients(w: dict[str, np.ndarray], data: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(weighted mean cross entropy, its gradient by each weight) over bags of standardised passages."""
    begin = np.searchsorted(owner, np.arange(len(labels)))
    h = np.tanh(data @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (v * u) @ w["w"]
    e = np.exp(logit - np.maximum.reduceat(logit, begin)[owner])
    a = e / np.add.reduceat(e, begin)[owner]
    z = np.add.reduceat(a[:, None] * h, begin, axis=0)
    p = _sigmoid(z @ w["c"] + w["d"][0])
    loss = float(-(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weight.sum())
    g = weight * (p - labels) / weight.sum()
    dz = g[:, None] * w["c"]
    da = (h * dz[owner]).sum(1)
    dlogit = a * (da - np.add.reduceat(a * da, begin)[owner])
    dgate = dlogit[:, None] * w["w"]
    dv, du = dgate * u * (1 - v**2), dgate * v * u * (1 - u)
    dh = (a[:, None] * dz[owner] + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
    return loss, {"W": data.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ dlogit, "c": z.T @ g, "d": np.array([g.sum()])}


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3: such rows are never learnt from (nor null ids)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, budget: int = BUDGET) -> Network | None:
    """Network from a bounded sample of labelled documents; None if there aren't both classes.

    The sample: of each class the ``per_class`` documents that a hash of the id puts first, without held-out ids, as
    far as their passages stay within ``budget``; a document of more than a sixteenth of the budget comes after all
    others.  Chosen documents are learnt from with all their passages, the first of a class whatever its size.  Of
    several labels of a document the lowest counts; labels other than 0 and 1 don't.  Of repeated rows of an id one
    is learnt from.
    """
    usable = own_columns(labels, ["doc_id", "quality"]).select("doc_id", F.col("quality").cast("int").alias("quality"))
    usable = usable.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("doc_id")]
    sizes = {r["quality"]: r["count"] for r in each.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return None
    sample = each.filter("quality = 0").orderBy(*order).limit(per_class).union(each.filter("quality = 1").orderBy(*order).limit(per_class))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one row at a time: bags may be large
                row = batch.slice(k, 1)
                text = row.column(2)[0]
                x = np.concatenate([encode([piece])[0] for piece in pieces(text.as_buffer().to_pybytes() if text.is_valid else b"")])
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([len(x)], pa.int64()), pa.array([np.ascontiguousarray(x, "<f4").tobytes()], pa.binary())], names=["doc_id", "quality", "n", "x"])

    # At most 2 * per_class rows are broadcast, and as many bags come out.
    chosen = own_columns(documents, ["doc_id", "text"]).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    bags_ = durable(chosen.mapInArrow(work, "doc_id long, quality int, n long, x binary"))
    once = bags_.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct("n", F.xxhash64("x").alias("h"))).alias("bag"))
    turn = Window.partitionBy("quality").orderBy(F.col("bag.n") > budget // 16, *order)
    fits = F.sum("bag.n").over(turn.rowsBetween(Window.unboundedPreceding, 0)) <= budget
    kept = once.withColumn("fits", fits | (F.row_number().over(turn) == 1)).filter("fits").select("doc_id", "bag")
    rows = bags_.join(F.broadcast(kept), "doc_id").filter((F.col("n") == F.col("bag.n")) & (F.xxhash64("x") == F.col("bag.h"))).select("doc_id", "quality", "x").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES) for r in rows]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    # Classes weigh as they do among all labelled documents, halfway to even.
    share = {q: (sizes[q] / sum(sizes.values())) ** 0.5 / max(1, int((y == q).sum())) for q in sizes}
    return train(np.concatenate(bags), owner, y.astype(float), np.array([share[q] for q in y]))


def score_texts(net: Network | None, texts: list[bytes], piece: int = PIECE) -> np.ndarray:
    """Scores of texts that fit in memory together; a single text is encoded piece by piece and its softmax merged."""
    if net is None or not texts:
        return np.full(len(texts), 0.5)
    if len(texts) > 1 or len(texts[0]) <= piece:
        return net.score(*encode(texts), len(texts))
    top, mass, z = -np.inf, 0.0, np.zeros(EMBED)
    for part in pieces(texts[0], piece):
        h, logit = net.parts(encode([part])[0])
        new = max(top, float(logit.max()))
        e = np.exp(logit - new)
        mass, z, top = mass * np.exp(top - new) + e.sum(), z * np.exp(top - new) + e @ h, new
    return _sigmoid(np.array([z / mass @ net.weights["c"] + net.weights["d"][0]]))


def score(documents: DataFrame, network: Network | None, name: str = "score") -> DataFrame:
    """Add the quality score (0 to 1) of every whole text; columns of any name stay, one of the score's name is replaced.

    Defined results: a null text counts as empty; an empty text has one passage with no words and is scored;
    without a network (no labels of both classes) every score is 0.5; repeated rows are scored alike; an empty
    table gives no rows.
    """
    keep = [c for c in documents.columns if c.lower() != name.lower()]
    plain = by_place(documents).select(*[place_of(documents, c) for c in keep])
    at = keep.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, group, size = [], [], 0
            for text in batch.column(at):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if size + len(data) > PIECE and group:
                    found.append(score_texts(shared.value, group))
                    group, size = [], 0
                group.append(data)
                size += len(data)
            found.append(score_texts(shared.value, group))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found).clip(0, 1), pa.float64())], names=[*batch.schema.names, "score"])

    scored = plain.mapInArrow(work, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.toDF(*keep, name)
