"""Exact top-k inner products over norm-sorted blocks.

Vectors are dealt into blocks by descending length.  A head of the longest vectors gives every query a
floor: its k-th best score there.  A query meets a block only if length times length (Cauchy-Schwarz) can
reach its floor.  Inside a block, vectors are rotated by the singular vectors of the whole table, so the first
coordinates hold most of the length: a partial sum over those plus the product of the residual lengths bounds
a pair's score, and pairs below the floor go.  What is left is multiplied out in integers.

At scale: the rotation is found from a d x d sum that is aggregated by position; the head and one number for each
of at most ``LEVELS`` levels of length are all that reaches the driver.  A level is cut into blocks by a hash of the
id, so equal lengths of any number spread over blocks.  Queries are dealt likewise by the length that they need, so
whole levels drop out, into far larger blocks (``QUERY_BYTES``): a vector is copied once for each block of queries
that may reach it.  One group is a pair of blocks, which is compared in slices: memory is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import durable
from ledgerline.llm.vectors import best, matrix, usable

#: Longest vectors that set the floors, candidates of a block, bytes of a block of queries, levels of a side.
HEAD, BLOCK, QUERY_BYTES, LEVELS = 2048, 4096, 32 << 20, 64
#: Queries of a block that are compared at once.
SLICE = 2048
#: Shares of the rotated coordinates after which pairs are pruned.
CUTS = (0.25, 0.5)


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> tuple[DataFrame, int, int]:
    """(vec_id, v as whole numbers, norm; dimension; rows): v is floor(scale * x) of every component."""
    rows, d, count = usable(vectors, key, vector)
    whole = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    return whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), d, count


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of the table, longest direction first, from its summed d x d products."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["at", "x"])

    summed = rows.select("v").mapInArrow(work, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(d * d)
    for r in summed:
        gram[r["at"]] = r["x"]
    _, vectors = np.linalg.eigh(gram.reshape(d, d))
    return np.ascontiguousarray(vectors[:, ::-1])


def _floors(scores: np.ndarray, qi: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query over different ids other than its own; -inf if there are fewer."""
    scores = np.where(qi[:, None] == ids[None], -np.inf, scores)
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(qi), -np.inf)


def pair_slice(x: np.ndarray, qi: np.ndarray, floor: np.ndarray, y: np.ndarray, yi: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores): the k best of each query in a block that reach its floor."""
    d = x.shape[1]
    length = np.sqrt((y**2).sum(1))
    order = np.lexsort((yi, -length))
    y, yi, length = y[order], yi[order], length[order]
    own = np.sqrt((x**2).sum(1))
    rx, ry = x @ turn, y @ turn
    cuts = sorted({max(1, min(d, round(c * d))) for c in CUTS} | {d})
    slack = 1e-9 * (1 + own * (length[0] if len(length) else 0))
    found = []
    for s in range(0, len(y), 1024):
        z = slice(s, s + 1024)
        # Vectors come by falling length: the rest of the block can't reach queries that this part can't.
        live = np.flatnonzero(own * length[s] + slack >= floor)
        if not len(live):
            break
        a = b = None
        lo = 0
        for c in cuts:
            if a is None:
                part = rx[live, lo:c] @ ry[z, lo:c].T
                rest = np.sqrt(np.maximum(0, (rx[live, c:] ** 2).sum(1)))[:, None] * np.sqrt((ry[z, c:] ** 2).sum(1))[None]
                keep = part + rest + slack[live, None] >= floor[live, None]
                if c < d and keep.mean() > 0.3:  # too many pairs are left for a list: go on with the whole part
                    part += rx[live, c:] @ ry[z, c:].T
                    keep = part + slack[live, None] >= floor[live, None]
                    i, b = np.nonzero(keep)
                    a, b = live[i], b + s
                    break
                i, b = np.nonzero(keep)
                a, b, sums = live[i], b + s, part[i, b]
            else:
                sums = sums + np.einsum("ij,ij->i", rx[a, lo:c], ry[b, lo:c])
                rest = np.sqrt((rx[a, c:] ** 2).sum(1) * (ry[b, c:] ** 2).sum(1)) if c < d else 0
                keep = sums + rest + slack[a] >= floor[a]
                a, b, sums = a[keep], b[keep], sums[keep]
            lo = c
        other = qi[a] != yi[b]
        a, b = a[other], b[other]
        score = np.einsum("ij,ij->i", x[a].astype(np.int64), y[b].astype(np.int64))
        good = score >= floor[a]
        found.append((a[good], yi[b[good]], score[good]))
        if len(found) > 1 and sum(len(f[0]) for f in found) > 64 * k * max(1, len(x)):
            found = [_keep_best(found, k)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, ids, score = _keep_best(found, k)
    return qi[a], ids, score


def pair_block(x: np.ndarray, qi: np.ndarray, floor: np.ndarray, y: np.ndarray, yi: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``pair_slice`` over slices of the queries."""
    parts = [pair_slice(x[s : s + SLICE], qi[s : s + SLICE], floor[s : s + SLICE], y, yi, turn, k) for s in range(0, max(1, len(x)), SLICE)]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _keep_best(found: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -score, a))
    a, ids, score = a[order], ids[order], score[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (ids[1:] != ids[:-1])  # a repeated row counts once
    a, ids, score = a[fresh], ids[fresh], score[fresh]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], ids[keep], score[keep]


def _blocks(rows: DataFrame, by: str, count: int, size: int, name: str) -> tuple[DataFrame, list[float], dict[int, int]]:
    """Rows with ``name`` (level, block) of about ``size`` rows; the largest ``by`` of each level, levels falling; their blocks.

    Levels are cut at approximate quantiles; a level's blocks at a hash of the id, as many as its rows need.
    """
    levels = max(1, min(LEVELS, -(-count // size)))
    cuts = []
    if levels > 1:
        found = rows.agg(F.percentile_approx(by, [k / levels for k in range(1, levels)], 10_000).alias("q")).first()["q"]
        cuts = sorted(set(found), reverse=True)
    level = sum([(F.col(by) < F.lit(c)).cast("int") for c in cuts], F.lit(0))
    placed = durable(rows.withColumn("_level", level))
    sizes = {r["_level"]: (r["n"], r["top"]) for r in placed.groupBy("_level").agg(F.count(F.lit(1)).alias("n"), F.max(by).alias("top")).collect()}
    blocks = F.create_map(*[F.lit(x) for v, (n, _) in sizes.items() for x in (v, -(-n // size))])
    block = F.pmod(F.xxhash64(F.lit(name), "vec_id"), blocks[F.col("_level")])
    tops = [sizes[v][1] if v in sizes else -math.inf for v in range(len(cuts) + 1)]
    return placed.withColumn(name, F.struct(F.col("_level").alias("level"), block.cast("int").alias("block"))).drop("_level"), tops, {v: -(-n // size) for v, (n, _) in sizes.items()}


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64, head: int = HEAD, block: int = BLOCK, queries: int | None = None) -> DataFrame:
    """The k highest integer inner products of every query row with all other rows, exactly.

    Components are floor(scale * x).  ``is_query`` is a condition on ``vec_id``; ``queries`` the rows of a block of
    queries (by default as many as QUERY_BYTES hold).  Returns query_id, rank (from 1), vec_id, score; equal scores
    are ranked by vec_id.  Defined results: vectors that are null, empty, of another dimension than most or that
    hold null or non-finite components take no part, nor do rows with a null id; a row is not its own candidate,
    nor is a repeated row of its id; repeated rows count once; with fewer than k candidates all are returned; an
    empty table gives no rows; further columns are not looked at.  Scores are exact while |floor(scale * x)| <
    2**26 and sums stay in 64 bits.
    """
    rows, d, count = quantised(vectors, key, vector, scale)
    spark = vectors.sparkSession
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(head).collect()
    seen = {r["vec_id"]: r["v"] for r in longest}
    shared = spark.sparkContext.broadcast((rotation(rows, d), np.array(list(seen), np.int64), np.array(list(seen.values())).reshape(-1, d)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, top = shared.value
        for batch in batches:
            qi, x = batch.column(0).to_numpy(), matrix(batch.column(1), d)
            low = np.concatenate([_floors(x[s : s + 1024] @ top.T, qi[s : s + 1024], ids, k) for s in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
            norm = np.sqrt((x**2).sum(1))
            # Negated, so that levels fall from the queries that need least.
            need = np.divide(-low, norm, out=np.full(len(x), np.inf), where=norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low), pa.array(need)], names=["vec_id", "v", "floor", "reach"])

    asked = durable(rows.filter(is_query).select("vec_id", "v").mapInArrow(floors, "vec_id long, v array<double>, floor double, reach double"))
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, tops, b_sizes = _blocks(rows, "norm", count, block, "b")
    asked, reach, q_sizes = _blocks(asked, "reach", n_queries, queries or max(SLICE, QUERY_BYTES // (8 * d)), "q")
    # A level of queries meets the levels of vectors that are long enough for the one that needs least.
    met = [(q, b) for q, least in enumerate(reach) for b, top in enumerate(tops) if q in q_sizes and b in b_sizes and top * (1 + 1e-9) + 1e-9 >= -least]
    left = _dealt(asked, "q", "b", met, b_sizes)
    right = _dealt(blocks, "b", "q", [(b, q) for q, b in met], q_sizes)

    def group(q: pa.Table, p: pa.Table) -> pa.Table:
        if q.num_rows and p.num_rows:
            got = pair_block(matrix(q.column("v"), d), q.column("vec_id").to_numpy(), q.column("floor").to_numpy(), matrix(p.column("v"), d), p.column("vec_id").to_numpy(), shared.value[0], k)
        else:
            got = (np.zeros(0, np.int64),) * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    partial = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(group, "query_id long, vec_id long, score long")
    return best(partial, k, F.desc("score"))


def _dealt(rows: DataFrame, own: str, other: str, met: list[tuple[int, int]], sizes: dict[int, int]) -> DataFrame:
    """Rows of a level once for each block of the levels of the other side that it meets (LEVELS squared pairs at most)."""
    of: dict[int, list[int]] = {}
    for a, b in met:
        of.setdefault(a, []).append(b)
    if not of:
        return rows.limit(0).withColumn(other, F.col(own))
    levels = F.create_map(*[F.lit(x) for a, bs in of.items() for x in (a, F.array(*[F.struct(F.lit(b).alias("level"), F.lit(sizes[b]).alias("n")) for b in bs]))])
    pairs = F.flatten(F.transform(levels[F.col(own)["level"]], lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda k: F.struct(s["level"].alias("level"), k.alias("block")))))
    return rows.withColumn(other, F.explode(pairs))
