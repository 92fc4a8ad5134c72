"""Approximate nearest neighbours over balanced posting lists.

Fit, on a bounded sample: centroids by k-means whose assignment is charged for crowded lists, so lists come
out balanced; a graph links each centroid to its nearest ones.  Index, every row: a best-first walk of the
in-memory graph finds a vector's nearest centroids; it goes to the nearest list and, as a boundary vector, to
others within (1 + near) of that distance, up to ``copies`` lists.  Search: the same walk ranks the lists for
a query; it reads its ``least`` nearest lists and all others within (1 + ratio) of the nearest one's distance, and
nothing else bounds how many those are.  Queries that get fewer than min(k, candidates) answers so are searched again
over ``WIDER`` times as many lists, and those still short over all lists.  The same rule holds at every size of table;
``ratio=math.inf`` reads all lists and is exact.

At scale: only centroids and graph (at most ``most_lists`` rows) are broadcast.  A posting list of any size
is cut into chunks, and so are the queries that read it; each pair of chunks is one group, so no task holds a
whole hot list.  Every group gives each query its k best, which a window merges.  Distances are recomputed
from the original vectors in double precision before ranking.
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

#: Most lists, sampled rows a list, and rows of a chunk.
MOST_LISTS, SAMPLE, CHUNK = 4096, 16, 4096
#: A vector goes to lists within 1 + NEAR of its nearest centroid, COPIES at most.
NEAR, COPIES = 0.1, 2
#: A query reads its LEAST nearest lists and those within 1 + RATIO of its nearest centroid; WIDER times as many again.
RATIO, LEAST, WIDER = 0.16, 16, 16


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T)


def balanced_centroids(sample: np.ndarray, lists: int, steps: int = 10, seed: int = 7) -> np.ndarray:
    """K-means centroids; a list's size beyond its share is added to its distance, step by step."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    charge = np.zeros(lists)
    for _ in range(steps):
        near = np.empty(len(sample), np.int64)
        for i in range(0, len(sample), 4096):
            d = distances(sample[i : i + 4096], centres)
            near[i : i + 4096] = np.argmin(d + charge, axis=1)
        sizes = np.bincount(near, minlength=lists)
        charge += 0.02 * d.mean() * (sizes * lists / len(sample) - 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = sizes == 0
        centres = np.where(empty[:, None], sample[rng.integers(len(sample), size=lists)], sums / np.maximum(sizes, 1)[:, None])
    return centres


class Graph:
    """Centroids and, for each, its nearest others; searched by a best-first walk."""

    def __init__(self, centres: np.ndarray, degree: int = 16):
        self.centres = centres
        k = len(centres)
        self.degree = min(degree, max(1, k - 1))
        d = distances(centres, centres)
        np.fill_diagonal(d, np.inf)
        self.links = np.argsort(d, axis=1, kind="stable")[:, : self.degree] if k > 1 else np.zeros((1, 1), np.int64)
        # The walk starts from spread entries: every round(sqrt(k))-th centroid.
        self.entries = np.arange(0, k, max(1, round(math.sqrt(k))))

    def nearest(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances), nearest first, of the ``want`` nearest centroids that the walk finds."""
        k, want = len(self.centres), min(want, len(self.centres))
        beam = min(k, max(want + 8, 24))
        out_i, out_d = np.empty((len(x), want), np.int64), np.empty((len(x), want))
        for s in range(0, len(x), 256):
            part = x[s : s + 256]
            n, rows = len(part), np.arange(len(part))[:, None]
            if want == k:  # every list: nothing to walk, and none may be out of the graph's reach
                far = distances(part, self.centres)
                order = np.argsort(far, axis=1, kind="stable")
                out_i[s : s + n], out_d[s : s + n] = order, np.sqrt(far[rows, order])
                continue
            seen, opened = np.zeros((n, k), bool), np.zeros((n, k), bool)
            far = np.full((n, k), np.inf)
            far[:, self.entries] = distances(part, self.centres[self.entries])
            seen[:, self.entries] = True
            while True:
                top = np.argpartition(far, beam - 1, axis=1)[:, :beam] if beam < k else np.argsort(far, axis=1)
                d = np.where(opened[rows, top], np.inf, far[rows, top])
                pick = np.argsort(d, axis=1)[:, :4]
                go = np.isfinite(np.take_along_axis(d, pick, 1))
                if not go.any():
                    break
                node = top[rows, pick]
                opened[np.broadcast_to(rows, node.shape)[go], node[go]] = True
                r = np.repeat(np.broadcast_to(rows, node.shape)[go], self.degree)
                c = self.links[node[go]].ravel()
                new = ~seen[r, c]
                r, c = r[new], c[new]
                seen[r, c] = True
                far[r, c] = ((part[r] - self.centres[c]) ** 2).sum(1)
            order = np.argsort(far, axis=1, kind="stable")[:, :want]
            out_i[s : s + n], out_d[s : s + n] = order, np.sqrt(far[rows, order])
        return out_i, out_d

    def within(self, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the ``least`` nearest lists of each row and of those within 1 + ratio of the nearest.

        The walk is widened for the rows whose last list found is still near enough.
        """
        k = len(self.centres)
        todo, want, found = np.arange(len(x)), k if math.isinf(ratio) else min(k, max(32, 2 * least)), []
        while len(todo):
            lists, far = self.nearest(x[todo], want)
            limit = np.inf if math.isinf(ratio) else (1 + ratio) * far[:, :1]
            done = (far[:, -1] > np.ravel(limit)) if want < k else np.ones(len(todo), bool)
            good = ((far <= limit) | (np.arange(want) < least)) & np.isfinite(far) & done[:, None]
            row, col = np.nonzero(good)
            found.append((todo[row], lists[row, col]))
            todo, want = todo[~done], min(k, 4 * want)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def fit(vectors: DataFrame, rows: int, most_lists: int = MOST_LISTS) -> Graph:
    """Graph of about sqrt(rows) balanced centroids, from SAMPLE rows for each, chosen by a hash of the id."""
    lists = max(1, min(most_lists, round(math.sqrt(rows))))
    got = vectors.orderBy(F.xxhash64(F.lit("sample"), F.col("vec_id")), "vec_id").limit(SAMPLE * lists).collect()
    sample = np.unique(np.array([r["v"] for r in got]), axis=0)  # copies would make equal lists
    return Graph(balanced_centroids(sample, min(lists, len(sample))))


def _routed(rows: DataFrame, graph, d: int, ratio: float, least: int, most: int | None = None) -> DataFrame:
    """One row (list, id, v) for each list that a vector goes to, ``most`` of them at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                x = matrix(part.column(1), d)
                if most is None:
                    row, lists = graph.value.within(x, ratio, least)
                else:
                    near, far = graph.value.nearest(x, most)
                    row, col = np.nonzero((far <= (1 + ratio) * far[:, :1]) & np.isfinite(far))
                    lists = near[row, col]
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *taken.columns], names=["list", "id", "v"])

    return rows.select(F.col("vec_id").alias("id"), "v").mapInArrow(work, "list int, id long, v array<double>")


def _chunked(rows: DataFrame, chunk: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows with the number of their chunk, and how many chunks each list has (one entry a list)."""
    sizes = {r["list"]: -(-r["count"] // chunk) for r in rows.groupBy("list").count().collect()}
    cuts = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map(F.lit(0), F.lit(1))
    return rows.withColumn("c", F.pmod(F.xxhash64("id"), F.coalesce(cuts[F.col("list")], F.lit(1))).cast("int")), sizes


def _crossed(rows: DataFrame, other: dict[int, int], own: str, name: str) -> DataFrame:
    """Rows once for each chunk of the other side of their list."""
    several = {k: v for k, v in other.items() if v > 1}
    if not several:
        return rows.withColumn(name, F.lit(0)).withColumnRenamed("c", own)
    cuts = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(cuts[F.col("list")], F.lit(1)) - 1))).withColumnRenamed("c", own)


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", near: float = NEAR, copies: int = COPIES, ratio: float = RATIO, least: int = LEAST, most_lists: int = MOST_LISTS, chunk: int = CHUNK) -> DataFrame:
    """The k nearest other rows found for every query row, by Euclidean distance in double precision.

    ``is_query`` is a condition on ``vec_id``.  Returns query_id, rank (from 1), vec_id and score; equal
    distances are ranked by vec_id.  Defined results: vectors that are null, empty, zero, of another dimension
    than most or that hold null or non-finite components take no part, nor do rows with a null id; a row never
    is its own neighbour, nor is a repeated row of its id; repeated rows count once; with fewer than k candidates
    all are returned; an empty table gives no rows; further columns are not looked at.
    """
    rows, d, count = usable(vectors, key, vector)
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    spark = vectors.sparkSession
    if not count or rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = fit(rows, count, most_lists)
    graph, lists = spark.sparkContext.broadcast(fitted), len(fitted.centres)
    need = min(k, rows.select("vec_id").distinct().count() - 1)
    posted, posting_chunks = _chunked(durable(_routed(rows, graph, d, near, 1, min(copies, lists))), chunk)
    keys = ["list", "pc", "qc"]

    def group(q: pa.Table, p: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not q.num_rows or not p.num_rows:
            return none
        qi, pi = q.column("id").to_numpy(), p.column("id").to_numpy()
        first = np.unique(pi, return_index=True)[1]  # repeated rows count once, here already
        x, y, pi = matrix(q.column("v"), d), matrix(p.column("v"), d)[first], pi[first]
        out = []
        for s in range(0, len(x), 256):
            part = distances(x[s : s + 256], y)
            part[qi[s : s + 256, None] == pi[None]] = np.inf
            slack = 1e-9 * (1 + (x[s : s + 256] ** 2).sum(1) + (y**2).sum(1).max())
            edge = np.partition(part, k - 1, axis=1)[:, k - 1] if part.shape[1] > k else np.full(len(part), np.inf)
            a, b = np.nonzero((part <= (edge + slack)[:, None]) & np.isfinite(part))
            exact = np.sqrt(((x[s + a] - y[b]) ** 2).sum(1))
            order = np.lexsort((pi[b], exact, a))
            a, b, exact = a[order], b[order], exact[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            keep = place < k
            out.append((qi[s + a[keep]], pi[b[keep]], exact[keep]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    def answers(queries: DataFrame, ratio: float, least: int) -> DataFrame:
        asked, query_chunks = _chunked(durable(_routed(queries, graph, d, ratio, least)), chunk)
        left = _crossed(asked, posting_chunks, "qc", "pc")
        right = _crossed(posted, query_chunks, "pc", "qc")
        partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(group, "query_id long, vec_id long, score double")
        return durable(best(partial, k, F.col("score")))

    queries = rows.filter(is_query)
    found = answers(queries, ratio, least)
    for wider in ((ratio, WIDER * least), (math.inf, 1)):
        enough = found.groupBy("query_id").count().filter(F.col("count") >= need).select(F.col("query_id").alias("vec_id"))
        short = durable(queries.join(enough, "vec_id", "left_anti").select("vec_id", "v"))
        if need <= 0 or short.isEmpty():
            break
        again = answers(short, *wider)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
