"""Searches against brute force, with nulls, ties, repeats and bad vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import ann, innerproduct

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def table(spark, n=400, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32).round(2)
    x[n // 2 : n // 2 + 40] = x[7]  # one very common vector
    rows = [(i, [float(v) for v in x[i]], "clash", "clash") for i in range(n)]
    bad = [(n, None, None, None), (n + 1, [float("nan")] * d, None, None), (n + 2, [float("inf")] + [0.0] * (d - 1), None, None), (n + 3, [None] * d, None, None), (n + 4, [1.0], None, None), (None, [1.0] * d, None, None), (n + 5, [], None, None)]
    again = rows[20:30]
    return spark.createDataFrame(rows + bad + again, SCHEMA).repartition(3), np.float64(x)


def brute(x, queries, k, score, best_first):
    out = {}
    for q in queries:
        s = score(x, x[q])
        order = sorted((best_first * s[i], i) for i in range(len(x)) if i != q)[:k]
        out[q] = [(i, best_first * v) for v, i in order]
    return out


@pytest.mark.parametrize("block,queries,head", [(4096, 2048, 2048), (64, 8, 30), (50, 100, 5)])
def test_top_k_is_exact(spark, block, queries, head):
    df, x = table(spark)
    q = np.floor(64 * x)
    got = {}
    for r in innerproduct.top_k(df, F.col("vec_id") % 20 == 0, 20, block=block, queries=queries, head=head).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(q, range(0, 400, 20), 20, lambda a, b: a @ b, -1)


def test_few_candidates_and_empty(spark):
    df, x = table(spark)
    few = df.filter("vec_id < 5")
    assert innerproduct.top_k(few, F.col("vec_id") == 0, 20).count() == 4
    assert ann.search(few, F.col("vec_id") == 0, 10).count() == 4
    none = df.filter("vec_id < 0")
    assert innerproduct.top_k(none, F.col("vec_id") == 0).count() == 0 == ann.search(none, F.col("vec_id") == 0).count()
    assert innerproduct.top_k(df, F.lit(False)).count() == 0


def test_ann_all_lists_equals_brute_force(spark):
    df, x = table(spark)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, 10, ratio=math.inf, chunk=32).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(x, range(0, 400, 100), 10, lambda a, b: np.sqrt(((a - b) ** 2).sum(1)), 1)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("sf,every", [("sf0.1", 5), ("sf0.01", 5), ("sf0.1", 100)])
def test_ann_recall(spark, sf, every):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found, hits, n = {}, 0, 0
    for r in ann.search(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), F.col("vec_id") % every == 0, 10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, got in found.items():
        s = ((x - x[ids == q]) ** 2).sum(1)
        s[ids == q] = np.inf
        hits += len(got & set(ids[np.lexsort((ids, s))[:10]].tolist()))
        n += 10
    assert n == 10 * (ids % every == 0).sum() and hits / n >= 0.9


def test_zero_vectors_take_no_part_in_ann(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") < 2, 5).collect()] == [(0, 2)]


def test_balanced_lists():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    centres = ann.balanced_centroids(x, 20)
    sizes = np.bincount(ann.distances(x, centres).argmin(1), minlength=20)
    assert sizes.max() < 3 * sizes.mean()


def test_graph_walk_finds_the_nearest():
    rng = np.random.default_rng(2)
    graph = ann.Graph(rng.normal(size=(300, 8)))
    x = rng.normal(size=(100, 8))
    lists, far = graph.nearest(x, 5)
    true = ann.distances(x, graph.centres).argsort(1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(lists, true, strict=True)]) > 0.9
    assert (np.diff(far, axis=1) >= 0).all()
