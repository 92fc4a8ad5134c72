"""Queries whose near lists hold too few answers, above and below the size at which every list used to be read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import ann


@pytest.mark.parametrize("n", [400, 2000])
def test_far_vectors_get_all_their_answers(spark, n):
    x = np.random.default_rng(6).normal(size=(n, 8))
    x[:10] *= 20
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") < 20, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got) == list(range(20)) and all(sorted(a for a, _ in v) == list(range(1, 11)) and len({b for _, b in v} - {q}) == 10 for q, v in got.items())
    near = np.argsort(ann.distances(x[10:20], x), axis=1)[:, 1:11]
    assert np.mean([len({b for _, b in got[10 + i]} & set(near[i].tolist())) for i in range(10)]) >= 8


def test_one_rule_at_every_size(spark, monkeypatch):
    rules = []
    routed = ann._routed
    monkeypatch.setattr(ann, "_routed", lambda *a: (rules.append(a[3:]), routed(*a))[1])
    for n in (400, 2000):
        x = np.random.default_rng(7).normal(size=(n, 8))
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        assert ann.search(df, F.col("vec_id") < 5, 10).count() == 50
    assert rules == [(ann.NEAR, 1, ann.COPIES), (ann.RATIO, ann.LEAST)] * 2


def test_ratio_decides_which_lists_are_read():
    rng = np.random.default_rng(3)
    graph = ann.Graph(rng.normal(size=(600, 6)))
    x = rng.normal(size=(50, 6))
    far = np.sqrt(ann.distances(x, graph.centres))
    row, lists = graph.within(x, 0.5, 4)
    got = {(int(a), int(b)) for a, b in zip(row, lists, strict=True)}
    want = {(i, int(j)) for i in range(50) for j in np.flatnonzero((far[i] <= 1.5 * far[i].min()) | (far[i].argsort().argsort() < 4))}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert len(graph.within(x, np.inf, 1)[0]) == 50 * 600 and len(graph.within(x[:0], 0.5, 4)[0]) == 0
