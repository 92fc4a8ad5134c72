"""Near copies of the pipeline against all pairs of plain Python sets."""

import corpus_pipeline
import numpy as np
import pytest
from ledgerline.llm import shingles
from tests.llm.test_texts import SF, docs, real

ODD = [None, "", " \n", "one", "ONE", "a b c d e", "A  b\nc d e", "é " * 40]


def plain_set(text):
    words = (text or "").split()
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def variants(n=200, seed=5):
    """Texts with blocks of their words replaced, so that similarities lie on both sides of 0.8."""
    rng, out = np.random.default_rng(seed), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(n)]
        out.append(" ".join(base))
        for _ in range(5):
            own = list(base)
            for at in rng.choice(n - 1, rng.integers(1, 6), replace=False):
                own[at] = f"x{rng.integers(1 << 40)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("hashes", [shingles.SETS, 3000])
def test_near_copies_equal_all_pairs(spark, monkeypatch, hashes):
    monkeypatch.setattr(shingles, "SETS", hashes)  # the smaller one deals trees out as pairs of chunks
    texts = ODD + variants() + [r["text"] for r in real(spark).limit(60).collect()]
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == label
    assert shingles.near_copies(docs(spark, texts).limit(0)).count() == 0


def test_stage_drops_near_copies_far_apart_in_bits(spark):
    base = [f"w{i}" for i in range(200)]
    near = [f"z{i}" if i in (40, 90, 140) else w for i, w in enumerate(base)]
    far = [f"z{i}" if i % 10 == 0 else w for i, w in enumerate(base)]
    df = docs(spark, [" ".join(base), " ".join(near), " ".join(far)])
    kept = corpus_pipeline.near_dedup(spark, df.union(df.filter("doc_id = 2")), SF)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
