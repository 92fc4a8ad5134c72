"""Operators 11 to 13: brute force on random and odd tables, large blocks in chunks, deep and hot conversations."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import balls, overlap, trie

CLASHES = ["sid", "root", "key", "values", "v", "cluster", "pos", "n", "t", "a.b", "CONV_ID_"]


def with_clashes(spark, rows, schema):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema + "".join(f", `{c}` string" for c in CLASHES))


# -- 11 ----------------------------------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([b" ".join(words)] if 0 < len(words) < 4 else [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)])


def groups_by_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=key)


def key(row):
    return [(-1 if x is None else x) for x in row]


def drifting(seed, n, length):
    """Texts that drift away from each other by a word or two, with common lines and families."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(5000)]
    line = " ".join(rng.choice(words, 30))
    out, text = [], list(rng.choice(words, length))
    for i in range(n):
        if i % 40 == 0:
            text = list(rng.choice(words, int(rng.integers(5, length))))
        text[int(rng.integers(len(text)))] = str(rng.choice(words))
        out.append((i, " ".join(text) + (" " + line if i % 3 == 0 else "")))
    return out


ODD = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d e"), (None, "a b c d e"), (None, None), (None, "z y x"), (7, "q r s t u v w"), (7, "a\tb"), (8, " \n"), (5, "a b c d e")]


def test_overlap_on_odd_rows(spark):
    df = with_clashes(spark, ODD, "doc_id long, text string")
    got = sorted(map(tuple, overlap.similarity_groups(df).collect()), key=key)
    assert got == groups_by_force(ODD)
    assert overlap.similarity_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [overlap.SETS, 4000])
def test_overlap_equals_brute_force(spark, most):
    """Small chunks make every block one of many chunks with hubs and minor parts."""
    rows = drifting(5, 400, 90)
    got = sorted(tuple(r) for r in overlap.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), most=most).collect())
    assert got == groups_by_force(rows)


def test_overlap_of_a_very_long_text(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(200_000))
    rows = [(1, long), (2, long + " more words at the end"), (3, "w1 w4 w9 w16")]
    assert sorted((r[0], r[2]) for r in overlap.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 1), (2, 1), (3, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=1, max_size=12), st.integers(40, 100), st.booleans(), st.booleans())
def test_product_connects_what_links_connect(sets, percent, sided, rooted):
    rows = [np.array(sorted(s), np.uint64) for s in sets]
    side = np.array([1 + i % 2 for i in range(len(sets))]) if sided else None
    root = np.array([i // 3 for i in range(len(sets))]) if rooted else None
    links = lambda i, j: 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and (not sided or i % 2 != j % 2)

    def parts(pairs):
        label = list(range(len(sets)))
        for i, j in [*pairs, *([(i, i // 3 * 3) for i in range(len(sets))] if rooted else [])]:
            label = [label[i] if x == label[j] else x for x in label]
        return [label.index(x) for x in label]

    found = overlap.product(rows, percent, side, root)
    assert all(links(i, j) for i, j in found)
    assert parts(found) == parts([(i, j) for i in range(len(sets)) for j in range(i) if links(i, j)])


def test_grams_are_those_of_the_words():
    import pyarrow as pa

    texts = [None, "", " ", "a b c", "A B c d", "a b c d e", "x" * 70 + " b\tc\u00a0d e " + "y" * 70, "\u00e9 \U0001f600 a b c d", "a b c d a b c d", " ".join(f"w{k}" for k in range(90_000)), "z" * 600_000 + " a b c"]
    found = list(overlap.Grams(4).of(pa.array(["junk", *texts]).slice(1)))
    assert [len(h) for h in found] == [len(shingle_set(t)) for t in texts]
    for t, h in zip(texts, found, strict=True):
        assert (next(overlap.Grams(4).of(pa.array([t]))) == h).all() and (h[1:] > h[:-1]).all()
    both = set(found[4].tolist()) & set(found[5].tolist()) & set(found[8].tolist())
    assert len(both) == 1 and not set(found[3].tolist()) & both


def test_chains_go_over_batches_and_sizes():
    import pyarrow as pa

    keys, sizes = [1, 1, 1, 2, 2], [100, 110, 200, 100, 90]
    batch = overlap._combined(np.array(keys), np.array(sizes), np.array(sizes), np.arange(5), 85, False)
    rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
    assert [r for r in rows if r[2] != overlap.CHAIN] == [(1, 100, 110, 0), (1, 200, 200, 2), (2, 90, 100, 4)]
    assert {(r[1], r[3]) for r in rows if r[2] == overlap.CHAIN} == {(0, 1), (4, 3)}
    assert isinstance(batch, pa.RecordBatch)


# -- 12 ----------------------------------------------------------------------------------------------


def means_by_force(rows, k=8, rounds=10, d=64, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, near(v), gap(v, centres[near(v)])) for i, v in kept]
    inside = {c: sum(x[2] for x in out if x[1] == c) for c in range(len(centres))}
    return sorted((*x, inside[x[1]], sum(inside.values()), hashlib.sha256(",".join(map(str, centres[x[1]])).encode()).hexdigest()) for x in out)


@pytest.mark.parametrize("n,d,scale,spread", [(300, 64, 1024, 1.0), (5, 64, 1024, 1.0), (200, 3, 2, 1.0), (400, 2, 10, 5.0)])
def test_balls_equal_plain_k_means(spark, n, d, scale, spread):
    """Few small integers make ties, equal vectors and empty clusters."""
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=d) + spread * (i % 9) / 3).tolist()) for i in range(n)]
    df = with_clashes(spark, rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(map(tuple, balls.cluster(df, components=d, scale=scale).collect()))
    assert got == means_by_force(rows, d=d, scale=scale)


def test_balls_on_odd_rows(spark):
    v, nan = [0.5] * 64, [float("nan")] + [1.0] * 63
    rows = [(1, v), (1, v), (2, None), (3, [1.0]), (4, nan), (5, [None] + [1.0] * 63), (6, [1e30] * 64), (7, [-0.0001] * 64), (8, [float("inf")] * 64)]
    got = sorted(tuple(r) for r in balls.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == means_by_force([r for r in rows if r[0] != 6])
    assert balls.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").limit(0)).count() == 0
    assert [r["cluster"] for r in balls.cluster(spark.createDataFrame([(None, v)], "vec_id long, embedding array<float>")).collect()] == [0]


def test_balls_leave_the_core_alone():
    """Settled clusters that are far apart compute one distance a vector."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(0, 10, (500, 8)) + 1000 * k for k in range(6)])
    centres, own = np.stack([rows[500 * k] for k in range(6)]), np.repeat(np.arange(6), 500)
    again, best, work = balls.Balls(centres, np.full(6, 40.0)).assign(rows, own)
    assert (again == own).all() and work == len(rows) and best.max() <= 8 * 81


# -- 13 ----------------------------------------------------------------------------------------------


def trie_by_force(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        new = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(new) + 1):
            members.setdefault(tuple(new[:d]), []).append(c)
        ends.setdefault(tuple(new), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids.get(p, [])]
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below))
    return sorted(((*v, hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, v in out.items()), key=str)


def trie_of(df):
    return sorted(map(tuple, trie.rollup(*trie.rebuilt(trie.numbered(df))).drop("key").collect()), key=str)


def test_trie_on_odd_rows(spark):
    rows = [(c, t, ["user", None, ""][(c + t) % 3], ["x", "é\U0001f600", None, "x"][(c * t) % 4]) for c in [0, 1, 2, 3, 100, 101, 205, 207, -5] for t in range(c % 7)]
    rows += [(2, None, "user", "first"), (2, 1, "user", "x"), (2, 1, "user", "x"), (None, 1, "user", "x"), (300, 5, "a", "b"), (301, 2, "a", "b"), (302, 2, "", "")]
    df = with_clashes(spark, rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert trie_of(df) == trie_by_force(rows)
    assert trie_of(df.limit(0)) == []


def test_trie_of_deep_and_hot_conversations(spark, monkeypatch):
    """One conversation holds a third of all turns; buckets are far smaller than it; many conversations are copies."""
    monkeypatch.setattr(trie, "BUCKET", 16)
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(0, t, "user", f"t{t}") for t in range(700)] + [(100 * k, t, "user", f"t{t}" if t < 300 + k else f"u{k}") for k in range(1, 3) for t in range(400)]
    rows += [(1000 + k, t, "user", "hello" * (t + 1)) for k in range(150) for t in range(2)]
    assert trie_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)) == trie_by_force(rows)
