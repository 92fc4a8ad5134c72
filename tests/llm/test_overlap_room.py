import random

import numpy as np
import pyarrow as pa

from ledgerline.llm import overlap


def _written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_rows_that_nothing_peels_take_little_room(spark):
    """Where every text has near copies, what all shuffles write stays in proportion to the texts: no sets of hashes among it."""
    drawn = random.Random(7)
    rows = []
    for k in range(120):
        words = ["".join(drawn.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1500)]
        rows += [(3 * k + c, " ".join([*words, f"copy{c}"])) for c in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    before = _written(spark)
    got = overlap.similarity_groups(df).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i - i % 3) for i, _ in rows}
    assert _written(spark) - before < 6 * sum(len(t) for _, t in rows)


def test_frequencies_are_those_of_all_rows(spark):
    """Rows with equal sets (one of them named by no id) count once; classes follow the columns' order, over several buckets and blocks."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:40]), " ".join(words[:40]).upper(), " ".join(words[20:]), "a b", None, "only these four words"]
    df = spark.createDataFrame([(k if k < 6 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = list(overlap.Grams(4).of(pa.array(texts)))
    once = [sets[k] for k in (0, 1, 3, 4, 6)]
    named = overlap._sid(once).tolist()
    ids = spark.createDataFrame([(0,), (1,), (3,), (4,), (None,)], "least long")
    for share, whole in ((1, True), (0.25, False)):
        found = {r["sid"]: r for r in overlap._frequencies(df, 4, overlap._filter(ids, 5), 200, share, whole).collect()}
        assert set(found) == set(named)
        seen = np.concatenate(once)
        for sid, h in zip(named, once, strict=True):
            often = [int((seen == x).sum()) for x in h if share == 1 or x < np.uint64(1 << 62)]
            assert found[sid]["own"] == often.count(1)
            assert found[sid]["classes"] == (bytes(n.bit_length() - 1 for n in often) if whole else None)


def test_blocks_and_buckets_may_be_small(spark, monkeypatch):
    """Many blocks a task and many buckets give the same frequencies as one of each."""
    drawn = random.Random(3)
    texts = [" ".join(drawn.choices("abcde", k=drawn.randint(1, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = overlap._documents(df, 4).select("sid", "n").distinct()

    def read():
        found = overlap._left(overlap._frequencies(df, 4, None, 2000, 1, True), rows, 0)
        return sorted((r["sid"], r["spare"], bytes(r["classes"])) for r in found.collect())

    want = read()
    monkeypatch.setattr(overlap, "BLOCK", 150)
    monkeypatch.setattr(overlap, "BUCKET", 64)
    assert read() == want and len(want) > 40


def test_whole_numbers_are_packed():
    for x in ([], [0, 0], [5, 300, 2**40], [2**64 - 1]):
        assert overlap._unpacked(overlap._packed(np.array(x, np.uint64))).tolist() == x
