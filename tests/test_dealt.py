import re

from ledgerline.plans import archive, catalogue  # noqa: F401


def _exchanges(df):
    """Plans of a query's shuffles."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_replies_are_shuffled_once(spark, sf_dir):
    df = catalogue.q38_holdback_stream(spark, sf_dir)
    assert len(_exchanges(df)) == 1


def test_threads_are_dealt_out_by_size(spark, sf_dir, monkeypatch):
    """Orders are shuffled once for windows, threads and lines, to as many tasks as their text asks for."""
    monkeypatch.setattr(catalogue, "PIECE", 10_000)
    lines = catalogue._as_lines(catalogue._threads(spark, sf_dir), "o_custkey", "email")
    assert [int(n) for _, n in _exchanges(lines)] == [45]
    talks = catalogue._as_lines(catalogue._talks(spark, sf_dir), "conv_id", "transcript")
    assert max(int(n) for _, n in _exchanges(talks)) > 4
