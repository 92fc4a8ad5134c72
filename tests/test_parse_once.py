"""Units take one pass over their documents' lines, and what is trimmed or folded stays what it was."""

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import links, units
from ledgerline.plans import archive, catalogue
from ledgerline.sources.corpus import lines_of
from tests.oracle import same
from tests.test_units import INSIDE, MAIL, TALK


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_split_documents_once_a_kind(spark, tmp_path):
    """Transcripts with names, those with labels and mails are split into lines once each; nothing is joined."""
    docs = [("a", "transcript", TALK), ("b", "transcript", INSIDE), ("c", "email", MAIL), ("d", "email", MAIL.replace("thread: 2", "thread: 3"))]
    spark.createDataFrame(docs, "doc_id string, doc_type string, text string").write.parquet(str(tmp_path / "docs"))
    lines = lines_of(spark.read.parquet(str(tmp_path / "docs")), "doc_id", "text", "doc_type")
    parsed = units.parse(lines, "This email originated from outside")
    plan = _plan(parsed.units)
    assert plan.count("Generate ") == 3 and "Join" not in plan
    stored = units.parse(lines, "This email originated from outside", keep=lambda df: df.localCheckpoint())
    assert "Generate " not in _plan(stored.units)
    for a, b in ((parsed.units, stored.units), (parsed.errors, stored.errors), (parsed.documents, stored.documents)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r["doc_id"] for r in stored.units.collect()} == {"a", "b", "c"}


def test_spaces_are_what_the_pattern_matches(spark):
    every = spark.range(1, 0x10000).filter("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert {r["c"] for r in every.filter(F.rlike("c", F.lit(f"^{X.SPACE}$"))).collect()} == set(X.SPACES)
    odd = spark.createDataFrame([("  a\x1c b　\n",), ("\xa0",), ("",), (None,), ("é \t",)], "s string")
    assert [r[0] for r in odd.select(X.strip(F.col("s"))).collect()] == ["a\x1c b", "", "", None, "é"]


def test_folding_keeps_letters_that_get_longer(spark):
    said = ["Straße und Öl", "ŉ plain", "plain É", "ΐ", "ASCII"]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(X.case_folded(F.col("s"))).collect()] == [s.casefold() for s in said]


def test_links_look_ahead_once(spark, sf_dir, monkeypatch):
    """Later statements are looked up once for a statement's outcome, source and number."""
    asked, look = [], links.later_by_others
    monkeypatch.setattr(links, "later_by_others", lambda *given: asked.append(1) or look(*given))
    df = archive.q48_agreement_links(spark, sf_dir)
    assert len(asked) == 1
    same(df, catalogue.SQL["q48_agreement_links"], sf_dir)
