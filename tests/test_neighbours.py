import time

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.plans import catalogue
from tests.oracle import same

ODD = ["Ada Berg said: Per  Holm\nis here", "one", "", None, "a1 b c_d e f2 g h", "\u00c5sa \u00d6berg\u2122 Foo\u037a Bar", "x\u0301 y\u0308z \u4e2d\u6587 \uac00\ub098 end", "A B A B A", "(Ada Berg) Ada-Berg Cy", "e\u00a0f\x1cg h"]


def test_neighbours_are_the_pairs_of_the_pattern(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    pairs = F.arrays_zip(*[F.regexp_extract_all("t", F.lit(X.NAME_PAIR), F.lit(k)).alias(n) for k, n in ((1, "a"), (2, "b"))])
    rows = df.select(X.neighbours(F.col("t")).alias("got"), F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])).alias("all")).collect()
    for row in rows:
        assert row["got"] == (row["all"] and list(dict.fromkeys(row["all"]))) or row["got"] == row["all"]


def test_folds_without_and_with_table_agree(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for row in df.select("t", X.fold(F.col("t")).alias("f"), X.case_folded(F.col("t")).alias("c"), F.translate("t", *X.fold_table()).alias("whole")).collect():
        assert row["f"] == row["whole"] and row["c"] == (row["t"] and row["t"].casefold()) or not row["t"]


def test_neighbours_of_a_long_text_take_linear_time(spark):
    """Structs were compared each with each: 40,000 different pairs took minutes."""
    letters = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    df = spark.createDataFrame([(" ".join(letters(n) for n in range(40_000)),)], "t string")
    began = time.monotonic()
    assert df.select(F.size(X.neighbours(F.col("t")))).first()[0] == 39_999
    assert time.monotonic() - began < 20


def test_evidence_matches_sql_with_few_and_many_keys(spark, sf_dir, monkeypatch):
    for few in (catalogue.FEW_KEYS, 0):
        monkeypatch.setattr(catalogue, "FEW_KEYS", few)
        same(catalogue.q19_evidence_topk(spark, sf_dir), catalogue.SQL["q19_evidence_topk"], sf_dir)
