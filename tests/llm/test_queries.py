"""The contract queries: SQL where there is some, shape and held-out accuracy where there is none."""

import pytest

from ledgerline.llm import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = registry.op2_quality(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    scored = out.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert scored.filter("predicted = quality").count() >= 0.95 * scored.count()


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] > 0
    assert docs.filter("text rlike '[a-z]+[.][0-9]+@mail[0-9][.]example[.]com'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[4] and last.filter("n_tokens is null").count() == 0
