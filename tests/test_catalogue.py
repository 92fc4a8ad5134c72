import pytest

from ledgerline.plans import archive, catalogue  # noqa: F401
from tests.oracle import same

SLOW = {"q19_evidence_topk"}


@pytest.mark.parametrize("name", sorted(set(catalogue.SQL) - SLOW))
def test_query_matches_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name], sf_dir)


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "id", "item_id", "first_line", "last_line"]
    assert df.count() == 3
