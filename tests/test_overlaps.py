import pandas as pd

from ledgerline.plans import catalogue
from tests.oracle import normal

import duckdb

TEXTS = [
    "write to Mail1.EXAMPLE.com or mail2.example", "éThou Thou THOU Thou, thou tHou", "Thoú Th\u00f4u ThoùX _Thou", "caf\u0065\u0301 Thou", "cafe\u0301 only",
    "example.comail1.example", "mail3.exampleThou Thou", "example\uff0ecom Ｔhou mail\uff13.example", "①Thou …Thou ㎏Thou", "", None, "+12 345 678 901 Example.com", "TEXAMPLE.COM\nThou",
]


def test_overlaps_match_sql(spark, tmp_path):
    """Capitals, accents, composed and wide characters: the SQL states the rule on folded texts, null texts have no hits."""
    frame = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})
    spark.createDataFrame(frame, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.q45_redact_overlaps(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.SQL["q45_redact_overlaps"])
    names = [d[0] for d in want.description]
    assert normal(got.columns, [tuple(r) for r in got.collect()]) == normal(names, want.fetchall())
