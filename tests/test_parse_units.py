"""The table functions give what ``units.parse`` gives, on sound, broken and odd documents."""

import pytest

from ledgerline.operators import parse_units, units
from ledgerline.sources.corpus import lines_of
from tests.test_units import INSIDE, MAIL, TALK

BANNER = "This email originated from outside"
DOCS = [
    ("talk", "transcript", TALK),
    ("own", "transcript", INSIDE),
    ("mail", "email", MAIL),
    ("report", "report", MAIL.replace("5. März 2025", "5 Mars 2025")),
    ("count", "email", MAIL.replace("thread: 2", "thread: 3")),
    ("date", "email", MAIL.replace("5. März 2025", "some day")),
    ("31st", "email", MAIL.replace("March 4, 2025", "February 31, 2025")),
    ("no-sent", "email", MAIL.replace("Gesendet: ", "")),
    ("no-end", "email", MAIL.replace("Betreff: Launch", "")),
    ("no-from", "email", "hello\nworld"),
    ("preamble", "email", "Messages in thread: 2\nFrom: nobody\n" + MAIL),
    ("bare", "email", "From:  A B \nSent: 3 maj 2025\nMessages in thread: 1\n"),
    ("fourth", "transcript", TALK.replace("Per Holm 1 minute 10 seconds", "Somebody 3 seconds")),
    ("cut", "transcript", TALK.split("Guest 1 2")[0].rstrip("\n")),
    ("early", "transcript", TALK.replace("late)\n\n", "late)\n\nearly words\n")),
    ("again", "transcript", TALK.replace("Per Holm 1 minute 31 seconds\nor", "Per Holm\n1:311:31\nPH\nPer Holm 1 minute 31 seconds\nor")),
    ("twice", "transcript", TALK.replace("0:050:05", "0:050:05\n0:050:05")),
    ("silent", "transcript", TALK.replace("Per Holm 1 minute 31 seconds", "Ada Berg 1 minute 20 seconds\nPer Holm 1 minute 31 seconds")),
    ("odd-ends", "transcript", TALK.replace("We should", " We\rshould now　\x1c\x1d")),
    ("no-header", "transcript", "Meeting: x\n"),
    ("no-date", "transcript", INSIDE.replace("Date: 2025-03-05\n", "")),
    ("no-body", "transcript", "Date: 2025-03-05\nAttendees: A\n\n  \n"),
    ("own-early", "transcript", INSIDE.replace("Me: first", "Me:first\rx")),
    ("own-empty", "transcript", INSIDE.replace("Them: third", "Them:")),
    ("other", "picture", TALK),
    ("untyped", None, TALK),
    ("empty", "email", ""),
    ("null", "email", None),
]
SCHEMA = "doc_id string, doc_type string, text string"


def _found(df):
    return sorted((r["doc_id"], r["unit_no"] or 0, r["name"] or "", r["label"] or "", str(r["sent"]), str(r["lines"]), r["error"] or "") for r in df.select("doc_id", *parse_units.COLUMNS).collect())


@pytest.fixture(scope="module")
def tables(spark):
    documents = spark.createDataFrame(DOCS, SCHEMA)
    lines = lines_of(documents, "doc_id", "text", "doc_type")
    parsed = units.parse(lines, BANNER)
    expected = _found(parsed.units.selectExpr("*", "null as error").unionByName(parsed.errors.withColumnRenamed("message", "error"), allowMissingColumns=True))
    return documents, lines, expected


def test_whole_texts_equal_parse(tables):
    documents, _, expected = tables
    assert len({row[0] for row in expected if not row[6]}) > 8 and len({row[0] for row in expected if row[6]}) > 8
    assert _found(parse_units.of_texts(documents, BANNER)) == expected


def test_lines_equal_parse(tables):
    _, lines, expected = tables
    assert _found(parse_units.of_lines(lines.repartition(3), BANNER)) == expected


def test_sql(spark, tables):
    documents, lines, expected = tables
    parse_units.register(spark)
    got = spark.sql("SELECT * FROM parse_unit_lines(TABLE(SELECT doc_id, doc_type, line_no, text FROM {lines}) PARTITION BY doc_id ORDER BY (line_no), {banner})", lines=lines, banner=BANNER)
    assert _found(got) == expected
    own = spark.sql("SELECT d.doc_id, u.* FROM {docs} d, LATERAL parse_units(d.text, d.doc_type) u WHERE d.doc_type = 'transcript'", docs=documents)
    kinds = {name: kind for name, kind, _ in DOCS}
    assert _found(own) == [row for row in expected if kinds[row[0]] == "transcript"]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert parse_units.of_texts(none).count() == 0 == parse_units.of_lines(lines_of(none, "doc_id", "text", "doc_type")).count()
