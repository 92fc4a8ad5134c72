"""Facts of documents are put together where their lines lie."""

import random
import re

from pyspark.sql import functions as F

from ledgerline.operators import segments
from ledgerline.plans import archive
from ledgerline.sources.corpus import lines_of
from tests.test_units import registry

ODD = [
    "From: Ada Berg <ada@x.com>", "From: Per", "From:  <a@b>", "From: no", "From: Bo Ek <bo@x.com>; C", " From: Late <l@x.com>", "Subject: hi", "Subject:", "Date: Monday, March 4, 2025 10:00 AM", "Sent: March 5, 2025 23:10",
    "Date: junk", "To: Per; Ada Berg <ADA@x.com>", "To:", "Cc: Z <z@z>;; ;Q", "Messages in thread: 3", "Messages in thread: x", "", "", " ", "BANNER", "hello there", "  body text ", "[cid:1] x", "Image", "Thanks,", "best regards", "ada berg", "PER",
]


def _shuffled_by(df):
    return set(re.findall(r"Exchange hashpartitioning\((\w+?)#", df._jdf.queryExecution().executedPlan().toString()))


def test_lines_of_documents_are_not_shuffled(spark, sf_dir):
    """Orders and turns are dealt out once by the document that they become; what the lines are made into stays there."""
    assert _shuffled_by(archive.q51_document_meta(spark, sf_dir)) <= {"conv_id", "o_custkey", "_groupingexpression"}


def test_messages_are_put_together_without_joins(spark):
    rows = spark.createDataFrame([("a", "From: A\n\nx")], "doc_id string, text string").repartition(3, "doc_id")
    found = segments.messages(lines_of(rows), "BANNER")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert [(r["index"], r["fields"], r["text"]) for r in found.collect()] == [(0, {"from": "A"}, "x")]


def test_a_sender_below_the_header_closes_nothing(spark):
    """What comes before the first From is of its message: there the header may have ended, so that the sender isn't known."""
    rows = spark.createDataFrame([("a", "Subject: s\n\nFrom: Per\nPer\nmore"), ("b", "From: Per\n\nfirst\nPER\nmore"), ("c", "Subject: no mail\n\ntext")], "doc_id string, text string")
    got = {r["doc_id"]: (r["fields"], r["first_line"], r["last_line"], r["text"]) for r in segments.messages(lines_of(rows)).collect()}
    assert got == {"a": ({"subject": "s"}, 1, 5, "From: Per Per more"), "b": ({"from": "Per"}, 1, 5, "first")}


def test_facts_are_those_of_the_segments(spark):
    drawn = random.Random(5)
    mails = [(f"d{i}", "email", "\n".join(drawn.choices(ODD, k=drawn.randint(1, 40)))) for i in range(250)]
    heads = ["Meeting: M", "Date: 2025-01-01", "Attendees: Ada Berg (x, y), Per", "", "Ada Berg 1 minute 1 second", "Per 2 minutes", "words", "Phase: p"]
    talks = [(f"INTERNAL{i}" if i % 5 else f"t{i}", "transcript", "\n".join(drawn.choices(heads, k=drawn.randint(1, 30)))) for i in range(60)]
    lines = lines_of(spark.createDataFrame(mails + talks, "doc_id string, doc_type string, text string").localCheckpoint(), "doc_id", "text", "doc_type")
    people = registry(spark)
    want = segments.document_meta(lines, segments.parse(lines, people, "BANNER"))
    got = segments.document_facts(lines.filter(F.col("doc_type") == "transcript"), lines.filter(F.col("doc_type") == "email"), people, "BANNER")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
