import pytest

from ledgerline.operators import segments, units
from ledgerline.sources.corpus import lines_of

TALK = """*** banner line
Meeting: Planning
Customer: Example Co
Date: 2025-03-04
Phase: Build
Attendees: Ada Berg (Example Co), Per Holm (Vendor, joins late)

Ada Berg
0:050:05
AB
Ada Berg 5 seconds
We should move the launch to May.
Per Holm
1:101:10
PH
Per Holm 1 minute 10 seconds
I can have it ready in 30 seconds
Per Holm 1 minute 31 seconds
or a bit more.
Guest 1
2:002:00
G1
Guest 1 2 minutes
Costs were roughly 3
"""
INSIDE = """Meeting: Catch-up
Date: 2025-03-05
Attendees: Ada Berg

Me: first
Me: second
goes on
Them: third
Me: fourth
"""
MAIL = """Subject: AW: Launch
From: Per Holm <per@vendor.example>
Sent: Mittwoch, 5. März 2025 09:00
To: Ada Berg <ada@example.com>; Nobody
Messages in thread: 2

This email originated from outside the company
Fine with me.
Best regards,
Per Holm
Von: Ada Berg <ada@example.com>
Gesendet: Tuesday, March 4, 2025 10:15 AM
Betreff: Launch

Shall we move it?
[Image removed by sender]
"""


def parsed(spark, *docs):
    df = spark.createDataFrame(list(docs), "doc_id string, doc_type string, text string")
    return units.parse(lines_of(df, "doc_id", "text", "doc_type"), "This email originated from outside")


def rows(df):
    return [(r["unit_no"], r["name"], r["label"], [(x["no"], x["text"], x["position"]) for x in r["lines"]]) for r in df.orderBy("doc_id", "unit_no").collect()]


def test_teams_transcript(spark):
    p = parsed(spark, ("transcripts/a", "transcript", TALK)).strict()
    assert rows(p.units) == [
        (1, "Ada Berg", None, [(12, "We should move the launch to May.", "5 seconds")]),
        (2, "Per Holm", None, [(17, "I can have it ready in 30 seconds", "1 minute 10 seconds"), (19, "or a bit more.", "1 minute 31 seconds")]),
        (3, None, "Guest 1", [(24, "Costs were roughly 3", "2 minutes")]),
    ]
    d = p.documents.first()
    assert (d["doc_date"], d["summary"]) == ("2025-03-04", "Planning")
    assert d["attendees"] == {"Ada Berg": "Example Co", "Per Holm": "Vendor, joins late"}
    assert d["meta"]["Phase"] == "Build"


def test_full_header_of_same_speaker_begins_a_turn(spark):
    text = TALK.replace("Per Holm 1 minute 31 seconds\nor", "Per Holm\n1:311:31\nPH\nPer Holm 1 minute 31 seconds\nor")
    assert [u[1] for u in rows(parsed(spark, ("t", "transcript", text)).units)] == ["Ada Berg", "Per Holm", "Per Holm", None]


def test_internal_transcript(spark):
    p = parsed(spark, ("t", "transcript", INSIDE)).strict()
    assert rows(p.units) == [(1, None, "Me", [(5, "first", "line 5"), (6, "second", "line 6"), (7, "goes on", "line 7")]), (2, None, "Them", [(8, "third", "line 8")]), (3, None, "Me", [(9, "fourth", "line 9")])]


def test_thread(spark):
    p = parsed(spark, ("emails/x", "email", MAIL)).strict()
    got = rows(p.units)
    assert got[0][:3] == (1, "Per Holm", None)
    assert got[0][3] == [(8, "Fine with me.", "message 1 of 2"), (9, "Best regards,", "message 1 of 2"), (10, "Per Holm", "message 1 of 2")]
    assert got[1][3] == [(15, "Shall we move it?", "message 2 of 2"), (16, "[Image removed by sender]", "message 2 of 2")]
    assert [str(r["sent"]) for r in p.units.orderBy("unit_no").collect()] == ["2025-03-05", "2025-03-04"]
    d = p.documents.first()
    assert (d["summary"], d["doc_date"], d["attendees"]) == ("AW: Launch", "2025-03-05", {"Per Holm": "", "Ada Berg": ""})
    assert units.newest_first(p.units).first()["ok"] is True


@pytest.mark.parametrize(
    "kind,text,message",
    [
        ("email", MAIL.replace("thread: 2", "thread: 3"), "header says 3 messages, found 2"),
        ("email", MAIL.replace("5. März 2025", "some day"), "unrecognised date: Mittwoch, some day 09:00"),
        ("transcript", TALK.replace("Per Holm 1 minute 10 seconds", "Somebody 3 seconds"), "line 16: expected 'Per Holm <elapsed>', got 'Somebody 3 seconds'"),
        ("transcript", TALK.replace("late)\n\n", "late)\n\nearly words\n"), "line 8: text before the first speaker"),
        ("transcript", "Meeting: x\n", "no Attendees line in the transcript header"),
        ("transcript", INSIDE.replace("Date: 2025-03-05\n", ""), "no Date line in the transcript header"),
    ],
)
def test_errors_are_quarantined(spark, kind, text, message):
    p = parsed(spark, ("bad", kind, text), ("good", "transcript", INSIDE))
    assert [tuple(r) for r in p.errors.distinct().collect()] == [("bad", message)]
    assert {r["doc_id"] for r in p.units.collect()} == {"good"} == {r["doc_id"] for r in p.documents.collect()}
    with pytest.raises(ValueError, match="bad: "):
        p.strict()


def test_line_numbers_point_at_their_lines(spark):
    text = TALK.split("\n")
    for _, _, _, lines in rows(parsed(spark, ("t", "transcript", TALK)).units):
        assert all(text[no - 1].strip() == s for no, s, _ in lines)


def test_speakers_not_listed(spark):
    p = parsed(spark, ("t", "transcript", TALK.replace("Per Holm (", "P Holm (")))
    assert [tuple(r) for r in units.speakers_not_listed(p.units, p.documents).collect()] == [("t", "Per Holm")]


def test_rendered(spark):
    p = parsed(spark, ("t", "transcript", INSIDE))
    prompt = units.rendered(p.units, p.documents).first()["prompt"]
    assert prompt.startswith("Document: t\nKind: transcript\nDate: 2025-03-05\nSummary: Catch-up\nAttendees: Ada Berg\n\n[1] Me (name not recorded) - line 5\nfirst\nsecond\ngoes on\n\n[2] Them")


def registry(spark):
    return spark.createDataFrame([("p1", "Ada Berg", "Example Co", None, ["ada@example.com"]), ("p2", "Per Holm", "Vendor", "PM", [])], "canonical_id string, name string, org string, title string, emails array<string>")


def lines(spark, *docs):
    return lines_of(spark.createDataFrame(list(docs), "doc_id string, doc_type string, text string"), "doc_id", "text", "doc_type")


def test_utterances(spark):
    got = [tuple(r) for r in segments.utterances(lines(spark, ("t", "transcript", TALK))).orderBy("index").select("index", "speaker", "timestamp", "first_line", "last_line", "text").collect()]
    assert got == [(0, "Per Holm", "1:10", 17, 17, "I can have it ready in 30 seconds"), (1, "Per Holm", "1:31", 19, 19, "or a bit more."), (2, "Guest 1", "2:00", 24, 25, "Costs were roughly 3")]


def test_email_segments(spark):
    text = MAIL.replace("Von:", "From:").replace("Gesendet:", "Sent:").replace("Betreff:", "Subject:")
    got = segments.email_segments(lines(spark, ("e", "email", text)), registry(spark), banner="This email originated from outside the company").orderBy("segment_id").collect()
    assert [(r["segment_id"], r["speaker_or_author"], r["speaker_org"], r["speaker_resolved"], r["text"], r["effective_date"], r["contains_image_placeholder"]) for r in got] == [
        ("e#m0000", "Per Holm", "Vendor", True, "Fine with me.", None, False),
        ("e#m0001", "Ada Berg", "Example Co", True, "Shall we move it?", "2025-03-04", True),
    ]
    assert [(x["name"], x["resolved"]) for x in got[0]["recipients"]] == [("Ada Berg", True), ("Nobody", False)]


def test_annotation(spark):
    segs = segments.parse(lines(spark, ("t", "transcript", TALK)), registry(spark))
    seen = []

    def model(shown, topics):
        seen.append(topics)
        return [{"segment_id": shown[0]["segment_id"], "speech_act": "report", "topics": ["b", "a"], "people_mentioned": [], "is_truncated": False, "supersedes_segment_id": None}]

    out, topics = segments.annotate(segs, model, {"z"}, size=2)
    assert seen == [["z"], ["a", "b", "z"]] and topics == {"a", "b", "z"} and len(out) == 2
    from ledgerline.schemas import ANNOTATIONS

    ann = spark.createDataFrame([tuple(o[n] for n in ANNOTATIONS.fieldNames()) for o in out], ANNOTATIONS)
    acts = [r["speech_act"] for r in segments.annotated(segs, ann).orderBy("segment_id").collect()]
    assert acts == ["report", "other", "report"]
    assert segments.vocabulary_of(ann).first()["topics"] == ["a", "b"]


def test_document_meta(spark):
    ls = lines(spark, ("INTERNAL-t", "transcript", TALK))
    meta = segments.document_meta(ls, segments.parse(ls, registry(spark))).first()
    assert (meta["title"], meta["is_internal"], meta["parsed"], meta["phase"]) == ("Planning", True, 3, "Build")


def test_reports_are_refused(spark):
    with pytest.raises(NotImplementedError):
        segments.parse(lines(spark, ("r", "report", MAIL)), registry(spark))
