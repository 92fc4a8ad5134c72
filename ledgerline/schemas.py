"""Schemas of the tables and of the statements file."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "double": T.DoubleType()}


def _parts(text: str) -> list[str]:
    """Parts between commas that aren't inside angle brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def _type(text: str) -> T.DataType:
    kind, _, inner = text.strip().partition("<")
    if not inner:
        return _SIMPLE[kind]
    inner = inner[:-1]
    if kind == "array":
        return T.ArrayType(_type(inner))
    if kind == "map":
        return T.MapType(*map(_type, _parts(inner)))
    return T.StructType([T.StructField(n.strip(), _type(t)) for n, _, t in (p.partition(":") for p in _parts(inner))])


def _schema(ddl: str) -> T.StructType:
    """A schema from its text, without a session (Spark's own parser needs one)."""
    return T.StructType([T.StructField(n, _type(t)) for n, _, t in (p.partition(" ") for p in _parts(ddl))])


ACTS = ("proposal", "agreement", "decision", "report", "question", "objection")
HANDLING = ("none", "personal", "confidential")
RESPONSES = ("accepted", "rejected", "none")
DOC_TYPES = ("transcript", "email", "report")

LINE = "struct<no:int,text:string,position:string>"
ACTOR = "struct<name:string,label:string,org:string,role:string>"

LINES = _schema("doc_id string, doc_type string, line_no int, text string")
UNITS = _schema(f"doc_id string, unit_no int, name string, label string, sent date, lines array<{LINE}>")
DOCUMENTS = _schema("doc_id string, doc_type string, doc_date string, summary string, meta map<string,string>, attendees map<string,string>")
CANDIDATES = _schema("doc_id string, model_seq int, unit int, span string, claim string, act string, org string, role string, handling string")
RECORDS = _schema(
    f"id string, doc_id string, doc_type string, doc_date string, stated_on string, position string, first_line int, last_line int, span string, "
    f"claim string, act string, handling string, actor {ACTOR}, agreed_by array<struct<name:string,label:string,org:string,role:string,statement:string>>"
)
REPLIES = _schema("doc_id string, statement_id string, response string, by string, quote string")

STATEMENT = "struct<claim:string,speech_act:string,actor:struct<name:string,organization:string>,statement_date:string>"
STATEMENTS_FILE = _schema(f"documents array<struct<id:string,type:string,date:string,people:array<string>,summary:string,statements:array<{STATEMENT}>>>")

PERSON = _schema("canonical_id string, name string, org string, title string, emails array<string>")
SEGMENTS = _schema(
    "doc_id string, segment_id string, position struct<type:string,index:int,timestamp:string,line_range:array<int>>, speaker_or_author string, speaker_org string, "
    "speaker_resolved boolean, recipients array<struct<name:string,email:string,resolved:boolean>>, effective_date string, text string, subject string, contains_image_placeholder boolean"
)
ANNOTATIONS = _schema("segment_id string, speech_act string, topics array<string>, people_mentioned array<string>, is_truncated boolean, supersedes_segment_id string")
