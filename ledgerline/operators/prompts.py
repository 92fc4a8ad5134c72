"""What language models are told, the schemas that their replies must match, and messages as columns.

The prompts are this engine's own; acts, handling and responses are those that the tables allow.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import segments
from ledgerline.operators.answers import DELIMITER

_WORD, _OPTIONAL = {"type": "string"}, {"type": ["string", "null"]}


def _object(**fields: dict) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def _list_of(item: dict) -> dict:
    return {"type": "array", "items": item}


EXTRACTION_SCHEMA = _object(
    statements=_list_of(_object(unit={"type": "integer"}, span=_WORD, claim=_WORD, act={"enum": list(schemas.ACTS)}, org=_OPTIONAL, role=_OPTIONAL, handling={"enum": list(schemas.HANDLING)}))
)
LINK_SCHEMA = _object(response={"enum": list(schemas.RESPONSES)}, by=_WORD, quote=_WORD)
ANNOTATION_SCHEMA = _object(
    annotations=_list_of(
        _object(segment_id=_WORD, speech_act={"enum": list(segments.ACTS)}, topics=_list_of(_WORD), people_mentioned=_list_of(_WORD), is_truncated={"type": "boolean"}, supersedes_segment_id=_OPTIONAL)
    )
)

EXTRACTION = f"""Task: list what people state in one document of a project archive.

You get a header and numbered units; a unit is what one speaker says in turn, or one message. Reply with JSON: an object
whose "statements" is a list, empty if nobody states anything. Fields of an entry:

unit - number of the unit it stands in.
span - its exact wording, copied from that unit letter by letter, cut off where the unit is cut off.
claim - one plain sentence with what is stated, made only of what the span says; say so if the span can't be understood.
act - {", ".join(schemas.ACTS)}. Floating or requesting something is a proposal, however firmly it is said. Use decision or
agreement only where the wording shows that the matter is closed or that another person's statement is accepted.
org, role - employer and position of the speaker if the header or a signature gives them, in its words; otherwise null.
handling - personal for private matters of a person's life, confidential for what is asked to be kept quiet or is
commercially delicate, otherwise none. Judge the statement that such a request is about, too.

Leave out greetings, small talk, scraps of sentences, echoes of the line before, placeholders for images or attachments,
signatures, footers and notices about the data. Rely on the document alone."""

LINK = """Task: find out how others took a statement.

You get one statement and what other people said afterwards, a line each: [speaker, place, date] words. Reply with a JSON
object: "response" is accepted if a later line plainly agrees, confirms or does it, rejected if one plainly refuses, none in
all other cases, which are most; "by" is that line's speaker as written; "quote" is the exact part of the line that shows
it. Both are empty strings for none. Rely on the lines alone."""

ANNOTATION = f"""Task: annotate segments of one document for a searchable archive.

You get JSON with the document, the topics in use and some segments. Reply with JSON: an object whose "annotations" holds one
entry for each segment. Fields: segment_id as given; speech_act, one of {", ".join(segments.ACTS)}; topics, a few short
tags-with-hyphens, taken from those in use where one fits; people_mentioned, names that occur in the text, without its
speaker; is_truncated, true only where the text breaks off inside a sentence or number; supersedes_segment_id, the segment of
this batch that the text says it corrects, otherwise null. Add nothing that isn't there and finish no broken sentence."""

ANSWER = f"""Task: answer a question from a record of statements, and from nothing else.

You get QUESTION and STATEMENTS_JSON, documents with their statements: id, claim, who said it for which organisation,
the kind of speech act, and dates. How to answer:

- If the record holds no answer, write: The record does not say.
- Something is agreed or decided only if a statement's speech_act is agreement or decision; a proposal binds nobody.
- Give people the organisation that the cited statement gives them.
- Where statements contradict each other, say so and cite them all, without choosing.
- Put a marker behind each fact: [1] for the first statement used, [2] for the next, the same number when it's used again.
- End with a line of its own: {DELIMITER} and then a JSON list of the statements' ids in the order of their markers, each
exactly as in the record; [] without markers."""


def messages(system: str, user: Column) -> Column:
    """The messages of one call as JSON text."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(say("system", F.lit(system)), say("user", user)))


def link_question(who: Column, stated_on: Column, span: Column, shown: Column) -> Column:
    """A statement and what came after it; ``shown``: array of structs later_who, later_position, later_stated_on, later_span, in order."""
    line = lambda x: F.concat(F.lit("["), F.concat_ws(", ", x["later_who"], x["later_position"], x["later_stated_on"]), F.lit("] "), x["later_span"])
    return F.concat(F.lit("STATEMENT of "), who, F.lit(" on "), F.coalesce(stated_on, F.lit("an unknown day")), F.lit(":\n"), span, F.lit("\n\nAFTERWARDS:\n"), F.array_join(F.transform(shown, line), "\n"))


def annotation_messages(document: dict, segments: list[dict], topics: list[str]) -> list[dict]:
    """The messages for one batch of segments."""
    view = {**document, "topics_in_use": topics, "segments": segments}
    return [{"role": "system", "content": ANNOTATION}, {"role": "user", "content": json.dumps(view, ensure_ascii=False, default=str)}]


def answer_messages(question: str, documents: list[str]) -> list[dict]:
    """The messages for one question over documents, each a JSON text."""
    return [{"role": "system", "content": ANSWER}, {"role": "user", "content": f"QUESTION:\n{question}\n\nSTATEMENTS_JSON:\n[{','.join(documents)}]"}]
