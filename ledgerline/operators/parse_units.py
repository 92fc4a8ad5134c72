"""Units of documents as table functions for SQL: the compact way beside ``units.parse``.

``parse_units(text, doc_type, banner)`` reads a whole document given as one value, so a lateral join needs no shuffle.
``parse_unit_lines(TABLE(lines) PARTITION BY doc_id ORDER BY (line_no), banner)`` reads documents that lie in rows.  Both
give the rows that ``units.parse`` gives, units or errors; the banner may be null or left out.  One document
is in memory at a time, as the speakers of a meeting are known only at its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import ANONYMOUS, DOUBLED_TIME, MONTHS
from ledgerline.operators import units

#: A unit, or (with unit_no null) one error of the document.
UNIT = "unit_no int, name string, label string, sent date, lines array<struct<no: int, text: string, position: string>>, error string"
COLUMNS = ("unit_no", "name", "label", "sent", "lines", "error")
Line = tuple[int, str]


def _pattern(java: str) -> re.Pattern:
    """A pattern of the columns for Python: "." stops at every kind of line end, "$" is the very end."""
    return re.compile(java.replace(".", "[^\n\r\x85\u2028\u2029]").removesuffix("$") + (r"\Z" if java.endswith("$") else ""), re.ASCII)


_HEADER, _SEGMENT, _INTERNAL = _pattern(units.HEADER_KEY), _pattern(units.SEGMENT), _pattern(units.INTERNAL)
_FROM, _SENT, _SUBJECT, _COUNT = _pattern(units.FROM), _pattern(units.SENT), _pattern(units.SUBJECT), _pattern(units.COUNT)
_DOUBLED, _ANONYMOUS, _SENDER = _pattern(DOUBLED_TIME), _pattern(ANONYMOUS), _pattern(r"^(.+?)\s*<")
_MONTH_FIRST, _DAY_FIRST = re.compile(r"(\w+) (\d{1,2}), (\d{4})"), re.compile(r"(\d{1,2})\.? (\w+) (\d{4})")
_MONTH = {name.lower(): n for names in MONTHS.values() for n, name in enumerate(names, 1)}
_EARLY = "line %d: text before the first speaker"


def _date(text: str) -> date | None:
    if m := _MONTH_FIRST.search(text):
        month, day, year = m.groups()
    elif m := _DAY_FIRST.search(text):
        day, month, year = m.groups()
    else:
        return None
    try:
        return date(int(year), _MONTH.get(month.lower(), 0), int(day))
    except ValueError:
        return None


class _Turns:
    """Turns of a meeting while its lines go by: a turn that gets no line leaves no unit."""

    def __init__(self) -> None:
        self.speaker: str | None = None
        self.position: str | None = None
        self.found: list[tuple[str, list]] = []
        self.errors: list[str] = []
        self._open = False

    def marked(self, speaker: str, position: str | None = None, anew: bool = False) -> None:
        """A mark of a speaker: goes on with that speaker's turn or, if ``anew`` or another speaks, begins one."""
        self._open = self._open and not anew and speaker == self.speaker
        self.speaker, self.position = speaker, position

    def said(self, no: int, text: str, position: str | None) -> None:
        if self.speaker is None:
            self.errors.append(_EARLY % no)
            return
        if not self._open:
            self.found.append((self.speaker, []))
            self._open = True
        self.found[-1][1].append((no, text, position))


def _speech(body: list[Line]) -> _Turns:
    """Turns of a meeting with four-line speech headers."""
    turns, used = _Turns(), 0
    texts = [t for _, t in body]
    raw = [bool(_DOUBLED.match(after)) for after in texts[1:]] + [False]
    speakers = {t for t, r in zip(texts, raw, strict=False) if r}
    parts = [m.groups() if (m := _SEGMENT.match(t)) else ("", "") for t in texts]
    for i, (no, t) in enumerate(body):
        if raw[i] and not any(raw[max(i - 3, 0) : i]):
            name, elapsed = parts[i + 3] if i + 3 < len(body) else (None, None)
            if name != t:
                turns.errors.append(f"line {no + 3}: expected '{t} <elapsed>', got '{texts[i + 3] if i + 3 < len(body) else ''}'")
            turns.marked(t, elapsed, anew=True)
            used = 3
        elif used:
            used -= 1
        elif parts[i][0] and parts[i][0] in speakers:
            turns.marked(*parts[i])
        elif t:
            turns.said(no, t, turns.position)
    return turns


def _labelled(body: list[Line]) -> _Turns:
    """Turns of a meeting with the labels of its own side and the other."""
    turns = _Turns()
    for no, t in body:
        if m := _INTERNAL.match(t):
            turns.marked(m[1])
            t = m[2]
        elif not t:
            continue
        turns.said(no, t, f"line {no}")
    return turns


def _meeting(lines: list[Line]) -> tuple[list[tuple], list[str]]:
    keys: dict[str, int] = {}
    for at, (_, t) in enumerate(lines):
        if m := _HEADER.match(t):
            keys[m[1]] = at
            if m[1] == "Attendees":
                break
    if "Attendees" not in keys:
        return [], ["no Attendees line in the transcript header"]
    errors = [] if "Date" in keys else ["no Date line in the transcript header"]
    body = lines[keys["Attendees"] + 1 :]
    inside = re.match("(Me|Them):", next((t for _, t in body if t), "")) is not None
    turns = _labelled(body) if inside else _speech(body)
    unnamed = lambda who: inside or bool(_ANONYMOUS.match(who))
    rows = [(n, None if unnamed(who) else who, who if unnamed(who) else None, None, said) for n, (who, said) in enumerate(turns.found, 1)]
    return rows, errors + turns.errors


def _thread(lines: list[Line], raw: list[str | None], banner: str | None) -> tuple[list[tuple], list[str]]:
    starts = [at for at, (_, t) in enumerate(lines) if _FROM.match(t)]
    declared = next((int(m[1]) for _, t in lines if (m := _COUNT.match(t))), None)
    errors = [] if declared == len(starts) else [f"header says {'no' if declared is None else declared} messages, found {len(starts)}"]
    rows = []
    for n, (at, stop) in enumerate(zip(starts, [*starts[1:], len(lines)], strict=False), 1):
        end = next((k for k in range(at, stop) if _SUBJECT.match(lines[k][1]) or _COUNT.match(lines[k][1])), None)
        if end is None:
            errors.append(f"line {lines[at][0]}: no end of the message header")
            continue
        sent_raw = next((m[1] for k in range(at, end) if (m := _SENT.match(lines[k][1]))), None)
        sent = _date(sent_raw or "")
        if sent is None:
            errors.append(f"unrecognised date: {'none' if sent_raw is None else sent_raw}")
        sender = _FROM.match(lines[at][1])[1]
        name = m[1] if (m := _SENDER.match(sender)) else sender.strip(" ")
        place = f"message {n} of {len(starts)}"
        body = [(no, t, place) for (no, t), whole in zip(lines[end + 1 : stop], raw[end + 1 : stop], strict=True) if t and not (banner and (whole or "").startswith(banner))]
        rows.append((n, name, None, sent, body))
    return rows, errors


def rows_of(lines: list[tuple[int, str | None]], doc_type: str | None, banner: str | None = None) -> Iterator[tuple]:
    """Rows of UNIT for one document's numbered lines: its errors if it has any, else its units.  Null lines are blank."""
    plain = [(no, (t or "").strip()) for no, t in lines]
    if doc_type == "transcript":
        rows, errors = _meeting(plain)
    elif doc_type in ("email", "report"):
        rows, errors = _thread(plain, [t for _, t in lines], banner)
    else:
        return
    if errors:
        yield from ((None, None, None, None, None, e) for e in errors)
    else:
        yield from ((*row, None) for row in rows)


@F.udtf(returnType=UNIT)
class ParseUnits:
    """Units or errors of a whole document; a null text gives no row."""

    def eval(self, text: str, doc_type: str, banner: str = None):
        if text is not None:
            yield from rows_of(list(enumerate(text.split("\n"), 1)), doc_type, banner)


@F.udtf(returnType=f"doc_id string, {UNIT}")
class ParseUnitLines:
    """Units or errors of documents given as rows of (doc_id, doc_type, line_no, text), a partition a document in the order of its lines."""

    def __init__(self):
        self.lines, self.of, self.banner = [], None, None

    def eval(self, row, banner: str = None):
        self.of, self.banner = (row["doc_id"], row["doc_type"]), banner
        self.lines.append((row["line_no"], row["text"]))

    def terminate(self):
        if self.of:
            for row in rows_of(self.lines, self.of[1], self.banner):
                yield (self.of[0], *row)


def register(spark: SparkSession) -> None:
    """Make ``parse_units`` and ``parse_unit_lines`` known to the session's SQL."""
    spark.udtf.register("parse_units", ParseUnits)
    spark.udtf.register("parse_unit_lines", ParseUnitLines)


def of_texts(documents: DataFrame, banner: str | None = None) -> DataFrame:
    """doc_id and the columns of UNIT for documents (doc_id, doc_type, text): a lateral join without shuffle."""
    return documents.lateralJoin(ParseUnits(F.col("text").outer(), F.col("doc_type").outer(), F.lit(banner).cast("string"))).select("doc_id", *COLUMNS)


def of_lines(lines: DataFrame, banner: str | None = None) -> DataFrame:
    """doc_id and the columns of UNIT for lines (doc_id, doc_type, line_no, text): one shuffle by document."""
    table = lines.select("doc_id", "doc_type", "line_no", "text").asTable().partitionBy("doc_id").orderBy("line_no")
    return ParseUnitLines(table, F.lit(banner).cast("string"))
