"""The finer front end: timestamped utterances and messages with recipients, annotations and topics.

It knows English mail headers only and has no reader for reports; its rules differ from those of ``units`` and
the two aren't mixed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import strip, without_parentheses
from ledgerline.operators.people import keys_of, listed, resolved
from ledgerline.operators.sequences import batches

# The forms of header lines, speech marks, image placeholders, closings and dates in the archive's files.
HEADER = r"^(Meeting|Customer|Date|Phase|Attendees):\s*(.*)$"
MARKER = r"^(.+?) (\d+) minutes?(?: (\d+) seconds?)?$"
DOUBLED, INITIALS = r"^(\d{1,2}:\d{1,2})\1$", r"^[A-Z]{1,4}\d*$"
FROM = r"^From:\s*(.+)$"
IMAGE = r"\[Image removed by sender\]|\[cid:[^\]]+\]|Bild borttagen av avs[aä]ndaren|^Image$"
CLOSING = r"(?i)^(Best regards|Kind regards|Regards|Thanks|Cheers)[,.]?\s*$"
DATE_FORMATS = ("EEEE, MMMM d, yyyy h:mm a", "EEEE, MMMM d, yyyy HH:mm")
#: What a segment without annotation gets.
DEFAULTS = {"speech_act": "other", "topics": [], "people_mentioned": [], "is_truncated": False, "supersedes_segment_id": None}
BATCH = 40
#: Speech acts of this front end (another set than that of the statements).
ACTS = ("statement", "proposal", "agreement", "decision", "report_of_decision", "question", "action_item", "other")


def _by():
    return Window.partitionBy("doc_id")


def _order():
    return _by().orderBy("line_no")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, 0)



def transcript_meta(lines: DataFrame) -> DataFrame:
    """doc_id, meta, participants (attendees split at every comma) and content_start (line after the first blank one after Attendees)."""
    t = lines.withColumn("t", strip(F.col("text"))).withColumn("k", F.regexp_extract("t", HEADER, 1)).withColumn("v", F.trim(F.regexp_extract("t", HEADER, 2)))
    t = t.withColumn("listed", F.min(F.when(F.col("k") == "Attendees", F.col("line_no"))).over(_by())).withColumn("last", F.max("line_no").over(_by()))
    t = t.withColumn("blank", F.min(F.when((F.col("t") == "") & (F.col("line_no") > F.col("listed")), F.col("line_no"))).over(_by()))
    t = t.withColumn("content_start", F.coalesce(F.col("blank") + 1, F.col("last") + 1))
    keyed = t.filter((F.col("k") != "") & (F.col("line_no") < F.col("content_start"))).groupBy("doc_id", "k").agg(F.max_by("v", "line_no").alias("v"))
    meta = keyed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))
    out = t.groupBy("doc_id").agg(F.max("content_start").alias("content_start")).join(meta, "doc_id", "left")
    return out.withColumn("participants", F.coalesce(without_parentheses(F.try_element_at("meta", F.lit("Attendees"))), F.array().cast("array<string>")))


def utterances(lines: DataFrame) -> DataFrame:
    """doc_id, index, speaker, timestamp (m:ss), first_line, last_line, text of each marked utterance that has text.

    A marker is "<name> N minutes [S seconds]" ("N seconds" alone and hours aren't markers here); the three
    lines of a full header before it belong to it.  The index counts markers, so it may have gaps.
    """
    t = lines.join(transcript_meta(lines).select("doc_id", "content_start"), "doc_id").withColumn("t", strip(F.col("text")))
    content = F.col("line_no") >= F.col("content_start")
    t = t.withColumn("mark", content & F.col("t").rlike(MARKER)).withColumn("speaker", F.trim(F.regexp_extract("t", MARKER, 1)))
    full = (F.lag("t", 3).over(_order()) == F.col("speaker")) & F.lag("t", 2).over(_order()).rlike(DOUBLED) & F.lag("t", 1).over(_order()).rlike(INITIALS)
    wide = F.col("mark") & F.coalesce(full, F.lit(False)) & (F.col("line_no") - 3 >= F.col("content_start"))
    seconds = F.coalesce(F.nullif(F.regexp_extract("t", MARKER, 3), F.lit("")).cast("int"), F.lit(0))
    t = t.withColumn("wide", wide).withColumn("time", F.format_string("%d:%02d", F.regexp_extract("t", MARKER, 2).try_cast("int"), seconds))
    t = t.withColumn("n", F.sum(F.col("mark").cast("int")).over(_so_far()) - 1)
    t = t.withColumn("head", F.coalesce(F.bool_or("wide").over(_order().rowsBetween(1, 3)), F.lit(False)))
    of = Window.partitionBy("doc_id", "n")
    t = t.withColumn("last_line", F.max(F.when(~F.col("head"), F.col("line_no"))).over(of)).withColumn("first_line", F.min(F.when(F.col("mark"), F.col("line_no"))).over(of) + 1)
    rows = t.filter("n >= 0")
    said = F.sort_array(F.collect_list(F.when(~F.col("mark") & ~F.col("head") & (F.col("t") != ""), F.struct("line_no", "t"))))
    out = rows.groupBy("doc_id", "n").agg(
        F.max(F.when(F.col("mark"), F.col("speaker"))).alias("speaker"), F.max(F.when(F.col("mark"), F.col("time"))).alias("timestamp"),
        F.max("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.array_join(F.transform(said, lambda x: x["t"]), " ").alias("text"),
    )
    return out.filter("text <> ''").withColumnRenamed("n", "index")


def transcript_segments(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Segments of transcripts."""
    u = utterances(lines).withColumn("_mail", F.lit(None).cast("string"))
    u = resolved(u, registry, "_mail", "speaker", "p").join(transcript_meta(lines).select("doc_id", "meta"), "doc_id")
    none = F.array().cast("array<struct<name:string,email:string,resolved:boolean>>")
    position = F.struct(F.lit("turn").alias("type"), F.col("index").cast("int").alias("index"), "timestamp", F.array(F.col("first_line"), F.col("last_line")).cast("array<int>").alias("line_range"))
    return u.select(
        "doc_id", F.format_string("%s#t%04d", "doc_id", "index").alias("segment_id"), position.alias("position"), F.col("p_name").alias("speaker_or_author"), F.col("p_org").alias("speaker_org"),
        F.col("p_resolved").alias("speaker_resolved"), none.alias("recipients"), F.try_element_at("meta", F.lit("Date")).alias("effective_date"), "text", F.lit(None).cast("string").alias("subject"), F.lit(False).alias("contains_image_placeholder"),
    )


def mail_date(text):
    """ISO date of an English mail date in one of two ways of writing, else null (week days aren't checked against the date)."""
    plain = F.regexp_replace(F.trim(text), r"^\w+, ", "")
    tries = [F.try_to_timestamp(plain, F.lit(f.removeprefix("EEEE, "))) for f in DATE_FORMATS]
    return F.coalesce(*tries).cast("date").cast("string")


def messages(lines: DataFrame, banner: str | None = None) -> DataFrame:
    """doc_id, index, fields (map of subject, date, to, cc, from, count), first_line, last_line, text, has_image of each message.

    The first message's block begins at the top of the file.  Its header ends at the first blank line after
    something was read; of a field twice the later counts.  From the body go the banner and lines with image
    placeholders (which are noted); it ends before a closing phrase or a line that is just the sender's name.
    """
    shapes = {"subject": r"^Subject:\s*(.*)$", "date": r"^(?:Date|Sent):\s*(.+)$", "to": r"^To:\s*(.*)$", "cc": r"^Cc:\s*(.*)$", "from": FROM, "count": r"^Messages in thread:\s*(\d+)$"}
    # What a line of such a shape begins with, which is told faster.
    begin = {"subject": ("Subject:",), "date": ("Date:", "Sent:"), "to": ("To:",), "cc": ("Cc:",), "from": ("From:",), "count": ("Messages in thread:",)}
    is_a = lambda k: reduce(or_, [F.startswith("t", F.lit(x)) for x in begin[k]]) & F.col("t").rlike(shapes[k])
    t = lines.withColumn("t", strip(F.col("text"))).withColumn("k", F.coalesce(*[F.when(is_a(k), k) for k in shapes]))
    t = t.withColumn("v", F.coalesce(*[F.when(F.col("k") == k, F.trim(F.regexp_extract("t", p, 1))) for k, p in shapes.items()]))
    begins = F.col("k") == "from"
    t = t.withColumn("who", F.when(begins, F.try_element_at(listed(F.col("v")), F.lit(1))["name"])).withColumn("image", F.col("t").rlike(IMAGE))
    n = F.sum(F.when(begins, 1).otherwise(0)).over(_so_far())
    t = t.withColumn("n", F.greatest(n, F.lit(1)) - 1)
    # Windows of a message lie within its document's: lines are neither shuffled nor joined here, however many they are.
    whole = Window.partitionBy("doc_id", "n")
    t = t.withColumn("read", F.min(F.when(F.col("k").isNotNull(), F.col("line_no"))).over(whole))
    t = t.withColumn("sender", F.max("who").over(whole)).withColumn("sent", F.max(F.when(begins, F.col("line_no"))).over(whole))
    t = t.withColumn("end", F.min(F.when((F.col("t") == "") & (F.col("line_no") > F.col("read")), F.col("line_no"))).over(whole))
    head = lambda at: F.col("end").isNull() | (F.col(at) < F.col("end"))
    t = t.withColumn("body", F.coalesce((F.col("line_no") > F.col("end")) & ~F.col("t").eqNullSafe(F.lit(banner)), F.lit(False)))
    closing = F.col("body") & ~F.col("image") & (F.col("t").rlike(CLOSING) | ((F.col("t") != "") & head("sent") & (F.lower("t") == F.lower("sender"))))
    t = t.withColumn("cut", F.min(F.when(closing, F.col("line_no"))).over(whole))
    kept = F.col("body") & ~F.col("image") & (F.col("t") != "") & (F.col("cut").isNull() | (F.col("line_no") < F.col("cut")))
    last = lambda k: F.max_by("v", F.when(head("line_no") & (F.col("k") == k), F.col("line_no")))
    out = t.groupBy("doc_id", "n").agg(
        F.array(*[F.struct(F.lit(k).alias("k"), last(k).alias("v")) for k in shapes]).alias("found"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.max("sent").alias("sent"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("line_no", "t")))), lambda x: x["t"]), " ").alias("text"), F.bool_or(F.col("body") & F.col("image")).alias("has_image"),
    ).filter("sent is not null")
    some = F.filter("found", lambda x: x["v"].isNotNull())
    fields = F.when(F.size(some) > 0, F.map_from_entries(some))
    return out.select("doc_id", F.col("n").cast("int").alias("index"), fields.alias("fields"), "first_line", "last_line", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("has_image", F.lit(False)).alias("has_image"))


def _field(k: str):
    return F.try_element_at("fields", F.lit(k))


def _sender():
    """(name, email) of a message's sender, the name "" where there is none."""
    first = F.try_element_at(listed(_field("from")), F.lit(1))
    return F.struct(F.coalesce(first["name"], F.lit("")).alias("name"), first["email"].alias("email"))


def _recipients():
    """(name, email) of those that a message is sent to, then of those that get a copy."""
    none = F.array().cast("array<struct<name:string,email:string>>")
    return F.concat(*[F.coalesce(listed(_field(k)), none) for k in ("to", "cc")])


def email_segments(lines: DataFrame, registry: DataFrame, banner: str | None = None) -> DataFrame:
    """Segments of English mail threads; messages without body text are left out."""
    m = messages(lines, banner).filter("text <> ''")
    known = keys_of(registry)
    m = m.withColumn("_s", _sender())
    m = m.withColumn("_sn", F.col("_s.name")).withColumn("_se", F.col("_s.email"))
    m = resolved(m, known, "_se", "_sn", "p")
    to = m.select("doc_id", "index", F.posexplode(_recipients()).alias("pos", "r")).select("doc_id", "index", "pos", F.col("r.name").alias("rn"), F.col("r.email").alias("re"))
    to = resolved(to, known, "re", "rn", "q")
    packed = to.groupBy("doc_id", "index").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col("q_name").alias("name"), F.col("re").alias("email"), F.col("q_resolved").alias("resolved")).alias("p")))), lambda x: x["p"]).alias("recipients"))
    m = m.join(packed, ["doc_id", "index"], "left")
    position = F.struct(F.lit("message").alias("type"), "index", F.lit(None).cast("string").alias("timestamp"), F.array("first_line", "last_line").cast("array<int>").alias("line_range"))
    return m.select(
        "doc_id", F.format_string("%s#m%04d", "doc_id", "index").alias("segment_id"), position.alias("position"), F.col("p_name").alias("speaker_or_author"), F.col("p_org").alias("speaker_org"),
        F.col("p_resolved").alias("speaker_resolved"), F.coalesce("recipients", F.array().cast("array<struct<name:string,email:string,resolved:boolean>>")).alias("recipients"),
        mail_date(_field("date")).alias("effective_date"), "text", _field("subject").alias("subject"), F.col("has_image").alias("contains_image_placeholder"),
    )


def _spoken(talks: DataFrame) -> DataFrame:
    """Facts of transcripts from their headers."""
    field = lambda k: F.try_element_at("meta", F.lit(k))
    return transcript_meta(talks).select("doc_id", F.lit("transcript").alias("doc_type"), field("Date").alias("doc_date"), field("Meeting").alias("title"), field("Phase").alias("phase"), F.lit(None).cast("int").alias("declared"), F.contains(F.upper("doc_id"), F.lit("INTERNAL")).alias("is_internal"), "participants")


def document_meta(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """One row a document: doc_id, doc_type, doc_date, title or subject, declared and parsed messages, is_internal, participants."""
    talks, threads = lines.filter("doc_type = 'transcript'"), lines.filter("doc_type = 'email'")
    first = messages(threads).filter("index = 0").select("doc_id", _field("subject").alias("title"), _field("count").cast("int").alias("declared"))
    found = segments.filter("position.type = 'message'").groupBy("doc_id").agg(F.min_by("effective_date", "position.index").alias("doc_date"), F.sort_array(F.array_distinct(F.concat(F.collect_set("speaker_or_author"), F.flatten(F.collect_list(F.transform("recipients", lambda r: r["name"])))))).alias("participants"))
    mails = first.join(found, "doc_id", "left").select("doc_id", F.lit("email_thread").alias("doc_type"), "doc_date", "title", F.lit(None).cast("string").alias("phase"), "declared", F.lit(False).alias("is_internal"), F.coalesce("participants", F.array().cast("array<string>")).alias("participants"))
    counts = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parsed"))
    return _spoken(talks).unionByName(mails).join(counts, "doc_id", "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))


def document_facts(talks: DataFrame, threads: DataFrame, registry: DataFrame, banner: str | None = None) -> DataFrame:
    """``document_meta`` of the lines of transcripts and of mails and the segments that ``parse`` makes of them, from the lines alone.

    Lines that are dealt out by doc_id stay where they are (so the kinds are given apart: a union would lose that), messages are read
    once and put together by thread, and what is shuffled is a row for each of a thread's people, not for each message and recipient.
    """
    spoken = _spoken(talks).join(utterances(talks).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parsed")), "doc_id", "left")
    said, first = F.col("text") != "", F.col("index") == 0
    m = messages(threads, banner).withColumn("people", F.when(said, F.array_distinct(F.concat(F.array(_sender()), _recipients()))))
    facts = m.groupBy("doc_id").agg(
        F.struct(
            F.min_by(mail_date(_field("date")), F.when(said, F.col("index"))).alias("doc_date"), F.max(F.when(first, _field("subject"))).alias("title"),
            F.max(F.when(first, _field("count"))).cast("int").alias("declared"), F.count(F.when(said, 1)).alias("parsed"),
        ).alias("facts"),
        F.array_distinct(F.flatten(F.collect_set("people"))).alias("people"),
    )
    # A thread's facts go with the first of its people (or with none, if it has no text).
    each = facts.select("doc_id", "facts", F.posexplode_outer("people").alias("pos", "r")).select("doc_id", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("facts")).alias("facts"), F.col("r.name").alias("rn"), F.col("r.email").alias("re"))
    named = resolved(each, keys_of(registry), "re", "rn", "q").groupBy("doc_id").agg(F.max("facts").alias("f"), F.sort_array(F.collect_set("q_name")).alias("participants"))
    mails = named.select("doc_id", F.lit("email_thread").alias("doc_type"), "f.doc_date", "f.title", F.lit(None).cast("string").alias("phase"), "f.declared", F.lit(False).alias("is_internal"), "participants", "f.parsed")
    return spoken.unionByName(mails).withColumn("parsed", F.coalesce("parsed", F.lit(0)))


def parse(lines: DataFrame, registry: DataFrame, banner: str | None = None) -> DataFrame:
    """Segments of transcripts and mails; reports raise, as this front end can't read them.

    ``banner``: the whole line that marks mail from outside, none by default.
    """
    if not lines.filter("doc_type not in ('transcript', 'email')").isEmpty():
        raise NotImplementedError("this front end reads transcripts and emails only")
    return transcript_segments(lines.filter("doc_type = 'transcript'"), registry).unionByName(email_segments(lines.filter("doc_type = 'email'"), registry, banner))


def annotated(segments: DataFrame, annotations: DataFrame) -> DataFrame:
    """Segments with their annotations; those without get the defaults."""
    joined = segments.join(annotations, "segment_id", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {"speech_act": F.coalesce("speech_act", F.lit("other")), "topics": F.coalesce("topics", none), "people_mentioned": F.coalesce("people_mentioned", none), "is_truncated": F.coalesce("is_truncated", F.lit(False))}
    )


#: Fields of a segment that the annotating model is shown.
SHOWN = ("segment_id", "speaker_or_author", "text")


def prompt_view(segments: DataFrame) -> DataFrame:
    """What the annotating model is shown of a segment."""
    return segments.select(*SHOWN)


def annotate(segments: DataFrame, model: Callable[..., list[dict]], vocabulary: set[str] | None = None, size: int = BATCH, documents: DataFrame | None = None) -> tuple[list[dict], set[str]]:
    """(annotations, topic vocabulary) from an injected model, batch after batch.

    ``model(segments, topics)`` gets a batch as it is shown and the topics in use; with ``documents`` (doc_id, doc_type,
    doc_date) it gets the batch's document as a third argument.  A ValueError or OSError in a call leaves that batch
    without annotations.  Each batch sees the topics found so far, so they are asked for one after another, by the driver;
    but batches are put together by Spark, all at once, and stream through the driver one at a time: the archive is
    parsed once however many batches there are.
    """
    known, out = set(vocabulary or ()), []
    shown = F.sort_array(F.collect_list(F.struct(F.col("position.index").alias("index"), *[F.col(c) for c in SHOWN]))).alias("shown")
    grouped = batches(segments, ["doc_id"], ["position.index"], size).groupBy("doc_id", "batch").agg(shown)
    if documents is not None:
        grouped = grouped.join(documents.select("doc_id", "doc_type", "doc_date"), "doc_id", "left")
    # One ordered partition, a batch a row: a job a partition would parse nothing anew, but start as many jobs.
    for row in grouped.repartition(1).sortWithinPartitions("doc_id", "batch").toLocalIterator(prefetchPartitions=False):
        view = [{c: x[c] for c in SHOWN} for x in row["shown"]]
        about = () if documents is None else ({c: row[c] for c in ("doc_id", "doc_type", "doc_date")},)
        try:
            found = model(view, sorted(known), *about)
        except (ValueError, OSError):
            continue
        for item in found:
            out.append(item)
            known |= set(item.get("topics") or ())
    return out, known


def vocabulary_of(annotations: DataFrame) -> DataFrame:
    """One row: all topics, sorted and distinct."""
    return annotations.select(F.explode("topics").alias("t")).agg(F.sort_array(F.collect_set("t")).alias("topics"))

