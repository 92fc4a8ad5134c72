"""Queries over whole archives: the driver's tables rendered as transcripts and mail threads, parsed back, verified and linked.

Conversations become transcripts with a full speech header a turn, orders become one mail thread a customer.  What a
model would answer is made from the parsed rows by rule, so that SQL can say what has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import links, segments, statements, units
from ledgerline.operators.sequences import rows_numbered
from ledgerline.plans.catalogue import _WS, BANNER, _as_lines, _by_customer, _t, _talks, query
from ledgerline.sources.sinks import settled

_NO_ORG, _UNKNOWN_ACT = "Nowhere Ltd", "shout"
#: Acts that units of a meeting get in turn.
_ACTS = ("proposal", "agreement", "question", "decision")
_RESPONSES = ("accepted", "rejected", "none")


def _meeting_lines(spark: SparkSession, d: str) -> DataFrame:
    """A transcript a conversation: the header, then each turn below its four lines of speech header."""
    return _as_lines(_talks(spark, d), "conv_id", "transcript")


#: The same in SQL: a row a turn with the number of lines before it, its lines and its words.
_TURNS = rf"""
WITH m AS (SELECT conv_id::VARCHAR AS doc_id, turn, role, string_split(text, chr(10)) AS lines, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS body,
    CASE role WHEN 'user' THEN 'Ada Berg' WHEN 'assistant' THEN 'Per Holm' ELSE 'Guest 1' END AS who FROM conversations),
t AS (SELECT *, 4 + coalesce(sum(4 + len(lines)) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM m)
"""


def _candidates(found: DataFrame) -> DataFrame:
    """Five candidates a unit: a good one, the same again, one of a unit that isn't there, one with words that aren't there, one without claim or with an unknown act."""
    words = F.slice(F.split(X.collapse(F.array_join(F.transform("lines", lambda x: x["text"]), " ")), " "), 1, 5)
    n = F.col("unit_no")
    act = F.element_at(F.array(*[F.lit(a) for a in _ACTS]), n % 4 + 1)
    u = found.select("doc_id", n, F.array_join(words, " ").alias("quote"), F.array_join(F.slice(words, 1, 2), " ").alias("start"), act.alias("act")).withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(4))))
    kind = F.col("kind")
    return u.select(
        "doc_id", (n * 5 + kind).alias("model_seq"), F.when(kind == 2, n + 100_000).otherwise(n).alias("unit"), F.when(kind == 3, F.concat("quote", F.lit(" zzqx"))).otherwise(F.col("quote")).alias("span"),
        F.when((kind == 4) & (n % 2 == 0), "  ").otherwise(F.concat(F.lit(" Claim "), n.cast("string"))).alias("claim"), F.when((kind == 4) & (n % 2 == 1), _UNKNOWN_ACT).otherwise(F.col("act")).alias("act"),
        F.when(n % 3 == 0, "EXAMPLE   co").otherwise(_NO_ORG).alias("org"), F.when(n % 2 == 0, F.col("start")).otherwise("zzqx").alias("role"), F.lit("none").alias("handling"),
    )


def _verified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, rejected candidates and documents of the rendered meetings; units and documents are parsed once for all three."""
    parsed = units.parse(_meeting_lines(spark, d), keep=settled)
    found, documents = settled(parsed.units), settled(parsed.documents)
    return *statements.verified(_candidates(found), found, documents, units.heads(documents)), documents


_RECORDS = (
    _TURNS
    + rf"""
, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn)::INTEGER AS n, string_split(body, ' ') AS words,
    list_transform(lines, lambda s: len(list_filter(regexp_split_to_array(s, '{_WS}'), lambda w: w <> ''))) AS counts FROM t WHERE body <> ''),
r AS (SELECT doc_id, n, who, doc_id || '#' || n AS id, array_to_string(words[1:5], ' ') AS span, ['proposal', 'agreement', 'question', 'decision'][n % 4 + 1] AS act, (turn + 1) || ' minutes 5 seconds' AS position,
    (base + 4 + list_filter(range(1, len(counts) + 1), lambda i: list_sum(counts[1:i]) >= 1)[1])::INTEGER AS first_line,
    (base + 4 + list_filter(range(1, len(counts) + 1), lambda i: list_sum(counts[1:i]) >= least(5, len(words)))[1])::INTEGER AS last_line,
    CASE WHEN n % 3 = 0 THEN 'EXAMPLE co' END AS org, CASE WHEN n % 2 = 0 THEN array_to_string(words[1:2], ' ') END AS role FROM u)
"""
)


@query(
    _RECORDS
    + rf"""
SELECT doc_id, id AS ref, NULL AS reason, first_line, last_line, position, md5(span) AS span_digest, org, role, '2025-03-04' AS stated_on FROM r
UNION ALL SELECT doc_id, 'seq ' || (n * 5 + kind), CASE kind WHEN 1 THEN '{statements.DUPLICATE}' WHEN 2 THEN '{statements.NO_UNIT}' WHEN 3 THEN '{statements.NO_SPAN}' ELSE '{statements.NO_CLAIM}' END,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r, (VALUES (1), (2), (3), (4)) k(kind)
"""
)
def q46_verify_candidates(spark, d):
    """The verification cascade: five candidates a unit of the meetings; accepted ones with ids and places, the others with the first rule they break."""
    records, rejected, _ = _verified(spark, d)
    kept = records.select("doc_id", F.col("id").alias("ref"), F.lit(None).cast("string").alias("reason"), "first_line", "last_line", "position", F.md5(F.col("span").cast("binary")).alias("span_digest"), "actor.org", "actor.role", "stated_on")
    return kept.unionByName(rejected.select("doc_id", F.concat(F.lit("seq "), F.col("model_seq").cast("string")).alias("ref"), "reason"), allowMissingColumns=True)


@query(
    _RECORDS
    + f"""
SELECT doc_id AS document_id, id, n AS seq, 'Claim ' || n AS claim, act AS speech_act, who AS name, coalesce(org, '{statements.NOT_STATED}') AS organization, '2025-03-04' AS document_date, '2025-03-04 00:00:00' AS statement_date,
    count(*) OVER (PARTITION BY doc_id) AS in_document FROM r
"""
)
def q47_statements_file(spark, d):
    """Records nested into the file's blocks, a row a document, and read back as flat statements with derived ids."""
    records, _, documents = _verified(spark, d)
    blocks = settled(statements.blocks(records, documents))
    flat = statements.checked_acts(statements.flattened(blocks)).join(blocks.select(F.col("id").alias("document_id"), F.size("statements").cast("long").alias("in_document")), "document_id")
    return flat.select("document_id", "id", "seq", "claim", "speech_act", "actor.name", "actor.organization", F.col("document_date").cast("string").alias("document_date"), F.col("statement_date").cast("string").alias("statement_date"), "in_document")


@query(
    _RECORDS
    + """
, q AS (SELECT *, ['accepted', 'rejected', 'none'][n % 3 + 1] AS response, array_to_string(string_split(lead(span) OVER (PARTITION BY doc_id ORDER BY n), ' ')[1:2], ' ') AS quote FROM r),
later AS (SELECT a.doc_id, a.id, a.response, a.quote, b.id AS later_id, b.who AS later_who, b.span AS later_span, row_number() OVER (PARTITION BY a.doc_id, a.n ORDER BY b.n) AS place
    FROM q a JOIN r b ON a.doc_id = b.doc_id AND b.n > a.n AND b.who <> a.who WHERE a.act IN ('proposal', 'question')),
judged AS (SELECT doc_id, id, any_value(response) AS response, arg_min(later_id, place) FILTER (WHERE later_who = 'Per Holm' AND contains(lower(later_span), lower(quote))) AS source, count(*) AS shown FROM later WHERE place <= 8 GROUP BY ALL)
SELECT doc_id, id AS statement_id, shown, CASE WHEN response = 'none' THEN 'no response' WHEN source IS NULL THEN 'response not found in the text' ELSE response END AS outcome,
    CASE WHEN response = 'accepted' AND source IS NOT NULL THEN 'Per Holm' END AS agreed_by, CASE WHEN response = 'accepted' THEN source END AS source FROM judged
"""
)
def q48_agreement_links(spark, d):
    """Proposals and questions, up to eight later statements by others, and replies that count only if the person named said the words."""
    records = settled(_verified(spark, d)[0])
    n = F.element_at(F.split("id", "#"), -1).cast("int")
    following = F.lead("span").over(Window.partitionBy("doc_id").orderBy("n"))
    response = F.element_at(F.array(*[F.lit(r) for r in _RESPONSES]), F.col("n") % 3 + 1)
    replies = records.withColumn("n", n).select("doc_id", F.col("id").alias("statement_id"), response.alias("response"), F.lit("Per Holm").alias("by"), F.array_join(F.slice(F.split(following, " "), 1, 2), " ").alias("quote"))
    later = settled(links.later_by_others(records))
    out, outcomes = links.linked(records, replies, shown=later)
    shown = later.groupBy("statement_id").agg(F.count(F.lit(1)).alias("shown"))
    first = F.try_element_at("agreed_by", F.lit(1))
    agreed = out.select(F.col("id").alias("statement_id"), first["name"].alias("agreed_by"), first["statement"].alias("source"))
    return outcomes.join(agreed, "statement_id").join(shown, "statement_id").select("doc_id", "statement_id", "shown", "outcome", "agreed_by", "source")


@query(
    _TURNS
    + rf"""
, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS i, array_to_string(list_filter(list_transform(lines, lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')), lambda x: x <> ''), ' ') AS said FROM t)
SELECT doc_id, format('{{}}#t{{:04d}}', doc_id, i) AS segment_id, (turn + 1) || ':05' AS timestamp, (base + 5)::INTEGER AS first_line, (base + 4 + len(lines))::INTEGER AS last_line, who AS speaker,
    CASE WHEN who = 'Ada Berg' THEN 'Example Co' ELSE 'Unknown' END AS org, who = 'Ada Berg' AS resolved, '2025-03-04' AS effective_date, md5(said) AS text_digest FROM s WHERE said <> ''
"""
)
def q49_utterance_segments(spark, d):
    """The finer front end over the meetings: marked utterances, their lines, speakers resolved against a registry."""
    registry = _t(spark, d, "conversations").filter("role = 'user'").select(F.lit("p1").alias("canonical_id"), F.lit("Ada Berg").alias("name"), F.lit("Example Co").alias("org"), F.array(F.lit("ada@example.com")).alias("emails")).distinct()
    s = segments.transcript_segments(_meeting_lines(spark, d), registry)
    at = F.col("position")
    return s.select(
        "doc_id", "segment_id", at["timestamp"].alias("timestamp"), at["line_range"][0].alias("first_line"), at["line_range"][1].alias("last_line"),
        F.col("speaker_or_author").alias("speaker"), F.col("speaker_org").alias("org"), F.col("speaker_resolved").alias("resolved"), "effective_date", F.md5(F.col("text").cast("binary")).alias("text_digest"),
    )


def _thread_lines(spark: SparkSession, d: str, prefix: str = "") -> DataFrame:
    """A mail thread a customer with a message an order; every third order's message holds an image.  ``prefix``: what its id begins with."""
    o = _by_customer(spark, d, prefix)
    w = Window.partitionBy("o_custkey")
    first = F.row_number().over(w.orderBy("o_orderkey")) == 1
    key, who = F.col("o_orderkey").cast("string"), F.substr("o_custkey", F.lit(len(prefix) + 1))
    month = F.element_at(F.array(*[F.lit(name) for name in X.MONTHS["en"]]), F.month("o_orderdate"))
    mail = F.concat(
        F.when(first, F.concat(F.lit("Messages in thread: "), F.count(F.lit(1)).over(w).cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("From: Buyer <C"), who, F.lit("@Example.com>\nDate: Monday, "), month, F.lit(" "), F.dayofmonth("o_orderdate").cast("string"), F.lit(", "), F.year("o_orderdate").cast("string"),
        F.lit(" 10:00 AM\nTo: Sales; Someone <c"), (who.cast("long") + 1).cast("string"), F.lit("@example.com>\nCc: Archive <archive@example.com>\nSubject: Order "), key,
        F.lit(f"\n\n{BANNER}\nOrder "), key, F.lit(" is late.\n"), F.when(F.col("o_orderkey") % 3 == 0, "[cid:logo.png]\n").otherwise(""), F.lit("Please ship.\n\nThanks\nBuyer"),
    )
    return _as_lines(o.select("o_custkey", F.col("o_orderkey").alias("seq"), mail.alias("text")), "o_custkey", "email")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """The registry of people: every customer with an address."""
    key = F.col("c_custkey").cast("string")
    return _t(spark, d, "customer").select(key.alias("canonical_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("org"), F.array(F.concat(F.lit("c"), key, F.lit("@example.com"))).alias("emails"))


_MESSAGES = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n,
    12 + (o_orderkey % 3 = 0)::INTEGER + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)::INTEGER AS size FROM orders),
m AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM o),
p AS (SELECT m.*, coalesce(a.c_name, 'Buyer') AS author, coalesce(a.c_mktsegment, 'Unknown') AS org, a.c_custkey IS NOT NULL AS resolved, coalesce(b.c_name, 'Someone') AS other, b.c_custkey IS NOT NULL AS known
    FROM m LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey + 1)
"""


@query(
    _MESSAGES
    + """
SELECT o_custkey::VARCHAR AS doc_id, format('{}#m{:04d}', o_custkey, i) AS segment_id, (upto - size + 1)::INTEGER AS first_line, upto::INTEGER AS last_line, author, org, resolved,
    'Sales/-/false; ' || other || '/c' || (o_custkey + 1) || '@example.com/' || known || '; Archive/archive@example.com/false' AS recipients,
    o_orderdate::DATE::VARCHAR AS effective_date, 'Order ' || o_orderkey || ' is late. Please ship.' AS text, 'Order ' || o_orderkey AS subject, o_orderkey % 3 = 0 AS has_image FROM p
"""
)
def q50_mail_segments(spark, d):
    """The finer front end over mail threads: fields, bodies without banner, images and closings, people resolved by address."""
    s = segments.email_segments(_thread_lines(spark, d), _customers(spark, d), BANNER)
    one = lambda r: F.concat_ws("/", r["name"], F.coalesce(r["email"], F.lit("-")), r["resolved"].cast("string"))
    at = F.col("position.line_range")
    return s.select(
        "doc_id", "segment_id", at[0].alias("first_line"), at[1].alias("last_line"), F.col("speaker_or_author").alias("author"), F.col("speaker_org").alias("org"), F.col("speaker_resolved").alias("resolved"),
        F.array_join(F.transform("recipients", one), "; ").alias("recipients"), "effective_date", "text", "subject", F.col("contains_image_placeholder").alias("has_image"),
    )


@query(
    _MESSAGES
    + """
, talks AS (SELECT conv_id::VARCHAR AS doc_id, 'transcript' AS doc_type, '2025-03-04' AS doc_date, 'Planning' AS title, NULL::INTEGER AS declared, count(*) FILTER (WHERE trim(text) <> '') AS parsed, 'Ada Berg (Example Co; joins late); Per Holm' AS participants FROM conversations GROUP BY conv_id),
mails AS (SELECT 'thread ' || o_custkey AS doc_id, 'email_thread' AS doc_type, arg_min(o_orderdate, i)::DATE::VARCHAR AS doc_date, 'Order ' || min(o_orderkey) AS title, max(n)::INTEGER AS declared, count(*) AS parsed,
    array_to_string(list_sort(list_distinct(['Archive', 'Sales', any_value(author), any_value(other)])), '; ') AS participants FROM p GROUP BY o_custkey)
SELECT * FROM talks UNION ALL SELECT * FROM mails
"""
)
def q51_document_meta(spark, d):
    """One row a document of both kinds: title, date, people, messages declared and found."""
    meta = segments.document_facts(_meeting_lines(spark, d), _thread_lines(spark, d, "thread "), _customers(spark, d), BANNER)
    return meta.select("doc_id", "doc_type", "doc_date", "title", "declared", "parsed", F.array_join("participants", "; ").alias("participants"))


@query("SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, event_id, user_id FROM events")
def q52_hot_numbering(spark, d):
    """Rows numbered within few large groups, in pieces: no task sorts more than a piece of a group."""
    return rows_numbered(_t(spark, d, "events").select("event_type", "event_id", "user_id"), ["event_type"], ["event_id"], "n")
