"""The query catalogue: every operator on the driver's tables, with SQL that gives the same rows.

Each query takes (spark, sf_dir).  Queries run over whole tables.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import answers, deletion, parse_units, people, sequences, spans, units
from ledgerline.operators.answers import DELIMITER
from ledgerline.sources.corpus import lines_of
from ledgerline.sources.sinks import settled
from ledgerline.streaming import holdback, sse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Characters of rendered text that a task takes in: its lines and chunks, which are many times as wide, are sorted several times.
PIECE = 2 << 20


def _dealt(rows: DataFrame, key: str, chars: int | None) -> DataFrame:
    """Rows dealt out by a key to as many tasks as ``chars`` characters of text ask for, whatever their bytes are when packed.

    What is made of them later (lines, chunks) stays where it is, so that tasks get more and not larger as tables grow.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-(chars or 0) // PIECE)), key)


def _chars(table: DataFrame, more: int = 0) -> int | None:
    """Characters of a table's texts and ``more`` a row."""
    return table.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + more)).first()[0]


#: Keys up to which they go to every task, so that the many pairs of all texts aren't shuffled to meet them.
FEW_KEYS = 1 << 17


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: White space for DuckDB, whose \s is ASCII only.
_WS = r"[\s\p{Z}\x1c-\x1f\x85]+"
_COLLAPSED = rf"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM documents"


#: What the mails of the thread query have as their mark of outside mail.
BANNER = "Sent from outside"


@query(f"SELECT doc_id, line_no, text FROM ({_LINES}) WHERE {_COLLAPSED} <> ''")
def q01_line_scan(spark, d):
    return lines_of(_t(spark, d, "documents")).filter(X.collapse(F.col("text")) != "")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'tion of the') OR contains(text, 'que los') OR contains(source, '7')")
def q02_doc_filter_any(spark, d):
    docs = _t(spark, d, "documents")
    return docs.filter(X.contains_any(F.col("text"), ["tion of the", "que los"]) | X.contains_any(F.col("source"), ["7"])).select("doc_id", "source")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def q03_type_counts(spark, d):
    return _t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INTEGER AS island FROM m)
SELECT user_id, island, min(event_type) AS event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY user_id, island
""")
def q04_islands(spark, d):
    runs = sequences.islands(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events
""")
def q05_carry_forward(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return sequences.carried_forward(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], value, "last_purchase").select("event_id", "last_purchase")


_NEXT = """
WITH p AS (SELECT a.conv_id, a.turn, b.turn AS later_turn, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn)::INTEGER AS place
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.role <> a.role WHERE a.role = 'user')
"""


@query(_NEXT + "SELECT conv_id, turn, later_turn, place FROM p WHERE place <= 8")
def q06_lookahead8(spark, d):
    return sequences.look_ahead(_t(spark, d, "conversations"), ["conv_id"], "turn", "role", F.col("role") == "user", 8)


@query(_NEXT + "SELECT p.conv_id, p.turn, c.turn AS reply_turn, c.role AS reply_role FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.later_turn WHERE place = 1")
def q07_first_reply(spark, d):
    c = _t(spark, d, "conversations")
    near = sequences.look_ahead(c, ["conv_id"], "turn", "role", F.col("role") == "user", 1)
    replies = c.select("conv_id", F.col("turn").alias("later_turn"), F.col("role").alias("reply_role"))
    return near.join(replies, ["conv_id", "later_turn"]).select("conv_id", "turn", F.col("later_turn").alias("reply_turn"), "reply_role")


@query("""
WITH r AS (SELECT d.lang, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN n_chars < 300 THEN 'short' WHEN quality = 0 THEN 'low quality' WHEN toxic = 1 THEN 'toxic' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY ALL
""")
def q08_validity_cascade(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    reason = sequences.first_failure([(F.col("known").isNull(), "no label"), (F.col("n_chars") < 300, "short"), (F.col("quality") == 0, "low quality"), (F.col("toxic") == 1, "toxic")])
    return docs.groupBy("lang", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT min(doc_id) AS doc_id, md5({_COLLAPSED}) AS digest FROM documents GROUP BY {_COLLAPSED}")
def q09_dedupe_first(spark, d):
    # The key is a digest of the words: the texts themselves aren't shuffled.
    docs = _t(spark, d, "documents").select("doc_id", F.md5(X.collapse(F.col("text")).cast("binary")).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query("""
SELECT o_orderkey AS order_key, o_orderkey || '#' || row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id,
       l_partkey AS part_key, l_quantity AS quantity, count(*) OVER (PARTITION BY o_orderkey) AS n_lines
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def q10_nest_flatten_ids(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = _t(spark, d, "lineitem").withColumn("part_key", F.col("l_partkey")).withColumn("quantity", F.col("l_quantity"))
    packed = sequences.nested(lines, ["l_orderkey"], order, ["part_key", "quantity"], "lines")
    per_order = _t(spark, d, "orders").select(F.col("o_orderkey").alias("order_key")).join(packed, F.col("order_key") == F.col("l_orderkey"))
    rows = per_order.select("order_key", F.size("lines").cast("long").alias("n_lines"), F.posexplode("lines").alias("p", "x"))
    return rows.select("order_key", F.concat_ws("#", "order_key", (F.col("p") + 1).cast("string")).alias("id"), "x.part_key", "x.quantity", "n_lines")


@query("""
WITH c AS (SELECT user_id, (props->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS marker FROM events)
SELECT user_id, marker, p_partkey, p_name FROM c JOIN part ON p_partkey = k
""")
def q11_citation_resolve(spark, d):
    cited = _t(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    asked = cited.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "k"))), lambda x: x["k"]).alias("ids"))
    table = _t(spark, d, "part").select("p_partkey", "p_name")
    return answers.citations(asked, table, "user_id", "ids", "p_partkey").select("user_id", "marker", "p_partkey", "p_name")


@query("SELECT d.doc_id, coalesce(quality, -1)::INTEGER AS quality, coalesce(toxic, 0)::INTEGER AS toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def q12_left_default(spark, d):
    labels = _t(spark, d, "labels").withColumn("labelled", F.lit(True))
    return _t(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


_W = r"[\p{L}\p{M}\p{N}_]"
_SPANS = rf"""
WITH t AS (SELECT doc_id, text AS raw, {_COLLAPSED} AS body FROM documents), b AS (SELECT item_id, {_COLLAPSED} AS passage FROM benchmark),
hit AS (SELECT doc_id, item_id, raw, body, passage, list_filter(range(1, length(body) - length(passage) + 2), lambda i: body[i:i + length(passage) - 1] = passage) AS places
  FROM t JOIN b ON passage <> '' AND contains(body, passage)),
ok AS (SELECT *, list_filter(places, lambda i:
    NOT (regexp_matches(body[greatest(i - 2, 1):i - 1], '{_W}$') AND regexp_matches(body[i:i + 1], '^(?:{_W}|[.,]{_W})'))
    AND NOT (regexp_matches(body[greatest(i - 2, 1):i - 1], '{_W}[.,]$') AND regexp_matches(body[i:i + 1], '^{_W}'))
    AND NOT (regexp_matches(body[i + length(passage) - 2:i + length(passage) - 1], '{_W}$') AND regexp_matches(body[i + length(passage):i + length(passage) + 1], '^(?:{_W}|[.,]{_W})'))
    AND NOT (regexp_matches(body[i + length(passage) - 2:i + length(passage) - 1], '{_W}[.,]$') AND regexp_matches(body[i + length(passage):i + length(passage) + 1], '^{_W}'))) AS good FROM hit),
found AS (SELECT doc_id, item_id, raw, body, passage, good[1] - 1 AS start FROM ok WHERE len(good) > 0)
"""


def _span_pairs(spark: SparkSession, d: str) -> DataFrame:
    texts = _t(spark, d, "documents").select("doc_id", "text", X.collapse(F.col("text")).alias("body"))
    wanted = _t(spark, d, "benchmark").select("item_id", X.collapse(F.col("text")).alias("passage"))
    return spans.contained(texts, wanted, "body", "passage", "doc_id")


@query(_SPANS + "SELECT doc_id, item_id, start::INTEGER AS start FROM found")
def q13_span_find(spark, d):
    return _span_pairs(spark, d).select("doc_id", "item_id", "start")


_LINED = (
    _SPANS
    + rf"""
, lined AS (SELECT *, list_transform(string_split(raw, chr(10)), lambda s: len(list_filter(regexp_split_to_array(s, '{_WS}'), lambda w: w <> ''))) AS counts,
    length(body[1:start]) - length(replace(body[1:start], ' ', '')) AS w1, length(body[1:start + length(passage) - 1]) - length(replace(body[1:start + length(passage) - 1], ' ', '')) AS w2 FROM found),
placed AS (SELECT doc_id, item_id, passage,
    list_filter(range(1, len(counts) + 1), lambda i: list_sum(counts[1:i]) > w1)[1]::INTEGER AS first_line, list_filter(range(1, len(counts) + 1), lambda i: list_sum(counts[1:i]) > w2)[1]::INTEGER AS last_line FROM lined)
"""
)


def _located(spark: SparkSession, d: str) -> DataFrame:
    pairs = _span_pairs(spark, d)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("text"), F.format_string("line %d", i + 1).alias("position")))
    found = F.substring("body", F.lit(1), F.col("start"))
    return spans.find_spans(pairs.select("doc_id", "item_id", lines.alias("lines"), F.col("passage").alias("span"), "body", "start"), found=found).drop("lines", "body", "start")


@query(_LINED + "SELECT doc_id, item_id, first_line, last_line, md5(passage) AS span_digest FROM placed")
def q14_span_lines(spark, d):
    return _located(spark, d).select("doc_id", "item_id", "match.first_line", "match.last_line", F.md5(F.col("match.text").cast("binary")).alias("span_digest"))


#: Folding in SQL's own functions, for the letters that the test tables hold.
_FOLD = "translate(lower(strip_accents({})), 'øđłð', 'odld')"


@query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded, length(text) AS n FROM documents")
def q15_fold(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(X.fold(F.col("text")).cast("binary")).alias("folded"), F.length("text").cast("long").alias("n"))


@query(r"""
SELECT doc_id, md5(regexp_replace(text, '(^|[^[:alnum:]_])(example)\b', '\1[X]', 'g')) AS text, len(regexp_extract_all(text, '(?:^|[^[:alnum:]_])example\b'))::BIGINT AS mails, regexp_matches(text, '\+?[0-9][0-9 ]{8,}[0-9]') AS phone_like
FROM documents
""")
def q16_redact_email_phone(spark, d):
    """A word taken out of every text by the deletion's own places and replacement; phone-like numbers noted."""
    return _redacted(spark, d, [(r"\bexample\b", False)], "[X]", False)


def _redacted(spark, d, forms, placeholder, folds):
    docs = _t(spark, d, "documents").select("doc_id", "text").withColumn("e", deletion.rewriter(forms, placeholder, folds)(F.array("text")))
    new, n = F.coalesce(F.try_element_at("e", F.lit(1))["text"], "text"), F.coalesce(F.try_element_at("e", F.lit(1))["n"], F.lit(0).cast("long"))
    return docs.select("doc_id", F.md5(new.cast("binary")).alias("text"), n.alias("mails"), F.col("text").rlike(X.PHONE).alias("phone_like"))


def _ranges(chars) -> str:
    """Inside of a character class for RE2."""
    out, codes = [], sorted(map(ord, chars))
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def _overlaps_sql() -> str:
    """The rule of q45 over composed texts: a form's letters are all that fold to them, words end where folded characters aren't letters, numbers or "_".

    Each form takes what earlier ones left: hits become a mark that counts as part of a word (U+10FFFE) or not (U+10FFFF).
    Neighbours may share the character between them, so the word is looked for twice.
    """
    folds = dict(zip(*X.fold_table(), strict=True))
    of: dict[str, list[str]] = {}
    for c, f in folds.items():
        of.setdefault(f, []).append(c)
    letter = lambda f, kept=lambda c: True: f"[{_ranges(c for c in [*([] if f in folds else [f]), *of.get(f, ())] if kept(c))}]"
    word = lambda c: c.isalnum() or c == "_"
    own = lambda c: unicodedata.category(c)[0] in "LN" or c == "_"
    more, less = [c for c, f in folds.items() if word(f) and not own(c)], [c for c, f in folds.items() if own(c) and not word(f)]
    none = rf"(?:[^\p{{L}}\p{{N}}_\x{{10fffe}}{_ranges(more)}]" + (f"|[{_ranges(less)}])" if less else ")")
    digit = f"[{_ranges([*'0123456789', *(c for d in '0123456789' for c in of.get(d, ()))])}]"
    spelt = lambda w: "".join(digit if c == "#" else letter(c) for c in w)
    thou = letter("t", lambda c: unicodedata.category(c) == "Lu") + spelt("hou")
    first = f"regexp_replace(regexp_replace(plain, '{spelt('mail#.example')}', chr(1114110), 'g'), '{spelt('example.com')}', chr(1114110), 'g')"
    lone = lambda s: rf"regexp_replace({s}, '(^|{none}){thou}($|{none})', '\1' || chr(1114111) || '\2', 'g')"
    return rf"""
WITH p AS (SELECT doc_id, text, nfc_normalize(text) AS plain FROM documents), f AS (SELECT *, {first} AS a FROM p), l AS (SELECT *, {lone(lone('a'))} AS b FROM f),
n AS (SELECT *, replace(replace(b, chr(1114110), ''), chr(1114111), '') AS rest FROM l)
SELECT doc_id, md5(CASE WHEN rest = b THEN text ELSE replace(replace(b, chr(1114110), '[X]'), chr(1114111), '[X]') END) AS text, coalesce(length(b) - length(rest), 0)::BIGINT AS mails, regexp_matches(text, '\+?[0-9][0-9 ]{{8,}}[0-9]') AS phone_like
FROM n
"""


@query(_overlaps_sql())
def q45_redact_overlaps(spark, d):
    """Three forms on folded texts, two of which overlap (the earlier form counts) and one of which must begin with a capital."""
    return _redacted(spark, d, [(r"mail[0-9]\.example", False), (r"example\.com", False), (r"\bthou\b", True)], "[X]", True)


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, n_name, r_name, CASE WHEN c_custkey % 3 = 0 THEN upper(n_name) || '@Example.com ' END AS mail, CASE WHEN c_custkey % 2 = 0 THEN ' ' || lower(n_name) ELSE 'nobody' END AS called
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN n_name ELSE called END AS person_name, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN r_name ELSE 'Unknown' END AS person_org,
       c_custkey % 3 = 0 OR c_custkey % 2 = 0 AS person_resolved FROM c
""")
def q17_registry_join(spark, d):
    nations = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    registry = nations.select(F.format_string("n%02d", "n_nationkey").alias("canonical_id"), F.col("n_name").alias("name"), F.col("r_name").alias("org"), F.array(F.concat(F.lower("n_name"), F.lit("@example.com"))).alias("emails"))
    named = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = named.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.upper("n_name"), F.lit("@Example.com "))).alias("mail"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise("nobody").alias("called"))
    return people.resolved(asked, registry, "mail", "called").select("c_custkey", "person_name", "person_org", "person_resolved")


_PAIRS = rf"""
WITH w AS (SELECT doc_id, regexp_split_to_array(text, '{_WS}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM w),
q AS (SELECT doc_id, i, regexp_extract(w[i], '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(\p{{L}}+)$', 1) AS a, regexp_extract(w[i + 1], '^(\p{{L}}+)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])', 1) AS b FROM p),
pairs AS (SELECT doc_id, a, b FROM q WHERE regexp_matches(a, '^\p{{Lu}}') AND regexp_matches(b, '^\p{{Lu}}'))
"""


@query(_PAIRS + "SELECT a AS first, b AS last, count(*) AS n, count(DISTINCT doc_id) AS docs FROM pairs GROUP BY ALL")
def q18_name_pairs(spark, d):
    pairs = _t(spark, d, "documents").select("doc_id", F.explode(X.name_pairs(F.col("text"))).alias("p")).select("doc_id", "p.*")
    return pairs.groupBy("first", "last", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("first", "last").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(
    _PAIRS
    + rf"""
, keys AS (SELECT DISTINCT {_FOLD.format('a')} AS a, {_FOLD.format('b')} AS b FROM pairs),
t AS (SELECT doc_id, ' ' || {_FOLD.format('text')} || ' ' AS folded FROM documents)
SELECT a || ' ' || b AS key, count(*) AS evidence FROM keys JOIN t ON contains(folded, a) AND contains(folded, b) AND regexp_matches(folded, '[^\p{{L}}\p{{M}}\p{{N}}_]' || a || '{_WS}' || b || '[^\p{{L}}\p{{M}}\p{{N}}_]')
GROUP BY ALL ORDER BY evidence DESC, key LIMIT 20
"""
)
def q19_evidence_topk(spark, d):
    # A file may be a single split; texts are dealt out once for keys and evidence.
    docs = _t(spark, d, "documents").select("doc_id", "text")
    docs = _dealt(docs, "doc_id", _chars(docs))
    raw = docs.select(F.explode(X.name_pairs(F.col("text"))).alias("p")).select(F.concat_ws(" ", "p.first", "p.last").alias("raw")).distinct()
    keys = settled(raw.select(X.fold(F.col("raw")).alias("key")).distinct())
    keys = F.broadcast(keys) if keys.count() <= FEW_KEYS else keys
    # A whole name is two neighbouring words of the folded text, whatever their case was.
    folded = docs.select(X.fold(F.col("text")).alias("folded"))
    seen = folded.select(F.explode(X.neighbours(F.col("folded"))).alias("key"))
    hits = seen.join(keys, "key").groupBy("key").agg(F.count(F.lit(1)).alias("evidence"))
    return hits.select("key", "evidence").orderBy(F.desc("evidence"), "key").limit(20)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS seen FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1
""")
def q20_mode_first_seen(spark, d):
    return sequences.most_common_first_seen(_t(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("""
SELECT 'text' AS what, doc_id AS id, n_chars AS declared, length(text) AS found, n_chars = length(text) AS ok FROM documents
UNION ALL SELECT 'lines', o_orderkey, max(l_linenumber), count(l_linenumber), max(l_linenumber) IS NOT DISTINCT FROM count(l_linenumber) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def q21_declared_vs_found(spark, d):
    texts = _t(spark, d, "documents").select(F.lit("text").alias("what"), F.col("doc_id").alias("id"), F.col("n_chars").alias("declared"), F.length("text").cast("long").alias("found"))
    counts = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("declared"), F.count(F.lit(1)).alias("found"))
    lines = _t(spark, d, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.lit("lines").alias("what"), F.col("o_orderkey").alias("id"), "declared", F.coalesce("found", F.lit(0)).alias("found"))
    return texts.unionByName(lines).withColumn("ok", F.col("declared").eqNullSafe(F.col("found")))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def q22_empty_docs(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT o_orderkey, lang, o_orderdate::DATE::VARCHAR AS sent FROM orders, (VALUES ('en'), ('de'), ('sv')) l(lang)")
def q23_multilocale_dates(spark, d):
    month = lambda lang: F.element_at(F.array(*[F.lit(name) for name in X.MONTHS[lang]]), F.month("o_orderdate"))
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    forms = {
        "en": F.concat(F.lit("Monday, "), month("en"), F.lit(" "), day, F.lit(", "), year, F.lit(" 10:15 AM")),
        "de": F.concat(F.lit("Montag, "), day, F.lit(". "), month("de"), F.lit(" "), year, F.lit(" 10:15")),
        "sv": F.concat(F.lit("den "), day, F.lit(" "), month("sv"), F.lit(" "), year, F.lit(" 10:15")),
    }
    rows = _t(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("lang"), v.alias("raw")) for k, v in forms.items()])).alias("x"))
    return rows.select("o_orderkey", "x.lang", X.mail_date(F.col("x.raw")).cast("string").alias("sent"))


_DOUBLED = "CASE WHEN l_linenumber = 3 THEN a || ':00' || a ELSE a || a END"


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT || ':' || lpad((l_partkey % 60)::VARCHAR, 2, '0') AS a FROM lineitem), s AS (SELECT *, {_DOUBLED} AS s FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, s, length(s) % 2 = 0 AND left(s, length(s) // 2) = right(s, length(s) // 2) AND regexp_matches(left(s, length(s) // 2), '^\\d+:\\d{{2}}(:\\d{{2}})?$') AS doubled FROM s
""")
def q24_doubled_time(spark, d):
    a = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(":"), F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0"))
    rows = _t(spark, d, "lineitem").withColumn("a", a).withColumn("s", F.when(F.col("l_linenumber") == 3, F.concat("a", F.lit(":00"), "a")).otherwise(F.concat("a", "a")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "s", X.is_doubled_time(F.col("s")).alias("doubled"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, ((l_linenumber % 3) * 3600 + l_quantity::BIGINT * 60 + l_partkey % 60)::INTEGER AS seconds FROM lineitem
""")
def q25_elapsed_parse(spark, d):
    hours, minutes, seconds = F.col("l_linenumber") % 3, F.col("l_quantity").cast("long"), F.col("l_partkey") % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))
    text = F.concat_ws(" ", F.lit("Ada Berg"), part(hours, "hour"), part(minutes, "minute"), part(seconds, "second"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.elapsed_seconds(text).alias("seconds"))


@query("""
SELECT c_custkey, c_name AS name, c_mktsegment || ', joins late' AS note FROM customer
UNION ALL SELECT c_custkey, 'Guest ' || c_custkey, '' FROM customer UNION ALL SELECT c_custkey, 'Per Holm', c_mktsegment FROM customer
""")
def q26_paren_split(spark, d):
    text = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(", joins late), Guest "), F.col("c_custkey").cast("string"), F.lit(",Per Holm ("), "c_mktsegment", F.lit(")"))
    return _t(spark, d, "customer").select("c_custkey", F.explode(X.attendees(text)).alias("name", "note"))


@query(f"""
SELECT doc_id, md5(text) AS prose, length(text) AS n_prose, CASE WHEN doc_id % 4 = 0 THEN 'a#1,b#2' ELSE '' END AS ids FROM documents
""")
def q27_split_answer(spark, d):
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, ' ["a#1", "b#2"]\n').when(k == 1, '["a#1", ').when(k == 2, '{"a": 1}').otherwise('["a"] and more')
    raw = _t(spark, d, "documents").withColumn("raw", F.concat("text", F.lit(DELIMITER), tail))
    prose = answers.prose_of(F.col("raw"))
    return raw.select("doc_id", F.md5(prose.cast("binary")).alias("prose"), F.length(prose).cast("long").alias("n_prose"), F.array_join(answers.ids_of(F.col("raw")), ",").alias("ids"))


@query("""
SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(html || ' [12]', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '\\[(\\d+)\\]', '<span class="citation">\\1</span>', 'g')) AS html FROM pages
""")
def q28_html_badges(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(X.answer_html(F.concat("html", F.lit(" [12]"))).cast("binary")).alias("html"))


@query("""
WITH l AS (SELECT doc_id, lang || ' ' || source || ' weekly report' AS s FROM documents) SELECT doc_id, upper(left(s, 1)) || lower(substr(s, 2)) AS label, 'Mar 4, 2025' AS day FROM l
""")
def q29_doc_label(spark, d):
    raw = F.concat("lang", F.lit("-"), "source", F.lit("_Weekly-report-2025-03-04"))
    return _t(spark, d, "documents").select("doc_id", X.document_label(raw).alias("label"), X.date_label(F.right(raw, F.lit(10))).alias("day"))


@query("""
WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY conv_id
""")
def q30_ordered_distinct_people(spark, d):
    return sequences.ordered_distinct(_t(spark, d, "conversations"), ["conv_id"], ["turn"], "role", "roles").select("conv_id", F.array_join("roles", ",").alias("roles"))


@query("SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS topics, count(DISTINCT event_type) AS n FROM events")
def q31_vocab_union(spark, d):
    topics = _t(spark, d, "events").agg(F.sort_array(F.collect_set("event_type")).alias("t"))
    return topics.select(F.array_join("t", ",").alias("topics"), F.size("t").cast("long").alias("n"))


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey)::INTEGER AS marker FROM orders QUALIFY marker <= 5)
SELECT marker, o_orderkey::VARCHAR AS id, o_orderpriority || ' (' || o_orderstatus || ') report on ' || o_orderdate::DATE || ': order ' || o_orderkey || ' [' || marker || '].' AS sentence FROM o
""")
def q32_top5(spark, d):
    rows = _t(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.struct(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("organization")).alias("actor"),
        F.lit("report").alias("speech_act"), F.col("o_orderdate").cast("date").alias("document_date"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("claim"),
    )
    return answers.dummy_sentences(rows, ["o_orderkey"])


@query("SELECT event_id, 'k' AS key, (props->>'$.k')::INTEGER AS value FROM events WHERE props->>'$.k' IS NOT NULL")
def q33_header_kv(spark, d):
    return _t(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value"))


@query("""
WITH t AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b FROM part), fa AS (SELECT a, count(*) AS n FROM t GROUP BY a), fb AS (SELECT b, count(*) AS n FROM t GROUP BY b), fab AS (SELECT a, b, count(*) AS n FROM t GROUP BY ALL)
SELECT p_partkey, fa.n + fb.n - fab.n - 1 AS shared FROM t JOIN fa USING (a) JOIN fb USING (b) JOIN fab USING (a, b)
""")
def q34_shared_names(spark, d):
    t = _t(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("a"), F.substring_index("p_name", " ", -1).alias("b"))
    count = lambda keys, n: t.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    joined = t.join(count(["a"], "na"), "a").join(count(["b"], "nb"), "b").join(count(["a", "b"], "nab"), ["a", "b"])
    return joined.select("p_partkey", (F.col("na") + F.col("nb") - F.col("nab") - 1).alias("shared"))


@query("""
WITH o AS (SELECT o_custkey, coalesce(o_orderdate > lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), false) AS up FROM orders) SELECT o_custkey, NOT bool_or(up) AS ok FROM o GROUP BY o_custkey
""")
def q35_newest_first_check(spark, d):
    return sequences.descending(_t(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderdate")


@query(f"""
WITH l AS ({_LINES}), e AS (SELECT doc_id, min(line_no) FILTER (WHERE regexp_matches(text, '^(?:Licensed under|Released under|This work is licensed)')) AS cut FROM l GROUP BY doc_id)
SELECT l.doc_id, count(*) AS kept, max(line_no) AS last_line FROM l JOIN e USING (doc_id) WHERE cut IS NULL OR line_no < cut GROUP BY l.doc_id
""")
def q36_signature_cut(spark, d):
    lines = lines_of(_t(spark, d, "documents"))
    kept = sequences.cut_at(lines, ["doc_id"], "line_no", F.col("text").rlike("^(?:Licensed under|Released under|This work is licensed)"))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.max("line_no").alias("last_line"))


@query("""
WITH b AS (SELECT role, ((row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 40)::INTEGER AS batch, turn FROM conversations) SELECT role, batch, count(*) AS n, sum(turn)::BIGINT AS turns FROM b GROUP BY ALL
""")
def q37_batches40(spark, d):
    b = sequences.batches(_t(spark, d, "conversations"), ["role"], ["conv_id", "turn"], 40, hot=True)
    return b.groupBy("role", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"))


@query(f"""
SELECT doc_id AS request, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '===CITATION' END) AS streamed,
       ceil(length(text || CASE WHEN doc_id % 2 = 0 THEN '{DELIMITER}["x"]' ELSE '===CITATION' END) / 40)::BIGINT AS chunks FROM documents
""")
def q38_holdback_stream(spark, d):
    reply = F.concat("text", F.when(F.col("doc_id") % 2 == 0, f'{DELIMITER}["x"]').otherwise("===CITATION"))
    cut = F.regexp_extract_all(reply, F.lit(r"(?s)(.{1,40})"), F.lit(1))
    docs = _t(spark, d, "documents")
    # Replies are dealt out whole, before they are cut: the chunks of one are where its window is.
    parts = _dealt(docs, "doc_id", _chars(docs)).select(F.col("doc_id").alias("request"), cut.alias("c")).select("request", F.size("c").alias("n"), F.posexplode("c").alias("seq", "chunk"))
    chunks = parts.select("request", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") + 1 == F.col("n")).alias("last"))
    out = holdback.held_back_batch(chunks, complete=False)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy("request").agg(F.md5(whole.cast("binary")).alias("streamed"), F.count(F.lit(1)).alias("chunks"))


@query("""
SELECT user_id AS request, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS n, event_type AS event, props AS data FROM events
""")
def q39_sse_frames(spark, d):
    frames = _t(spark, d, "events").select(F.col("user_id").alias("request"), "event_id", F.explode(F.array(F.lit(0))).alias("z"), sse.frame(F.col("event_type"), F.col("props")).alias("frame"))
    lines = frames.select("request", "event_id", F.posexplode(F.slice(F.split("frame", "\n"), 1, 3)).alias("p", "text")).withColumn("line_no", F.col("event_id") * 3 + F.col("p"))
    return sse.events(lines)


@query(_LINED + "SELECT doc_id, doc_id || '#' || row_number() OVER (PARTITION BY doc_id ORDER BY first_line, item_id) AS id, item_id, first_line, last_line FROM placed")
def q41_verified_archive(spark, d):
    """The flagship: passages verified in documents, nested per document, flattened with derived ids."""
    found = _located(spark, d).filter("match is not null").select("doc_id", "item_id", "match.first_line", "match.last_line")
    packed = sequences.nested(found, ["doc_id"], ["first_line", "item_id"], ["item_id", "first_line", "last_line"], "statements")
    rows = packed.select("doc_id", F.posexplode("statements").alias("p", "s"))
    return rows.select("doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), (F.col("p") + 1).cast("string")).alias("id"), "s.item_id", "s.first_line", "s.last_line")


# -- sources rendered from the tables, parsed back ----------------------------------------------------


def _as_documents(rows: DataFrame, key: str, doc_type: str) -> DataFrame:
    """Documents (doc_id, text, doc_type) that are given as (key, seq, text): texts in order, one below the other."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(F.col(key).cast("string").alias("doc_id")).agg(whole.alias("text")).withColumn("doc_type", F.lit(doc_type))


def _as_lines(rows: DataFrame, key: str, doc_type: str) -> DataFrame:
    """Lines of ``_as_documents``."""
    return lines_of(_as_documents(rows, key, doc_type), "doc_id", "text", "doc_type")


#: Characters of a rendered mail, about.
MAIL = 300
_HEAD = "Meeting: Planning\nDate: 2025-03-04\nAttendees: Ada Berg (Example Co, joins late), Per Holm\n"


@query(rf"""
WITH c AS (SELECT *, CASE WHEN role = 'user' THEN 'Me' ELSE 'Them' END AS label,
    1 + len(list_filter(string_split(text, chr(10))[2:], lambda s: trim(regexp_replace(s, '{_WS}', ' ', 'g')) <> '')) AS lines FROM conversations),
m AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM c),
u AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::INTEGER AS unit_no FROM m)
SELECT conv_id::VARCHAR AS doc_id, unit_no, min(label) AS label, sum(lines)::INTEGER AS n_lines FROM u GROUP BY conv_id, unit_no
""")
def q42_internal_units(spark, d):
    parsed = units.parse(_as_lines(_labelled_talks(spark, d), "conv_id", "transcript"))
    return parsed.units.select("doc_id", "unit_no", "label", F.size("lines").alias("n_lines"))


def _labelled_talks(spark, d):
    c = _t(spark, d, "conversations")
    said = c.select("conv_id", (F.col("turn") + 1).alias("seq"), F.concat(F.when(F.col("role") == "user", "Me: ").otherwise("Them: "), "text").alias("text"))
    heads = c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit(_HEAD).alias("text"))
    return _talk_rows(heads.union(said), c)


def _talk_rows(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rendered turns dealt out by the id of the meeting that they become."""
    return _dealt(rows.withColumn("conv_id", F.col("conv_id").cast("string")), "conv_id", _chars(conversations, 60))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS unit_no, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey::VARCHAR AS doc_id, unit_no, 'Customer ' || o_custkey AS name, o_orderdate::DATE::VARCHAR AS sent, 2 AS n_lines, 'message ' || unit_no || ' of ' || n AS position FROM o
""")
def q43_thread_units(spark, d):
    parsed = units.parse(_as_lines(_threads(spark, d), "o_custkey", "email"), BANNER)
    return parsed.units.select("doc_id", "unit_no", "name", F.col("sent").cast("string").alias("sent"), F.size("lines").alias("n_lines"), F.col("lines")[0]["position"].alias("position"))


def _by_customer(spark: SparkSession, d: str, prefix: str = "") -> DataFrame:
    """Orders dealt out by ``prefix`` and the text of their customer's number, the id of the thread that they become: one shuffle for windows, threads and lines."""
    o = _t(spark, d, "orders").withColumn("o_custkey", F.concat(F.lit(prefix), F.col("o_custkey").cast("string")))
    return _dealt(o, "o_custkey", MAIL * o.count())


def _threads(spark, d):
    o = _by_customer(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1
    month = F.element_at(F.array(*[F.lit(name) for name in X.MONTHS["en"]]), F.month("o_orderdate"))
    end = F.when(first, F.concat(F.lit("Messages in thread: "), n.cast("string"))).otherwise("Betreff: AW: Order")
    mail = F.concat(
        F.when(first, "Subject: Order\n").otherwise(""), F.lit("From: Customer "), F.col("o_custkey").cast("string"), F.lit(" <c@example.com>\nDate: Monday, "), month, F.lit(" "),
        F.dayofmonth("o_orderdate").cast("string"), F.lit(", "), F.year("o_orderdate").cast("string"), F.lit(" 10:00 AM\nTo: Sales\n"), end, F.lit("\n\n"), F.lit(BANNER + ".\nOne order.\n\nThanks"),
    )
    return o.select("o_custkey", F.col("o_orderkey").alias("seq"), mail.alias("text"))


@query(rf"""
WITH c AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '{_WS}', ' ', 'g')) <> '')) AS lines FROM conversations WHERE trim(regexp_replace(text, '{_WS}', ' ', 'g')) <> '')
SELECT conv_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS unit_no, CASE role WHEN 'user' THEN 'Ada Berg' WHEN 'assistant' THEN 'Per Holm' END AS name,
       CASE WHEN role NOT IN ('user', 'assistant') THEN 'Guest 1' END AS label, lines::INTEGER AS n_lines, (turn + 1) || ' minutes 5 seconds' AS position FROM c
""")
def q44_teams_units(spark, d):
    parsed = units.parse(_as_lines(_talks(spark, d), "conv_id", "transcript"))
    return parsed.units.select("doc_id", "unit_no", "name", "label", F.size("lines").alias("n_lines"), F.col("lines")[0]["position"].alias("position"))


def _talks(spark, d):
    c = _t(spark, d, "conversations")
    who = F.when(F.col("role") == "user", "Ada Berg").when(F.col("role") == "assistant", "Per Holm").otherwise("Guest 1")
    minute = (F.col("turn") + 1).cast("string")
    head = F.concat(who, F.lit("\n"), minute, F.lit(":05"), minute, F.lit(":05\nXY\n"), who, F.lit(" "), minute, F.lit(" minutes 5 seconds\n"))
    heads = c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit(_HEAD).alias("text"))
    return _talk_rows(heads.union(c.select("conv_id", "turn", F.concat(head, "text"))), c)


@query(
    f"""
SELECT doc_id, unit_no, name, label, NULL AS sent, n_lines, position FROM ({SQL["q44_teams_units"]})
UNION ALL SELECT 'thread ' || doc_id, unit_no, name, NULL, sent, n_lines, position FROM ({SQL["q43_thread_units"]})
"""
)
def q53_parse_texts(spark, d):
    """Whole meetings and mail threads parsed by the table function in SQL, joined laterally: no shuffle of its own."""
    parse_units.register(spark)
    mails = _as_documents(_threads(spark, d), "o_custkey", "email").withColumn("doc_id", F.concat(F.lit("thread "), "doc_id"))
    documents = _as_documents(_talks(spark, d), "conv_id", "transcript").unionByName(mails)
    return spark.sql(
        "SELECT d.doc_id, u.unit_no, u.name, u.label, CAST(u.sent AS string) AS sent, size(u.lines) AS n_lines, u.lines[0].position AS position FROM {docs} d, LATERAL parse_units(d.text, d.doc_type, {banner}) u WHERE u.error IS NULL",
        docs=documents, banner=BANNER,
    )


@query(SQL["q42_internal_units"])
def q54_parse_lines(spark, d):
    """Meetings that lie in lines parsed by the table function, a partition a document."""
    found = parse_units.of_lines(_as_lines(_labelled_talks(spark, d), "conv_id", "transcript"))
    return found.filter("error is null").select("doc_id", "unit_no", "label", F.size("lines").alias("n_lines"))


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), c AS (SELECT c_custkey, c_custkey % 7 AS k, coalesce(n, 0) AS n FROM customer LEFT JOIN s ON c_custkey = o_custkey)
SELECT 'Ada Name' || chr(97 + k::INTEGER) AS name, sum(n)::BIGINT AS statements, CASE WHEN k = 3 THEN 'removed' ELSE 'left' END AS outcome,
       CASE WHEN k = 3 THEN 2 * sum(n)::BIGINT END AS replacements, CASE WHEN k = 3 THEN sum(n)::BIGINT END AS changed, CASE WHEN k = 3 THEN sum(n)::BIGINT END AS rewritten FROM c GROUP BY k HAVING sum(n) > 0
""")
def q40_delete_receipt(spark, d):
    """An archive with a document a customer and a statement an order; one of seven people is removed."""
    name = F.concat(F.lit("Ada Name"), F.char(97 + F.col("o_custkey") % 7))
    said = F.struct(F.concat(F.lit("It was "), name, F.lit(".")).alias("claim"), F.lit("report").alias("speech_act"), F.struct(name.alias("name"), F.lit("Example Co").alias("organization")).alias("actor"), F.col("o_orderdate").cast("date").cast("string").alias("statement_date"))
    blocks = _t(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", said.alias("s")))).alias("rows"))
    none = F.array().cast("array<string>")
    stored = blocks.select("id", F.lit("email").alias("type"), F.lit("2025-01-01").alias("date"), none.alias("people"), F.lit("").alias("summary"), F.transform("rows", lambda r: r["s"]).alias("statements"))
    after, receipt = deletion.delete_person(stored, "ADA  NAMED")
    claims = after.select(F.explode("statements").alias("s"))
    new = claims.filter(F.col("s.claim") == F.lit(f"It was {receipt.deleted['placeholder']}.")).count()
    rows = [(c["name"], c["statements"], c["outcome"], *((receipt.deleted["replacements"], receipt.deleted["statements_changed"], new) if c["outcome"] == "removed" else (None,) * 3)) for c in receipt.considered]
    return spark.createDataFrame(rows, "name string, statements long, outcome string, replacements long, changed long, rewritten long")
