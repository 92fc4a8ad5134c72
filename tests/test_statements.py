import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import answers, links, sequences, spans, statements, units
from ledgerline.schemas import CANDIDATES, REPLIES
from tests.test_units import TALK, parsed


def test_spans(spark):
    lines = [(3, "costs 3.4 million,  of", "p1"), (5, "which 1,200 are  café", "p2")]
    cases = [("3.4 million, of which", (3, 5)), ("3", None), ("4 million", None), ("café", (5, 5)), ("", None), ("200", None), (" of  which ", (3, 5)), (None, None), ("illion", None)]
    df = spark.createDataFrame([(i, [dict(zip(("no", "text", "position"), x)) for x in lines], s) for i, (s, _) in enumerate(cases)], "i int, lines array<struct<no:int,text:string,position:string>>, span string")
    got = [r["match"] for r in spans.find_spans(df).orderBy("i").collect()]
    assert [(m["first_line"], m["last_line"]) if m and m["first_line"] else None for m in got] == [w for _, w in cases]
    assert got[0]["text"] == "3.4 million, of which" and got[0]["position"] == "p1"


@pytest.mark.parametrize("chars", [spans.AUTOMATON_CHARS, 0])
def test_contained_needs_whole_tokens(spark, chars):
    texts = spark.createDataFrame([(1, "it costs 3.4 and 3 more"), (2, "13 or 3.5"), (3, "... dots"), (4, None)], "id int, t string")
    items = spark.createDataFrame([("3",), ("3.4 and",), ("...",), ("zz",), ("",), (None,)], "w string")
    got = {(r["id"], r["w"], r["start"]) for r in spans.contained(texts, items, "t", "w", "id", chars).collect()}
    assert got == {(1, "3", 17), (1, "3.4 and", 9), (3, "...", 0)}


@pytest.mark.parametrize("chars", [spans.AUTOMATON_CHARS, 0])
def test_contained_in_odd_tables(spark, chars):
    """Repeated texts and items stay repeated, other columns stay, empty tables give no rows, long texts are read whole."""
    far = "x " * 200_000 + "the end"
    texts = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (2, far, "m"), (3, "", "e"), (None, "b", "n")], "id int, t string, _more string")
    items = spark.createDataFrame([("b", 7), ("b", 8), ("the end", 9), ("he", 10), ("\U0001d7d8", 11)], "w string, no int")
    rows = lambda t, i: sorted((r["id"] or 9, r["w"], r["no"], r["start"], r["_more"]) for r in spans.contained(t, i, "t", "w", "id", chars).collect())
    assert rows(texts, items) == [(1, "b", 7, 2, "k")] * 2 + [(1, "b", 8, 2, "k")] * 2 + [(2, "the end", 9, 400_000, "m"), (9, "b", 7, 0, "n"), (9, "b", 8, 0, "n")]
    assert rows(texts.limit(0), items) == [] == rows(texts, items.limit(0))


def pick(seq, unit, span, claim="C.", act="report", org=None, role=None, handling="none"):
    return ("t", seq, unit, span, claim, act, org, role, handling)


def verified(spark, *rows):
    p = parsed(spark, ("t", "transcript", TALK))
    heads = units.rendered(p.units, p.documents)
    return statements.verified(spark.createDataFrame(list(rows), CANDIDATES), p.units, p.documents, heads), p


def test_records(spark):
    (records, rejected), p = verified(
        spark,
        pick(0, 1, "move the launch", act="proposal", org="example  co", role="Queen"),
        pick(1, 9, "x"),
        pick(2, 1, "never said"),
        pick(3, 1, "We should", act="shout"),
        pick(4, 1, "We should", claim="  "),
        pick(5, 1, "move  the launch"),
        pick(6, 2, "in 30 seconds or a bit more."),
        pick(7, 3, "roughly"),
    )
    got = records.orderBy("id").collect()
    assert [(r["id"], r["span"], r["position"], r["first_line"], r["last_line"], r["stated_on"]) for r in got] == [
        ("t#1", "move the launch", "5 seconds", 12, 12, "2025-03-04"),
        ("t#2", "in 30 seconds or a bit more.", "1 minute 10 seconds", 17, 19, "2025-03-04"),
        ("t#3", "roughly", "2 minutes", 24, 24, "2025-03-04"),
    ]
    assert got[0]["actor"].asDict() == {"name": "Ada Berg", "label": None, "org": "example co", "role": None}
    assert {(r["model_seq"], r["reason"]) for r in rejected.collect()} == {(1, statements.NO_UNIT), (2, statements.NO_SPAN), (3, statements.NO_CLAIM), (4, statements.NO_CLAIM), (5, statements.DUPLICATE)}
    assert {(r["reason"], r["n"]) for r in statements.rejected_counts(rejected).collect()} >= {(statements.NO_CLAIM, 2)}
    blocks = statements.blocks(records, p.documents)
    b = blocks.first()
    assert b["people"] == ["Ada Berg", "Per Holm"] and [s["actor"]["name"] for s in b["statements"]] == ["Ada Berg", "Per Holm", "Guest 1"]
    assert b["statements"][1]["actor"]["organization"] == statements.NOT_STATED
    flat = statements.flattened(blocks).orderBy("seq").collect()
    assert [r["id"] for r in flat] == ["t#1", "t#2", "t#3"] and str(flat[0]["statement_date"]) == "2025-03-04 00:00:00"
    assert statements.without_statements(p.documents, records.limit(0)).count() == 1


def test_candidates_are_searched_once(spark):
    """Neither records nor rejected candidates run the search again, whatever is asked of them."""
    (records, rejected), _ = verified(spark, pick(0, 1, "move the launch"), pick(1, 1, "never said"), pick(2, 1, "move  the\u00a0launch"))
    for found in (records, rejected, rejected.filter("reason = 'duplicate'")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan
    assert [(r["model_seq"], r["reason"]) for r in rejected.orderBy("model_seq").collect()] == [(1, statements.NO_SPAN), (2, statements.DUPLICATE)]


def test_every_unit_holds_itself(spark):
    p = parsed(spark, ("t", "transcript", TALK))
    from pyspark.sql import functions as F

    own = p.units.withColumn("span", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    assert own.count() == spans.find_spans(own).filter("match.first_line = lines[0].no").count() == 3


def test_model_is_asked_once_a_document_and_may_fail(spark):
    prompts = spark.createDataFrame([("a", "A"), ("b", "B")], "doc_id string, prompt string")

    def model(doc_id, prompt):
        if doc_id == "b":
            raise ValueError("broken answer")
        return [{"unit": 1, "span": prompt, "claim": "c", "act": "report", "handling": "none"}]

    got = {(r["doc_id"], r["model_seq"], r["span"]) for r in statements.asked(prompts, model).collect()}
    assert got == {("a", 0, "A"), ("b", None, None)}


def linkable(spark):
    def row(i, doc, line, who, act, span, kind="transcript", position="p"):
        return (f"{doc}#{i}", doc, kind, "2025-01-01", "2025-01-01", position, line, line, span, "c", act, "none", (who, None, None, None), [])

    from ledgerline.schemas import RECORDS

    talk = [row(1, "d", 1, "A", "proposal", "let us go")] + [row(k, "d", k, "A" if k % 2 else "B", "report", f"word {k}") for k in range(2, 25)]
    mail = [row(1, "m", 5, "B", "agreement", "I agree", "email", "message 1 of 2"), row(2, "m", 30, "A", "proposal", "shall we", "email", "message 2 of 2")]
    return spark.createDataFrame(talk + mail, RECORDS)


def test_look_ahead(spark):
    later = links.later_by_others(linkable(spark)).orderBy("doc_id", "place").collect()
    assert [(r["later_id"]) for r in later] == [f"d#{k}" for k in range(2, 17, 2)] + ["m#1"]


@pytest.mark.parametrize(
    "response,by,quote,outcome",
    [("accepted", "B", "WORD  4", "accepted"), ("rejected", "B", "word 4", "rejected"), ("none", "B", "word 4", "no response"), ("accepted", "A", "word 4", "response not found in the text"), ("accepted", "B", "", "response not found in the text"), ("accepted", "B", "word 18", "response not found in the text")],
)
def test_links(spark, response, by, quote, outcome):
    records, outcomes = links.linked(linkable(spark), spark.createDataFrame([("d", "d#1", response, by, quote)], REPLIES))
    assert [tuple(r) for r in outcomes.collect()] == [("d", "d#1", outcome)]
    agreed = records.filter("id = 'd#1'").first()["agreed_by"]
    assert [a["statement"] for a in agreed] == (["d#4"] if outcome == "accepted" else [])
    assert records.count() == 26


def test_replies_from_a_model(spark):
    replies = links.asked_for_replies(linkable(spark), lambda span, shown: {"response": "accepted", "by": shown[0]["who"], "quote": shown[0]["span"]})
    _, outcomes = links.linked(linkable(spark), replies)
    assert {(r["outcome"], r["n"]) for r in links.outcome_counts(outcomes).collect()} == {("accepted", 1)} and outcomes.count() == 2


def look_ahead_joined(df, by, order, who, only, limit):
    """The look-ahead by a join and a ranking, to compare with."""
    left = df.filter(only).select(*by, F.col(order), F.col(who).alias("_w"))
    right = df.select(*by, F.col(order).alias(f"later_{order}"), F.col(who).alias("_v"))
    near = left.join(right, list(by)).filter((F.col(f"later_{order}") > F.col(order)) & ~F.col("_w").eqNullSafe(F.col("_v")))
    w = Window.partitionBy(*by, order).orderBy(f"later_{order}")
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select(*by, order, f"later_{order}", "place")


def test_joined_look_ahead_is_the_same(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators import sequences

    t = links.timed(linkable(spark))
    args = (["doc_id"], "seq", "who", F.col("act") == "proposal", 8)
    a, b = (f(t, *args) for f in (sequences.look_ahead, look_ahead_joined))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


RAW = [("a ===CITATIONS=== [\"x\", 1, null]", "a ", ["x", "1", "None"]), ('b===CITATIONS===["x"] tail', "b", []), ("c", "c", []), ('d===CITATIONS==={"a":1}', "d", []), ('e===CITATIONS===["x",', "e", []), ("f===CITATIONS===", "f", []), ('g===CITATIONS===[]', "g", [])]


@pytest.mark.parametrize("raw,prose,ids", RAW)
def test_split_answer(spark, raw, prose, ids):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(raw,)], "raw string").select(answers.prose_of(F.col("raw")).alias("p"), answers.ids_of(F.col("raw")).alias("i")).first()
    assert (r["p"], r["i"]) == (prose, ids)


def test_citations_keep_gaps(spark):
    (records, _), p = verified(spark, pick(0, 1, "move the launch"), pick(1, 3, "roughly"))
    flat = statements.checked_acts(statements.flattened(statements.blocks(records, p.documents)))
    prose, cited = answers.answer(flat, "why?", lambda q, payload: 'Because. ===CITATIONS===["t#2","nope","t#1","t#2"]')
    assert prose == "Because." and [(r["marker"], r["id"]) for r in cited.collect()] == [(1, "t#2"), (3, "t#1"), (4, "t#2")]
    prose, cited = answers.answer(flat, "anything")
    assert "Ada Berg (Not stated) report on 2025-03-04: C. [1]." in prose and cited.count() == 2
    assert '"document_id":"t"' in answers.payload_json(flat).first()["json"]
    with pytest.raises(Exception, match="invalid statement"):
        from pyspark.sql import functions as F

        statements.checked_acts(flat.withColumn("speech_act", F.lit("shout"))).collect()


def test_rows_numbered_in_pieces(spark):
    rows = [(g, o, x) for x, (g, o) in enumerate([("hot", k * 7 % 300) for k in range(300)] + [(None, 3), (None, None), ("one", 5), ("hot", None)])]
    t = spark.createDataFrame(rows, "g string, o int, x int")
    want = []
    for g in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        want += [(*r, k) for k, r in enumerate(of, 1)]
    for pieces in (1, 5, 64):
        got = sequences.rows_numbered(t, ["g"], ["o"], "n", pieces).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    hot = sequences.batches(t.filter("g = 'hot'"), ["g"], ["o"], 40, hot=True).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in hot} == {**{b: 40 for b in range(7)}, 7: 21}
    assert sequences.rows_numbered(t.limit(0), ["g"], ["o"], "n", 5).collect() == []
