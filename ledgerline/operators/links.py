"""Agreement links: proposals and questions, what others said after them, and verified responses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions.text import flat, or_else
from ledgerline.operators.sequences import first_of, look_ahead

LOOK_AHEAD = 8
LINKABLE = ("proposal", "question")
#: Response and outcome of a statement whose call failed.
FAILED = "call failed"


def who(actor: Column) -> Column:
    """Name, else label, else "unknown"."""
    return or_else(actor["name"], actor["label"], F.lit("unknown"))


def timed(records: DataFrame) -> DataFrame:
    """Records with ``seq``: their place in time within the document.

    Transcripts run by line; threads list the newest message first, so they run by falling message number,
    then by line.
    """
    message = F.element_at(F.split("position", " "), 2).try_cast("int")
    key = F.when(F.col("doc_type") == "transcript", F.lit(0)).otherwise(-message)
    order = F.struct(key.alias("a"), F.col("first_line").alias("b"), F.element_at(F.split("id", "#"), -1).cast("int").alias("c"))
    from pyspark.sql import Window

    return records.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).withColumn("who", who(F.col("actor")))


def later_by_others(records: DataFrame, limit: int = LOOK_AHEAD) -> DataFrame:
    """For each proposal or question: the next statements by other people (doc_id, statement_id, place, later_id, later_who, later_span, later_actor, later_position, later_stated_on)."""
    t = timed(records)
    pairs = look_ahead(t, ["doc_id"], "seq", "who", F.col("act").isin(*LINKABLE), limit)
    left = t.select("doc_id", "seq", F.col("id").alias("statement_id"))
    right = t.select("doc_id", F.col("seq").alias("later_seq"), F.col("id").alias("later_id"), F.col("who").alias("later_who"), F.col("span").alias("later_span"), F.col("actor").alias("later_actor"), F.col("position").alias("later_position"), F.col("stated_on").alias("later_stated_on"))
    return pairs.join(left, ["doc_id", "seq"]).join(right, ["doc_id", "later_seq"]).select("doc_id", "statement_id", "place", "later_id", "later_who", "later_span", "later_actor", "later_position", "later_stated_on")


def linked(records: DataFrame, replies: DataFrame, limit: int = LOOK_AHEAD, shown: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with agreed_by, outcomes) from a model's replies (doc_id, statement_id, response, by, quote).

    A reply counts only if, among the statements shown, the person it names has one that contains the quoted
    words; the first such is the source.  outcomes: doc_id, statement_id and outcome ("no response",
    "response not found in the text", "accepted" or "rejected") of every statement that had something shown.
    ``shown``: what ``later_by_others`` gave, where it is stored; else it is looked up anew for each use.
    """
    shown = later_by_others(records, limit) if shown is None else shown
    asked = shown.select("doc_id", "statement_id").distinct()
    quote = flat(F.col("quote"))
    hits = shown.join(replies, ["doc_id", "statement_id"]).filter((F.col("later_who") == F.col("by")) & (quote != "") & F.contains(flat(F.col("later_span")), quote))
    source = first_of(hits.select("doc_id", "statement_id", "place", "later_id", "later_actor"), ["doc_id", "statement_id"], ["place"])
    judged = asked.join(replies.select("doc_id", "statement_id", "response"), ["doc_id", "statement_id"]).join(source, ["doc_id", "statement_id"], "left")
    outcome = F.when(F.col("response") == FAILED, FAILED).when(F.col("response") == "none", "no response").when(F.col("later_id").isNull(), "response not found in the text").when(F.col("response") == "accepted", "accepted").otherwise("rejected")
    judged = judged.withColumn("outcome", outcome)
    link = F.struct(F.col("later_actor.name").alias("name"), F.col("later_actor.label").alias("label"), F.col("later_actor.org").alias("org"), F.col("later_actor.role").alias("role"), F.col("later_id").alias("statement"))
    agreed = judged.filter("outcome = 'accepted'").groupBy(F.col("statement_id").alias("id")).agg(F.collect_list(link).alias("_agreed"))
    out = records.join(agreed, "id", "left").withColumn("agreed_by", F.concat("agreed_by", F.coalesce("_agreed", F.array().cast(schemas.RECORDS["agreed_by"].dataType)))).select(*records.columns)
    return out, judged.select("doc_id", "statement_id", "outcome")


def asked_for_replies(records: DataFrame, model: Callable[[str, list[dict]], dict], limit: int = LOOK_AHEAD) -> DataFrame:
    """Replies of an injected model, one call a proposal or question that has later statements.

    ``model(span, shown)`` gets the statement's words and the shown statements (who, span) and gives a dict
    with response, by and quote.  A ValueError or OSError in a call is one statement's failure: it stays without a link.
    """
    shown = later_by_others(records, limit)
    rows = shown.groupBy("doc_id", "statement_id").agg(F.sort_array(F.collect_list(F.struct("place", "later_who", "later_span"))).alias("shown"))
    rows = rows.join(records.select(F.col("id").alias("statement_id"), "span"), "statement_id").select("doc_id", "statement_id", "span", "shown")

    def work(frames):
        for frame in frames:
            out = []
            for doc_id, sid, span, later in frame.itertuples(index=False):
                try:
                    answer = model(span, [{"who": x["later_who"], "span": x["later_span"]} for x in later])
                except (ValueError, OSError):
                    answer = {"response": FAILED}
                out.append((doc_id, sid, answer.get("response"), answer.get("by"), answer.get("quote")))
            yield pd.DataFrame(out, columns=schemas.REPLIES.fieldNames())

    return rows.mapInPandas(work, schemas.REPLIES)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """How often each outcome came up in each document."""
    return outcomes.groupBy("doc_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
