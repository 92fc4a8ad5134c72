"""Answers with citations that can only come from the statements table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.sequences import nested

DELIMITER = "===CITATIONS==="
DUMMY_LIMIT = 5


def prose_of(answer: Column) -> Column:
    """What stands before the first delimiter, or all."""
    return F.substring_index(answer, DELIMITER, 1)


def ids_of(answer: Column) -> Column:
    """Ids that an answer cites: the JSON list after the first delimiter; [] if there is none or it isn't a list.

    ``from_json`` would take '["a"] tail' for a list, so the tail must end with its bracket; null elements
    become "None" as text.
    """
    tail = F.trim(F.regexp_replace(F.substring(answer, F.locate(DELIMITER, answer) + len(DELIMITER), F.length(answer)), r"^\s+|\s+$", ""))
    whole = F.contains(answer, F.lit(DELIMITER)) & tail.rlike(r"(?s)^\[.*\]$")
    parsed = F.from_json(tail, "array<string>")
    return F.when(whole, F.coalesce(F.transform(parsed, lambda x: F.coalesce(x, F.lit("None"))), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def citations(answers: DataFrame, statements: DataFrame, key: str, ids: str = "ids", order: str = "id") -> DataFrame:
    """Cited rows of the table: marker is the id's place in the list from 1.

    Ids that the table lacks are dropped without renumbering, so gaps stay; an id cited twice comes twice.
    """
    cited = answers.select(key, F.posexplode(ids).alias("_p", "_id"))
    return cited.join(statements, F.col("_id") == statements[order]).drop("_id").withColumn("marker", F.col("_p") + 1).drop("_p")


def payload(statements: DataFrame) -> DataFrame:
    """Statements regrouped by document (document_id, document_date, statements), as a model is given them."""
    fields = [c for c in statements.columns if c not in ("document_id", "document_date", "seq")]
    return nested(statements, ["document_id", "document_date"], ["seq"], fields, "statements")


def payload_json(statements: DataFrame) -> DataFrame:
    """The payload as one compact JSON string a document; null fields are kept."""
    p = payload(statements)
    return p.select("document_id", F.to_json(F.struct(*p.columns), {"ignoreNullFields": "false"}).alias("json"))


def dummy_sentences(statements: DataFrame, order: list[str], limit: int = DUMMY_LIMIT) -> DataFrame:
    """marker, id and sentence for the first statements: the answer that needs no model."""
    from pyspark.sql import Window

    top = statements.orderBy(*order).limit(limit).withColumn("marker", F.row_number().over(Window.orderBy(*order)))
    sentence = F.format_string("%s (%s) %s on %s: %s [%d].", "actor.name", "actor.organization", "speech_act", F.col("document_date").cast("string"), "claim", "marker")
    return top.select("marker", "id", sentence.alias("sentence"))


def dummy_answer(statements: DataFrame, order: list[str]) -> str:
    """The canned answer, with delimiter and ids as a model would give it."""
    rows = dummy_sentences(statements, order).orderBy("marker").collect()  # DUMMY_LIMIT rows
    if not rows:
        return "The record is empty; there is nothing to cite."
    return "No model was called. " + " ".join(r["sentence"] for r in rows) + DELIMITER + json.dumps([r["id"] for r in rows])


def answer(statements: DataFrame, question: str, model: Callable[[str, list[str]], str] | None = None, order: tuple[str, ...] = ("document_id", "seq")) -> tuple[str, DataFrame]:
    """(prose, citations) for one question; without a model the canned answer.

    ``model(question, payload)`` gets one JSON string a document; the prompt holds the whole table by design,
    so it is collected here.
    """
    spark = statements.sparkSession
    if model is None:
        raw = dummy_answer(statements, list(order))
    else:
        raw = model(question, [r["json"] for r in payload_json(statements).orderBy("document_id").collect()])
    one = spark.createDataFrame([(1, raw)], "q int, raw string").select("q", prose_of(F.col("raw")).alias("prose"), ids_of(F.col("raw")).alias("ids"))
    prose = one.first()["prose"]
    return prose.strip(), citations(one, statements, "q").drop("q").orderBy("marker")
