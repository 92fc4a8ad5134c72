"""Candidate statements to verified records, records to the nested file, and back to flat rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions.text import case_folded, collapse, flat, or_else
from ledgerline.operators.sequences import first_failure, first_of, nested, numbered_ids
from ledgerline.operators.spans import find_spans, prepared
from ledgerline.sources.sinks import settled

NOT_STATED = "Not stated"
NO_UNIT, NO_SPAN, NO_CLAIM, DUPLICATE = "unit not in this document", "span not in the unit", "no claim or unknown act or handling", "duplicate"


def asked(prompts: DataFrame, model: Callable[[str, str], list[dict]]) -> DataFrame:
    """Candidates that an injected model returns for prompts (doc_id, prompt); one call a document.

    ``model(doc_id, prompt)`` gives a list of dicts with the fields of a candidate.  A ValueError or OSError
    in a call is one document's failure: that document gets a row with model_seq null and nothing else.
    """
    names = schemas.CANDIDATES.fieldNames()

    def work(frames):
        for frame in frames:
            rows = []
            for doc_id, prompt in zip(frame["doc_id"], frame["prompt"], strict=True):
                try:
                    found = model(doc_id, prompt)
                    rows += [[doc_id, k, *[item.get(n) for n in names[2:]]] for k, item in enumerate(found)]
                except (ValueError, OSError):
                    rows.append([doc_id, None, *[None] * (len(names) - 2)])
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"model_seq": "Int32", "unit": "Int32"})

    return prompts.select("doc_id", "prompt").mapInPandas(work, schemas.CANDIDATES)


def stated(value: Column, context: Column) -> Column:
    """A value, collapsed, if the (flat) context holds it; else null."""
    return F.when((flat(value) != "") & F.contains(context, flat(value)), collapse(value))


def verified(candidates: DataFrame, units: DataFrame, documents: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of candidates.

    The first broken rule names why a candidate is rejected: its unit isn't in the document, its span isn't in
    the unit, it has no claim or an unknown act or handling, or its unit has that very span already.  Ids count
    accepted rows in the model's order.  ``heads`` (doc_id, head) is the header text in which an organisation or
    role may be stated, besides the unit itself.
    """
    held = prepared(units.withColumnRenamed("unit_no", "unit"))
    c = candidates.filter("model_seq is not null").withColumn("claim", F.trim("claim")).join(held, ["doc_id", "unit"], "left")
    c = find_spans(c)
    bad = F.coalesce((F.col("claim") == "") | ~F.col("act").isin(*schemas.ACTS) | ~F.col("handling").isin(*schemas.HANDLING), F.lit(True))
    reason = first_failure([(F.col("lines").isNull(), NO_UNIT), (F.col("match.first_line").isNull(), NO_SPAN), (bad, NO_CLAIM)])
    # Candidates are searched once: without a checkpoint each condition on what was found is pushed below the search, which then runs for each.
    searched = c.withColumn("reason", reason).select("doc_id", "model_seq", "unit", "name", "label", "sent", "claim", "act", "handling", "org", "role", "match", "reason", F.when(F.col("reason").isNull(), F.array_join(F.transform("lines", lambda x: x["text"]), " ")).alias("_said"))
    w = Window.partitionBy("doc_id", "unit", F.col("match.text"), F.col("reason").isNull()).orderBy("model_seq")
    c = settled(searched).withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), DUPLICATE).otherwise(F.col("reason")))
    rejected = c.filter("reason is not null").select("doc_id", "model_seq", "reason")
    kept = numbered_ids(c.filter("reason is null"), "doc_id", ["model_seq"])
    kept = kept.join(documents.select("doc_id", "doc_type", "doc_date"), "doc_id").join(heads.select("doc_id", "head"), "doc_id", "left")
    kept = kept.withColumn("_context", collapse(F.concat(F.coalesce("head", F.lit("")), "_said"))).withColumn("_context", case_folded(F.col("_context")))
    actor = F.struct("name", "label", stated(F.col("org"), F.col("_context")).alias("org"), stated(F.col("role"), F.col("_context")).alias("role"))
    records = kept.select(
        "id", "doc_id", "doc_type", "doc_date", F.coalesce(F.col("sent").cast("string"), "doc_date").alias("stated_on"),
        F.col("match.position").alias("position"), F.col("match.first_line").alias("first_line"), F.col("match.last_line").alias("last_line"), F.col("match.text").alias("span"),
        "claim", "act", "handling", actor.alias("actor"), F.array().cast(schemas.RECORDS["agreed_by"].dataType).alias("agreed_by"),
    )
    return records, rejected


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """How many candidates of each document were rejected for each reason."""
    return rejected.groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def persisted(records: DataFrame) -> DataFrame:
    """Records in the four fields that the file keeps, with doc_id and order.

    The actor's name falls back on the label, then on "Unknown speaker"; empty strings fall through as well.
    """
    a = F.col("actor")
    actor = F.struct(or_else(a["name"], a["label"], F.lit("Unknown speaker")).alias("name"), or_else(a["org"], F.lit(NOT_STATED)).alias("organization"))
    order = F.element_at(F.split("id", "#"), -1).cast("int")
    return records.select("doc_id", order.alias("seq"), "claim", F.col("act").alias("speech_act"), actor.alias("actor"), F.col("stated_on").alias("statement_date"))


def blocks(records: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a document as the file stores it: id, type, date, people, summary, statements in order."""
    some = nested(persisted(records), ["doc_id"], ["seq"], ["claim", "speech_act", "actor", "statement_date"], "statements")
    none = F.array().cast(f"array<{schemas.STATEMENT}>")
    return documents.join(some, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("doc_type").alias("type"), F.col("doc_date").alias("date"), F.map_keys("attendees").alias("people"), "summary", F.coalesce("statements", none).alias("statements")
    )


def without_statements(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents that no record comes from."""
    return documents.join(records.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")


def flattened(blocks_: DataFrame) -> DataFrame:
    """Statements of blocks as flat rows with derived ids "<document>#<place from 1>"; of one id twice the last block's row counts.

    Dates without time are read as midnight.  ``people`` and ``summary`` may be missing: [] and "".
    """
    order = [c for c in ("block_no",) if c in blocks_.columns]
    rows = blocks_.select(*order, F.col("id").alias("document_id"), F.col("date").cast("date").alias("document_date"), F.posexplode("statements").alias("_p", "s"))
    out = rows.select(
        *order, F.concat_ws("#", "document_id", (F.col("_p") + 1).cast("string")).alias("id"), (F.col("_p") + 1).alias("seq"), "document_id", "document_date",
        "s.claim", "s.speech_act", "s.actor", F.col("s.statement_date").cast("timestamp_ntz").alias("statement_date"),
    )
    return first_of(out, ["id"], [F.desc("block_no")]).drop("block_no") if order else out


def checked_acts(statements: DataFrame) -> DataFrame:
    """Statements; raises when one has an unknown act or lacks a field that must be there."""
    ok = F.col("speech_act").isin(*schemas.ACTS) & F.col("claim").isNotNull() & F.col("actor.name").isNotNull() & F.col("actor.organization").isNotNull() & F.col("statement_date").isNotNull() & F.col("document_date").isNotNull()
    return statements.filter(F.coalesce(ok, F.lit(False)) | F.raise_error(F.concat(F.lit("invalid statement "), F.coalesce("id", F.lit("without id")))).cast("boolean"))
