"""The four uses of a language model, through an endpoint: extraction, links, annotation, answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import links, prompts
from ledgerline.sources import models
from ledgerline.sources.models import Endpoint

_STATEMENTS = "statements array<struct<unit:int,span:string,claim:string,act:string,org:string,role:string,handling:string>>"
_RESPONSE = "response string, by string, quote string"


def extracted(prompts_: DataFrame, endpoint: Endpoint, store: str | None = None) -> DataFrame:
    """Candidates (``schemas.CANDIDATES``) that an endpoint finds in prompts (doc_id, prompt); one call a document.

    A document whose call failed, or whose reply has no list of statements, gets a row with model_seq null.
    """
    asked = prompts_.select("doc_id", prompts.messages(prompts.EXTRACTION, F.col("prompt")).alias("messages"))
    got = models.replies(asked, endpoint, prompts.EXTRACTION_SCHEMA, store).withColumn("found", models.parsed(F.col("reply"), _STATEMENTS)["statements"])
    good = got.filter("found is not null").select("doc_id", F.posexplode("found").alias("model_seq", "s")).select("doc_id", "model_seq", *[F.col("s")[n].alias(n) for n in schemas.CANDIDATES.fieldNames()[2:]])
    bad = got.filter("found is null").select("doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CANDIDATES.fields[1:]])
    return good.unionByName(bad)


def replied(records: DataFrame, endpoint: Endpoint, store: str | None = None, limit: int = links.LOOK_AHEAD) -> DataFrame:
    """Replies (``schemas.REPLIES``), one call a proposal or question that something of others follows.

    A call that failed, or whose reply isn't one of the three responses, is the response "call failed".
    """
    later = links.later_by_others(records, limit)
    shown = F.sort_array(F.collect_list(F.struct("place", "later_who", "later_position", "later_stated_on", "later_span")))
    asked = later.groupBy("doc_id", "statement_id").agg(shown.alias("shown"))
    asked = asked.join(records.select(F.col("id").alias("statement_id"), "span", "stated_on", links.who(F.col("actor")).alias("who")), "statement_id")
    question = prompts.link_question(F.col("who"), F.col("stated_on"), F.col("span"), F.col("shown"))
    asked = asked.select("doc_id", "statement_id", prompts.messages(prompts.LINK, question).alias("messages"))
    got = models.replies(asked, endpoint, prompts.LINK_SCHEMA, store).withColumn("r", models.parsed(F.col("reply"), _RESPONSE))
    known = F.coalesce(F.col("r.response").isin(*schemas.RESPONSES), F.lit(False))
    return got.select("doc_id", "statement_id", F.when(known, F.col("r.response")).otherwise(links.FAILED).alias("response"), F.col("r.by").alias("by"), F.col("r.quote").alias("quote"))


def annotator(endpoint: Endpoint, store: str | None = None) -> Callable[..., list[dict]]:
    """A model for ``segments.annotate``; ValueError if the reply has no list of annotations."""

    def model(view: list[dict], topics: list[str], document: dict | None = None) -> list[dict]:
        messages = json.dumps(prompts.annotation_messages(document or {}, view, topics), ensure_ascii=False)
        reply = models.once(endpoint, messages, prompts.ANNOTATION_SCHEMA, store)
        found = json.loads(reply[reply.find("{") : reply.rfind("}") + 1])
        items = found.get("annotations") if isinstance(found, dict) else None
        if not isinstance(items, list):
            raise ValueError("the reply has no annotations")
        ids = {s["segment_id"] for s in view}
        return [x for x in items if isinstance(x, dict) and x.get("segment_id") in ids]

    return model


def answerer(endpoint: Endpoint) -> Callable[[str, list[str]], str]:
    """A model for ``answers.answer``."""
    return lambda question, documents: endpoint.reply(prompts.answer_messages(question, documents))


def streamed(endpoint: Endpoint) -> Callable[[str, list[str]], Iterator[str]]:
    """The same, piece by piece."""
    return lambda question, documents: endpoint.deltas(prompts.answer_messages(question, documents))
