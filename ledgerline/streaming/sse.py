"""Server-sent events: frames out, frames in, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(event: Column, payload: Column) -> Column:
    """Wire form of one event; the payload is JSON."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))


def tokens(prose: Column) -> Column:
    """Words of a text, each with the white space after it."""
    return F.regexp_extract_all(prose, F.lit(r"(\S+\s*)"), F.lit(1))


def events(lines: DataFrame, by: str = "request", order: str = "line_no", text: str = "text") -> DataFrame:
    """(by, n, event, data) of lines: an event is what stands between blank lines, its data lines joined; without an event line there is none."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = lines.withColumn("_n", F.coalesce(F.sum((F.col(text) == "").cast("int")).over(w), F.lit(0)))
    value = lambda name: F.trim(F.substring(F.col(text), F.lit(len(name) + 1), F.length(text)))
    kind, data = F.startswith(F.col(text), F.lit("event:")), F.startswith(F.col(text), F.lit("data:"))
    grouped = t.groupBy(by, "_n").agg(
        F.max_by(F.when(kind, value("event:")), F.when(kind, F.col(order))).alias("event"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(data, F.struct(F.col(order).alias("o"), value("data:").alias("v"))))), lambda x: x["v"]), "\n").alias("data"),
    )
    return grouped.filter("event is not null").withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("_n"))).select(by, "n", "event", "data")


def folded(events_: DataFrame, by: str = "request") -> DataFrame:
    """(by, answer, citations, error) of events: token texts in order, the last citations, the last error; data that isn't JSON is passed over."""
    e = events_.withColumn("_ok", (F.col("data") == "") | F.try_parse_json("data").isNotNull()).filter("_ok")
    token, cited, failed = (F.col("event") == n for n in ("token", "citations", "error"))
    return e.groupBy(by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(token, F.struct("n", F.coalesce(F.get_json_object("data", "$.text"), F.lit("")).alias("t"))))), lambda x: x["t"]), "").alias("answer"),
        F.max_by(F.when(cited, F.coalesce(F.get_json_object("data", "$.citations"), F.lit("[]"))), F.when(cited, F.col("n"))).alias("citations"),
        F.max_by(F.when(failed, F.coalesce(F.get_json_object("data", "$.message"), F.lit("The model did not answer."))), F.when(failed, F.col("n"))).alias("error"),
    )


def answer_events(tokens_: DataFrame, citations: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(request, n, frame) of a reply: its tokens, then once its citations and "done"; a reply that failed ends with "error" instead.

    tokens: (request, seq, text); citations: (request, json); errors: (request, message).
    """
    token = tokens_.filter("text <> ''").select("request", F.lit(1).alias("stage"), "seq", frame(F.lit("token"), F.to_json(F.struct("text"))).alias("frame"))
    none = F.lit(0).cast("long")
    ends = citations if errors is None else citations.join(errors, "request", "left_anti")
    cited = ends.select("request", F.lit(2).alias("stage"), none.alias("seq"), frame(F.lit("citations"), F.concat(F.lit('{"citations":'), F.col("json"), F.lit("}"))).alias("frame"))
    done = ends.select("request", F.lit(3).alias("stage"), none.alias("seq"), frame(F.lit("done"), F.lit("{}")).alias("frame"))
    out = token.unionByName(cited).unionByName(done)
    if errors is not None:
        out = out.unionByName(errors.select("request", F.lit(4).alias("stage"), none.alias("seq"), frame(F.lit("error"), F.to_json(F.struct("message"))).alias("frame")))
    return out.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("stage", "seq"))).select("request", "n", "frame")
