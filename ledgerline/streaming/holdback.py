"""Streaming an answer without ever leaking its citation part.

Text is passed on as it comes, but the last characters that might begin a delimiter are held back; after the
delimiter nothing is passed on; at the end the rest goes out if no delimiter came.  Citations are resolved
once, from what stands behind the delimiter of a complete reply.  ``HoldBack`` is the state machine: it holds no more than
a delimiter's length.  ``live`` and ``held_back`` apply it to streams of chunks of many requests.

Both need the RocksDB state store (``use_rocksdb``): state is a value of a few characters a request and a list that is
only appended to, so a micro-batch writes what is new and never the reply so far.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ledgerline.operators import answers
from ledgerline.operators.answers import DELIMITER
from ledgerline.streaming.sse import frame

#: How long a request may be silent, and how long a request that is over is remembered, in milliseconds.
SILENCE, REMEMBERED = 120_000, 3_600_000
SILENT = "The model did not answer: it fell silent."


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that lists and timers need; it holds for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class HoldBack:
    """The text that is held back, whether the delimiter was seen, and what the last chunk had behind it."""

    tail: str = ""
    seen: bool = False
    behind: str = ""

    def feed(self, chunk: str) -> str:
        """Text that may go out after one more chunk."""
        if self.seen:
            self.behind = chunk
            return ""
        text, self.tail, held = self.tail + chunk, "", len(DELIMITER) - 1
        at = text.find(DELIMITER)
        if at >= 0:
            self.seen, self.behind = True, text[at + len(DELIMITER) :]
            return text[:at]
        cut = max(0, len(text) - held)
        self.tail = text[cut:]
        return text[:cut]

    def finish(self) -> str:
        """What is left when the reply is complete."""
        text, self.tail = self.tail, ""
        return text


class _Held(StatefulProcessor):
    """Rows of ``held_back``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state, self.parts = handle.getValueState("held", "tail string, seen boolean"), handle.getListState("parts", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        h, new, out = HoldBack(*(self.state.get() or ())), [], []
        for seq, chunk, last in _in_order(rows, ("seq", "chunk", "last")):
            new.append((chunk,))
            text = h.feed(chunk) + (h.finish() if last else "")
            whole = None
            if last:
                whole = "".join([*(x[0] for x in self.parts.get()), *(x[0] for x in new)])
                self.state.clear()
                self.parts.clear()
                new, h = [], HoldBack()
            out.append((str(key[0]), seq, text, whole))
        if new:
            self.state.update((h.tail, h.seen))
            self.parts.appendList(new)
        yield pd.DataFrame(out, columns=["request", "seq", "text", "complete"])

    def close(self) -> None:
        pass


class _Live(StatefulProcessor):
    """Events of ``live``."""

    def __init__(self, silence: int, remembered: int):
        self.silence, self.remembered = silence, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state, self.parts = handle.getValueState("held", "tail string, seen boolean, n long"), handle.getListState("parts", "text string")
        self.over = handle.getValueState("over", "n long", self.remembered)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            for _ in rows:
                pass
            return
        known = self.state.get()
        h, n, behind, out, ended = HoldBack(*(known[:2] if known else ())), known[2] if known else 0, [], [], False
        for _, chunk, last, error in _in_order(rows, ("seq", "chunk", "last", "error")):
            if ended:
                break
            failed = isinstance(error, str)
            text = "" if failed else h.feed(chunk) + (h.finish() if last else "")
            if h.seen and not failed and h.behind:
                behind.append((h.behind,))
                h.behind = ""
            if text:
                out.append(("token", json.dumps({"text": text}, ensure_ascii=False)))
            if failed:
                out.append(("error", json.dumps({"message": error}, ensure_ascii=False)))
            elif last:
                out.append(("ids", "".join([*(x[0] for x in self.parts.get()), *(x[0] for x in behind)])))
            ended = failed or bool(last)
        self._forget()
        if ended:
            self._end(n + len(out))
        else:
            self.state.update((h.tail, h.seen, n + len(out)))
            if behind:
                self.parts.appendList(behind)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield _events(key, n, out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        if known:
            self._end(known[2] + 1)
            yield _events(key, known[2], [("error", json.dumps({"message": SILENT}))])

    def _forget(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _end(self, n: int) -> None:
        self.state.clear()
        self.parts.clear()
        self.over.update((n,))

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows by ``seq``; null chunks are empty."""
    whole = pd.concat(list(rows)).sort_values("seq")
    whole["chunk"] = [c if isinstance(c, str) else "" for c in whole["chunk"]]
    return zip(*(whole[c].tolist() for c in columns), strict=True)


def _events(key: tuple, n: int, found: list[tuple[str, str]]) -> pd.DataFrame:
    return pd.DataFrame([(str(key[0]), n + k, *x) for k, x in enumerate(found)], columns=["request", "n", "event", "data"])


def held_back(chunks: DataFrame) -> DataFrame:
    """Tokens of a stream of chunks: (request, seq, chunk, last) to (request, seq, text, complete).

    The request comes out as text.  One row out for each chunk in, in order of ``seq`` within a micro-batch; ``complete`` (the
    whole reply) is set on the last.  Chunks of a request must arrive in order.
    """
    use_rocksdb(chunks.sparkSession)
    return chunks.groupBy("request").transformWithStateInPandas(_Held(), "request string, seq long, text string, complete string", "Append", "None")


def live(chunks: DataFrame, silence: int = SILENCE, remembered: int = REMEMBERED) -> DataFrame:
    """Events of a stream of chunks: (request, seq, chunk, last, error) to (request, n, event, data), n from 0.

    "token" holds text that may be shown; "ids", once and last, what stands behind the delimiter of a complete reply; "error"
    ends a reply whose row has an error, or that was silent for ``silence`` milliseconds.  What comes after the end of a
    request is passed over for ``remembered`` milliseconds.  Chunks of a request must arrive in order.
    """
    use_rocksdb(chunks.sparkSession)
    return chunks.groupBy("request").transformWithStateInPandas(_Live(silence, remembered), "request string, n long, event string, data string", "Append", "ProcessingTime")


def verified_frames(events: DataFrame, statements: DataFrame) -> DataFrame:
    """(request, n, frame) of events of ``live``, for each micro-batch: ids become citations from the statements table, then "done".

    Ids that the table lacks, or that aren't a list, resolve to nothing.
    """
    plain = events.filter("event <> 'ids'").select("request", (F.col("n") * 2).alias("n"), frame(F.col("event"), F.col("data")).alias("frame"))
    asked = events.filter("event = 'ids'").withColumn("ids", answers.ids_of(F.concat(F.lit(DELIMITER), F.col("data")))).select("request", "n", "ids")
    cited = answers.citations(asked.select("request", "ids"), statements, "request")
    fields = ["marker", F.col("id").alias("statement_id"), "document_id", "claim", "actor", "speech_act", "statement_date", "document_date"]
    lists = cited.groupBy("request").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("citations"))
    none = F.array().cast(lists.schema["citations"].dataType)
    ended = asked.join(lists, "request", "left").withColumn("citations", F.coalesce("citations", none))
    citations = ended.select("request", (F.col("n") * 2).alias("n"), frame(F.lit("citations"), F.to_json(F.struct("citations"), {"ignoreNullFields": "false"})).alias("frame"))
    done = ended.select("request", (F.col("n") * 2 + 1).alias("n"), frame(F.lit("done"), F.lit("{}")).alias("frame"))
    return plain.unionByName(citations).unionByName(done)


def held_back_batch(chunks: DataFrame, complete: bool = True) -> DataFrame:
    """The same for a table of chunks, in JVM functions: each row gets the part of the safe text that is new.

    Each row sees its own chunk and the last ones before it that may hold a delimiter's beginning, so the work is in
    proportion to the text; the complete reply is put together once a request, unless ``complete`` is False (then the
    column is left out).
    """
    from pyspark.sql import Window

    by = Window.partitionBy("request").orderBy("seq")
    so_far, held = by.rowsBetween(Window.unboundedPreceding, 0), len(DELIMITER) - 1
    t = chunks.withColumn("_c", F.coalesce("chunk", F.lit(""))).withColumn("_end", F.sum(F.length("_c")).over(so_far))
    # Chunks with text are numbered; the last ``held`` of them have that many characters at least.
    t = t.withColumn("_no", F.sum(F.when(F.col("_c") != "", 1).otherwise(0)).over(so_far))
    near = Window.partitionBy("request").orderBy("_no").rangeBetween(-held, 0)
    t = t.withColumn("_near", F.array_join(F.collect_list("_c").over(near), "")).withColumn("_from", F.col("_end") - F.length("_near"))
    here = F.when(F.contains(F.col("_near"), F.lit(DELIMITER)), F.col("_from") + F.locate(DELIMITER, F.col("_near")) - 1)
    t = t.withColumn("_here", here).withColumn("_at", F.min("_here").over(so_far))
    size = F.when(F.col("_at").isNotNull(), F.col("_at")).when(F.col("last"), F.col("_end")).otherwise(F.greatest(F.lit(0), F.col("_end") - held))
    t = t.withColumn("_size", size).withColumn("_before", F.coalesce(F.lag("_size").over(by), F.lit(0)))
    start, length = (F.col("_before") - F.col("_from") + 1).cast("int"), F.greatest(F.lit(0), F.col("_size") - F.col("_before")).cast("int")
    text = F.when(length > 0, F.substring(F.col("_near"), start, length)).otherwise("")
    if not complete:
        return t.select("request", "seq", text.alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("c"))))
    whole = chunks.groupBy(F.col("request").alias("_request")).agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("_all"))
    out = t.join(whole, t["request"].eqNullSafe(F.col("_request")), "left")
    return out.select("request", "seq", text.alias("text"), F.when(F.col("last"), F.col("_all")).alias("complete"))
