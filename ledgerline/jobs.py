"""Jobs and their command line: extract, annotate, ask, delete.

    python -m ledgerline.jobs extract [ID PART ...] --archive DIR --out FILE [--model module:function]
    python -m ledgerline.jobs annotate --archive DIR --registry FILE --out-dir DIR [--model module:function] [--dry-run]
    python -m ledgerline.jobs ask QUESTION --statements FILE [--model module:function] [--stream]
    python -m ledgerline.jobs delete NAME --statements FILE [--role NAME=PLACEHOLDER ...] [--dry-run]

A language model is a callable named on the command line, or the endpoint that the settings name.
"""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import importlib
import json
import os
import re
import sys
import threading
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import answers, calls, deletion, links, segments, statements, units
from ledgerline.operators.answers import DELIMITER
from ledgerline.sources import corpus, document_files, models, sinks
from ledgerline.sources.models import Endpoint
from ledgerline.streaming import holdback, ingest

_one_at_a_time = threading.Lock()


@dataclasses.dataclass(frozen=True)
class Settings:
    """Where things are; each field may come from the environment as LEDGERLINE_<FIELD>."""

    statements: str = "statements.json"
    model: str = ""
    base_url: str = "http://localhost:11434/v1"
    api_key: str = ""
    timeout: float = 600.0
    context: int = 32_768
    native: bool = False
    dummy: bool = False
    delay: float = 0.0
    banner: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ if env is None else env)
        yes = lambda v: v.lower() in ("1", "true", "yes")
        kinds = {"timeout": float, "delay": float, "context": int, "dummy": yes, "native": yes}
        return cls(**{f.name: kinds.get(f.name, str)(env[k]) for f in dataclasses.fields(cls) if (k := f"LEDGERLINE_{f.name.upper()}") in env})


    def endpoint(self, native: bool | None = None) -> Endpoint | None:
        """The endpoint that is named; None without a model, or where the dummy is wanted."""
        if not self.model or self.dummy:
            return None
        own = self.native if native is None else native
        return Endpoint(self.base_url, self.model, self.api_key, self.timeout, own, self.context if own else None)


def extract(spark: SparkSession, archive: str, out: str, model: Callable | Endpoint, link_model: Callable | Endpoint | None = None, only: list[str] | None = None, at_a_time: int = 1, banner: str | None = None) -> int:
    """Archive to statements file.  Code 0; 1 if some or all documents gave nothing; 2 if no document matches.

    Documents go through in micro-batches of ``at_a_time`` files; a document's file is in the folder ``documents`` beside
    the target before the next batch is asked for.  A run that was broken off goes on where it stopped: documents that
    are there aren't asked for again, and of the batch that was under way no reply of an endpoint is.  At the end the files
    are put together in the archive's order.  Files, replies and progress go when the target is written; when nothing was
    extracted the files stay.
    """
    docs = corpus.archive(spark, archive, only)
    order = [r["doc_id"] for r in docs.select("doc_id", "doc_seq").orderBy("doc_seq").select("doc_id").toLocalIterator()]
    if not order:
        return 2
    scratch = str(Path(out).parent / "documents") if "://" not in out else out.rpartition("/")[0] + "/documents"
    progress, kept = f"{scratch}/_progress", f"{scratch}/_replies"
    _resumed(scratch, [archive, only or [], _label(model), _label(link_model), at_a_time, banner])

    def handle(arrived: DataFrame, number: int) -> None:
        wanted = arrived if not only else arrived.filter(corpus.contains_any(F.col("doc_id"), only))
        _extracted(wanted, model, link_model, scratch, kept, banner)

    ingest.each_batch(ingest.arriving(spark, archive, at_a_time), handle, progress).awaitTermination()
    code, empty = sinks.commit([document_files.file_of(scratch, d) for d in order], out, scratch)
    for own in ("_progress", "_replies", "_run", "_batch"):
        document_files.removed(f"{scratch}/{own}")
    for doc_id in empty:
        print(f"no statements from {doc_id}", file=sys.stderr)
    return code


def _label(model: Callable | Endpoint | None) -> str:
    if isinstance(model, Endpoint):
        return f"{model.url()} {model.model} {model.context}"
    return "" if model is None else f"{model.__module__}:{getattr(model, '__qualname__', type(model).__name__)}"


def _resumed(scratch: str, about: list) -> None:
    """Drop what a run about something else has left."""
    files, root = models.filesystem(scratch)
    mark = f"{root}/_run/{hashlib.sha256(json.dumps(about).encode()).hexdigest()}.txt"
    if models.get(files, mark) is None:
        document_files.removed(scratch)
        models.put(files, mark, json.dumps(about))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """A table written and read again: what follows starts from it, whatever is lost."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _extracted(docs: DataFrame, model: Callable | Endpoint, link_model: Callable | Endpoint | None, scratch: str, replies: str, banner: str | None) -> None:
    """Documents (doc_id, doc_type, text) to their files."""
    kept = lambda df, name: _kept(df, f"{scratch}/_batch/{name}")
    parsed = units.parse(corpus.lines_of(kept(docs, "docs"), "doc_id", "text", "doc_type"), banner).strict()
    found, heads = kept(parsed.units, "units"), kept(parsed.documents, "documents")
    prompts = kept(units.rendered(found, heads), "prompts")
    candidates = kept(calls.extracted(prompts, model, replies) if isinstance(model, Endpoint) else statements.asked(prompts, model), "candidates")
    records, rejected = statements.verified(candidates, found, heads, prompts)
    records = kept(records, "records")
    if link_model is not None:
        answered = kept(calls.replied(records, link_model, replies) if isinstance(link_model, Endpoint) else links.asked_for_replies(records, link_model), "answered")
        records, outcomes = links.linked(records, answered)
        for row in sorted(links.outcome_counts(outcomes).collect()):  # a few rows a document
            print(f"{row['doc_id']}: {row['n']} {row['outcome']}", file=sys.stderr)
    document_files.write(statements.blocks(records, heads), scratch)
    failed = candidates.filter("model_seq is null").select("doc_id", F.lit("call failed").alias("reason"), F.lit(1).cast("long").alias("n"))
    for row in sorted(statements.rejected_counts(rejected).union(failed).collect()):
        print(f"{row['doc_id']}: dropped {row['n']}: {row['reason']}", file=sys.stderr)


def annotate(spark: SparkSession, archive: str, registry: DataFrame, out_dir: str, model: Callable | Endpoint | None, only: list[str] | None = None, banner: str | None = None) -> int:
    """Archive to annotated segments, one JSON folder; without a model every segment gets the defaults.

    ``model`` is called with the segments of a batch and the topics in use.
    """
    lines = corpus.lines_of(corpus.archive(spark, archive, only), "doc_id", "text", "doc_type").filter("doc_type <> 'report'")
    found = segments.parse(lines, registry, banner)
    from ledgerline.schemas import ANNOTATIONS

    vocabulary_file = Path(out_dir) / "_topic_vocabulary.json"
    rows: list[dict] = []
    if model is not None:
        meta = segments.document_meta(lines, found) if isinstance(model, Endpoint) else None
        rows, topics = segments.annotate(found, calls.annotator(model) if isinstance(model, Endpoint) else model, sinks.vocabulary(vocabulary_file), documents=meta)
        sinks.vocabulary(vocabulary_file, topics)
    annotations = spark.createDataFrame([tuple(r.get(n) for n in ANNOTATIONS.fieldNames()) for r in rows], ANNOTATIONS)
    sinks.json_lines(segments.annotated(found, annotations), str(Path(out_dir) / "segments"))
    sinks.json_lines(segments.document_meta(lines, found), str(Path(out_dir) / "documents"))
    return 0


def ask(spark: SparkSession, path: str, question: str, model: Callable | Endpoint | None = None) -> tuple[str, DataFrame]:
    """(answer, citations) from a statements file, read anew for every question."""
    rows = statements.flattened(corpus.statements_file(spark, path))
    return answers.answer(statements.checked_acts(rows), question, calls.answerer(model) if isinstance(model, Endpoint) else model)


def ask_live(spark: SparkSession, path: str, question: str, model: Callable | Endpoint | None = None, delay: float = 0.0) -> Iterator[str]:
    """The same as server-sent events, token by token.

    ``model(question, documents)`` gives pieces of a reply; without a model the canned answer's words come, ``delay`` seconds
    apart.  Nothing from the delimiter on is passed on; citations follow at the end, from the table; a reply that fails
    (OSError, ValueError) ends with an error event and has no citations.
    """
    rows = statements.checked_acts(statements.flattened(corpus.statements_file(spark, path)))
    say = lambda event, **data: f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"
    if model is None:
        canned, _, ids = answers.dummy_answer(rows, ["document_id", "seq"]).partition(DELIMITER)
        pieces: Iterator[str] = iter([*re.findall(r"\S+\s*", canned), DELIMITER + ids])
    else:
        documents = [r["json"] for r in answers.payload_json(rows).orderBy("document_id").collect()]
        pieces = (calls.streamed(model) if isinstance(model, Endpoint) else model)(question, documents)
    held, behind = holdback.HoldBack(), []
    try:
        for piece in pieces:
            text = held.feed(piece)
            if held.seen:
                behind.append(held.behind)
            if text:
                yield say("token", text=text)
                if model is None and delay:
                    time.sleep(delay)
    except (OSError, ValueError) as error:
        yield say("error", message=f"The model did not answer: {error}")
        return
    if rest := held.finish():
        yield say("token", text=rest)
    ended = spark.createDataFrame([("0", 0, "ids", "".join(behind))], "request string, n long, event string, data string")
    for row in holdback.verified_frames(ended, rows).orderBy("n").collect():  # two frames
        yield row["frame"]


def delete(spark: SparkSession, path: str, name: str, roles: deletion.Roles = deletion.Roles(), dry_run: bool = False) -> deletion.Receipt:
    """Remove a person from a statements file.  Read, rewrite and replace are one step in this process.

    Raises FileNotFoundError without a file and ValueError for an empty name.  Nothing is written if nobody
    was found or on a dry run.
    """
    if not name.strip():
        raise ValueError("name is empty")
    with _one_at_a_time:
        if not Path(path).exists():
            raise FileNotFoundError(path)
        blocks = corpus.statements_file(spark, path)
        after, receipt = deletion.delete_person(blocks, name, roles)
        if receipt.deleted is not None and not dry_run:
            sinks.statements_json(after, path)
    return receipt


def health() -> dict[str, str]:
    """That the service is there."""
    return {"status": "ok"}


def _named(spec: str | None) -> Callable | None:
    if not spec:
        return None
    module, _, function = spec.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> int:
    settings = Settings.from_env()
    parser = argparse.ArgumentParser(prog="ledgerline")
    sub = parser.add_subparsers(dest="job", required=True)
    e, a, q, d = (sub.add_parser(n) for n in ("extract", "annotate", "ask", "delete"))
    e.add_argument("only", nargs="*")
    for p in (e, a):
        p.add_argument("--archive", required=True)
        p.add_argument("--banner", default=settings.banner or None)
    e.add_argument("--out", required=True)
    e.add_argument("--link-model")
    a.add_argument("--registry", required=True)
    a.add_argument("--out-dir", required=True)
    a.add_argument("--dry-run", action="store_true")
    a.add_argument("--only", nargs="*")
    for p in (e, a, q):
        p.add_argument("--model")
    q.add_argument("question")
    d.add_argument("name")
    d.add_argument("--dry-run", action="store_true")
    d.add_argument("--role", action="append", default=[], metavar="NAME=PLACEHOLDER")
    q.add_argument("--stream", action="store_true")
    e.add_argument("--at-a-time", type=int, default=1)
    for p in (q, d):
        p.add_argument("--statements", default=settings.statements)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    if args.job == "extract":
        own = settings.endpoint(native=True)
        model = _named(args.model) or own
        if model is None:
            print("no model is named: --model module:function, or LEDGERLINE_MODEL", file=sys.stderr)
            return 2
        return extract(spark, args.archive, args.out, model, _named(args.link_model) or (None if args.model else own), args.only, args.at_a_time, args.banner)
    if args.job == "annotate":
        return annotate(spark, args.archive, corpus.registry(spark, args.registry), args.out_dir, None if args.dry_run else _named(args.model) or settings.endpoint(), args.only, args.banner)
    if args.job == "ask":
        model = _named(args.model) or settings.endpoint()
        if args.stream:
            for frame in ask_live(spark, args.statements, args.question, model, settings.delay):
                print(frame, end="", flush=True)
            return 0
        prose, cited = ask(spark, args.statements, args.question, model)
        print(json.dumps({"answer": prose, "citations": [json.loads(x) for x in cited.toJSON().collect()]}, indent=2, ensure_ascii=False))
        return 0
    try:
        marks = tuple((mark.lower(), place) for mark, _, place in (r.partition("=") for r in args.role))
        receipt = delete(spark, args.statements, args.name, deletion.Roles(marks), args.dry_run)
    except FileNotFoundError:
        print(f"no statements file at {args.statements}", file=sys.stderr)
        return 2
    print(json.dumps(dataclasses.asdict(receipt), indent=2, ensure_ascii=False))
    if (Path(args.statements).parent / "documents").exists():
        print("a scratch folder of an interrupted run is still there and may hold the name", file=sys.stderr)
    return 0 if receipt.deleted else 1


if __name__ == "__main__":
    raise SystemExit(main())
