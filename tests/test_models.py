"""The model path against a scripted HTTP server: calls, retries, replies kept, failures as rows, jobs from end to end."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ledgerline import jobs
from ledgerline.operators import calls, prompts
from ledgerline.sources import corpus, document_files, models
from ledgerline.sources.models import Endpoint
from tests.test_jobs import folder  # noqa: F401
from tests.test_statements import linkable


class Server:
    """``script(messages, body)`` gives a reply's text, or (code, text) for an HTTP error; ``asked`` holds all bodies."""

    def __init__(self, script, cut=False):
        self.asked, self.paths, outer = [], [], self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                outer.asked.append(body)
                outer.paths.append(self.path)
                got = script(body["messages"], body)
                code, text = got if isinstance(got, tuple) else (200, got)
                self.send_response(code)
                self.end_headers()
                if code != 200:
                    self.wfile.write(text.encode())
                elif body["stream"]:
                    for k in range(0, len(text), 7):
                        self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': text[k : k + 7]}}]})}\n\n".encode())
                    self.wfile.write(b"" if cut else b"data: [DONE]\n\n")
                elif self.path == "/api/chat":
                    self.wfile.write(json.dumps({"message": {"content": text}}).encode())
                else:
                    self.wfile.write(json.dumps({"choices": [{"message": {"content": text}}]}).encode())

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/v1"

    def endpoint(self, **more):
        return Endpoint(self.url, "m", **{"pause": 0.01, "timeout": 20.0, **more})


@pytest.fixture
def serve():
    made = []

    def start(script, **more):
        made.append(Server(script, **more))
        return made[-1]

    yield start
    for s in made:
        s.http.shutdown()


def statement(unit, span, act="proposal"):
    return {"unit": unit, "span": span, "claim": f"About {span}", "act": act, "org": "Example Co", "role": None, "handling": "none"}


def extraction(messages, body):
    user = messages[1]["content"]
    if "Document: transcripts/c" in user:
        return "I can't do that."
    span = "Fine with me." if "Document: emails" in user else "move the launch"
    return "```json\n" + json.dumps({"statements": [statement(1, span)]}) + "\n```"


def test_replies_are_asked_for_once(spark, tmp_path, serve):
    busy = {"n": 0}

    def script(messages, body):
        text = messages[0]["content"]
        if text == "busy" and busy["n"] < 2:
            busy["n"] += 1
            return 503, "later"
        return (400, "no") if text == "bad" else text.upper()

    server = serve(script)
    rows = [(k, json.dumps([{"role": "user", "content": t}])) for k, t in enumerate(["a", "b", "busy", "bad", "a"])] + [(9, None)]
    df = models.replies(spark.createDataFrame(rows, "k int, messages string"), server.endpoint(), None, str(tmp_path / "kept"))
    got = {r["k"]: (r["reply"], r["error"]) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "A", 1: "B", 2: "BUSY", 3: None, 4: "A", 9: None}
    assert "400" in got[3][1] and got[9][1] is None and len(server.asked) == 6  # a once, busy three times
    # Computed anew, as after the loss of an executor: only what failed is asked for again.
    assert df.filter("reply is not null").count() == 4 and len(server.asked) == 7
    other = models.replies(spark.createDataFrame(rows[:1], "k int, messages string"), server.endpoint(at_once=1, tasks=1), {"type": "object"}, str(tmp_path / "kept"))
    assert other.first()["reply"] == "A" and len(server.asked) == 8  # another form of reply is another question


def test_what_is_sent():
    native = Endpoint("http://h/v1/", "m", native=True, context=9)
    assert native.url() == "http://h/api/chat" and Endpoint("http://h/v1", "m").url() == "http://h/v1/chat/completions"
    body = native.body([], prompts.LINK_SCHEMA)
    assert body["format"]["properties"]["response"]["enum"] == ["accepted", "rejected", "none"] and body["options"] == {"temperature": 0, "num_ctx": 9} and body["think"] is False
    assert Endpoint("x", "m").body([], {"a": 1})["response_format"]["json_schema"]["schema"] == {"a": 1}


def test_candidates_and_failures(spark, serve):
    server = serve(extraction)
    asked = spark.createDataFrame([("emails/x", "Document: emails/x"), ("transcripts/c", "Document: transcripts/c")], "doc_id string, prompt string")
    got = {r["doc_id"]: r for r in calls.extracted(asked, server.endpoint(native=True)).collect()}
    assert got["emails/x"]["span"] == "Fine with me." and got["emails/x"]["model_seq"] == 0 and got["transcripts/c"]["model_seq"] is None
    assert set(server.paths) == {"/api/chat"} and all(b["format"] == prompts.EXTRACTION_SCHEMA for b in server.asked)


def test_links(spark, serve):
    def script(messages, body):
        user = messages[1]["content"]
        assert user.startswith("STATEMENT of ") and "\n\nAFTERWARDS:\n[" in user
        return json.dumps({"response": "accepted", "by": "B", "quote": "yes"}) if len(server.asked) == 1 else "{}"

    server = serve(script)
    rows = calls.replied(linkable(spark), server.endpoint(at_once=1, tasks=1)).collect()
    assert sorted(r["response"] for r in rows) == sorted(["accepted"] + ["call failed"] * (len(rows) - 1)) and len(rows) > 1


def test_extract_through_an_endpoint(spark, folder, serve):  # noqa: F811
    server, out = serve(extraction), folder / "statements.json"
    assert jobs.extract(spark, str(folder / "in"), str(out), server.endpoint(native=True), server.endpoint(native=True), at_a_time=5) == 1
    data = json.loads(out.read_text(encoding="utf-8"))["documents"]
    assert [(d["id"], len(d["statements"])) for d in data] == [("transcripts/a b", 1), ("transcripts/c", 0), ("emails/x", 1)]
    assert out.read_text(encoding="utf-8") == json.dumps({"documents": data}, ensure_ascii=False, indent=2) + "\n"
    assert len(server.asked) == 3 and not (folder / "documents").exists()


def test_broken_run_goes_on(spark, folder, serve):  # noqa: F811
    """The second file is there when the third document breaks the job; the next run asks for the third alone."""
    out, broken = folder / "statements.json", {"on": True}
    names = []

    def script(messages, body):
        names.append(messages[1]["content"].split("\n")[0])
        return extraction(messages, body)

    server = serve(script)
    real = document_files.write

    def stopping(blocks, path):
        if broken["on"] and len(document_files.written(path)) == 2:
            raise RuntimeError("stopped")
        real(blocks, path)

    document_files.write = stopping
    try:
        with pytest.raises(Exception, match="stopped"):
            jobs.extract(spark, str(folder / "in"), str(out), server.endpoint(native=True))
        assert len(document_files.written(str(folder / "documents"))) == 2 and not out.exists()
        before, broken["on"] = len(names), False
        assert jobs.extract(spark, str(folder / "in"), str(out), server.endpoint(native=True)) == 1
    finally:
        document_files.write = real
    assert len(json.loads(out.read_text(encoding="utf-8"))["documents"]) == 3 and not (folder / "documents").exists()
    assert sorted(names) == sorted(set(names)) and len(names) - before <= 1


def test_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "d")
    good = spark.createDataFrame([("a/b", 1), ("c", 2)], "id string, n int")
    document_files.write(good, path)
    document_files.write(good.filter("id = 'c'").withColumn("n", F.lit(3)), path)
    assert [p.removeprefix(path) for p in document_files.written(path)] == ["/a/b.json", "/c.json"]
    assert json.loads((tmp_path / "d" / "c.json").read_text()) == {"documents": [{"id": "c", "n": 3}]}
    bad = spark.range(0, 4, 1, 2).select(F.concat(F.lit("x"), "id").alias("id"), F.when(F.col("id") == 3, F.raise_error(F.lit("late"))).cast("int").alias("n"))
    with pytest.raises(Exception):
        document_files.write(bad, path)
    assert len(document_files.written(path)) == 2


def annotation(messages, body):
    view = json.loads(messages[1]["content"])
    assert view["doc_id"] and view["topics_in_use"] == sorted(view["topics_in_use"])
    topic = view["topics_in_use"][0] if view["topics_in_use"] else f"first-{len(view['segments'])}"
    return json.dumps({"annotations": [{"segment_id": s["segment_id"], "speech_act": "question", "topics": [topic], "people_mentioned": [], "is_truncated": False, "supersedes_segment_id": None} for s in [*view["segments"], {"segment_id": "made up"}]]})


def test_annotate_through_an_endpoint(spark, folder, serve):  # noqa: F811
    server, people = serve(annotation), folder / "people.json"
    people.write_text('{"canonical_id":"p1","name":"Per Holm","org":"Vendor","title":null,"emails":[]}\n')
    assert jobs.annotate(spark, str(folder / "in"), corpus.registry(spark, str(people)), str(folder / "out"), server.endpoint()) == 0
    rows = spark.read.json(str(folder / "out" / "segments"))
    assert rows.filter("speech_act = 'question'").count() == rows.count() >= 3
    topics = json.loads((folder / "out" / "_topic_vocabulary.json").read_text())
    assert len(topics) == 1 and rows.filter(f"topics[0] <> '{topics[0]}'").count() == 0


FILE = {"documents": [{"id": "d", "type": "email", "date": "2025-01-02", "people": [], "summary": "", "statements": [{"claim": "It rains", "speech_act": "report", "actor": {"name": "Ann", "organization": "Org"}, "statement_date": "2025-01-02"}]}]}


def events_of(frames):
    return [(f.split("\n")[0][7:], json.loads(f.split("\n")[1][6:])) for f in frames]


def test_ask(spark, tmp_path, serve):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(FILE))

    def script(messages, body):
        assert messages[0]["content"] == prompts.ANSWER and '"claim":"It rains"' in messages[1]["content"]
        return 'It does [1].\n===CITATIONS===["d#1", "d#9"]'

    server = serve(script)
    prose, cited = jobs.ask(spark, str(path), "Rain?", server.endpoint())
    assert prose == "It does [1]." and [r["id"] for r in cited.collect()] == ["d#1"]
    got = events_of(jobs.ask_live(spark, str(path), "Rain?", server.endpoint()))
    assert "".join(d["text"] for e, d in got if e == "token") == "It does [1].\n" and [e for e, _ in got][-2:] == ["citations", "done"]
    assert [(c["marker"], c["statement_id"], c["claim"]) for c in got[-2][1]["citations"]] == [(1, "d#1", "It rains")]
    cut = events_of(jobs.ask_live(spark, str(path), "Rain?", serve(script, cut=True).endpoint()))
    assert cut[-1][0] == "error" and not any(e == "citations" for e, _ in cut)
    gone = events_of(jobs.ask_live(spark, str(path), "Rain?", serve(lambda *_: (500, "down")).endpoint(attempts=1)))
    assert [e for e, _ in gone] == ["error"] and "500" in gone[0][1]["message"]
    canned = events_of(jobs.ask_live(spark, str(path), "Rain?"))
    assert canned[-2][1]["citations"][0]["statement_id"] == "d#1" and "Ann (Org) report" in "".join(d.get("text", "") for _, d in canned)


def test_settings_name_an_endpoint():
    env = {"LEDGERLINE_MODEL": "m", "LEDGERLINE_BASE_URL": "http://h/v1", "LEDGERLINE_API_KEY": "k", "LEDGERLINE_TIMEOUT": "5", "LEDGERLINE_CONTEXT": "99"}
    own = jobs.Settings.from_env(env)
    assert own.endpoint() == Endpoint("http://h/v1", "m", "k", 5.0) and own.endpoint(native=True).context == 99
    assert jobs.Settings.from_env(env | {"LEDGERLINE_DUMMY": "1"}).endpoint() is None and jobs.Settings.from_env({}).endpoint() is None
