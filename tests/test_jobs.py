import json

import pytest

from ledgerline import jobs
from ledgerline.operators import statements
from ledgerline.sources import corpus, sinks
from ledgerline.streaming import holdback, ingest, sse
from tests.test_deletion import archive
from tests.test_units import INSIDE, MAIL, TALK


@pytest.fixture
def folder(tmp_path):
    for d, name, text in (("transcripts", "a b", "﻿" + TALK), ("transcripts", "c", INSIDE), ("emails", "x", MAIL)):
        (tmp_path / "in" / d).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / d / f"{name}.txt").write_text(text, encoding="utf-8")
    return tmp_path


def model(doc_id, prompt):
    if doc_id == "transcripts/c":
        raise ValueError("no JSON")
    span = "Fine with me." if "emails" in doc_id else "move the launch"
    return [{"unit": 1, "span": span, "claim": f"About {doc_id}", "act": "proposal", "handling": "none", "org": "Example Co", "role": None}]


def test_archive(spark, folder):
    rows = corpus.archive(spark, str(folder / "in")).orderBy("doc_seq").collect()
    assert [(r["doc_id"], r["doc_type"]) for r in rows] == [("transcripts/a b", "transcript"), ("transcripts/c", "transcript"), ("emails/x", "email")]
    assert rows[0]["text"] == TALK
    assert [r["doc_id"] for r in corpus.archive(spark, str(folder / "in"), ["x", "zzz"]).collect()] == ["emails/x"]


def test_extract_ask_delete(spark, folder):
    out = folder / "statements.json"
    assert jobs.extract(spark, str(folder / "in"), str(out), model, at_a_time=5) == 1  # one document gave nothing
    data = json.loads(out.read_text(encoding="utf-8"))["documents"]
    assert [(d["id"], len(d["statements"])) for d in data] == [("transcripts/a b", 1), ("transcripts/c", 0), ("emails/x", 1)]
    assert data[0]["statements"][0] == {"claim": "About transcripts/a b", "speech_act": "proposal", "actor": {"name": "Ada Berg", "organization": "Example Co"}, "statement_date": "2025-03-04"}
    assert out.read_text(encoding="utf-8").endswith("}\n") and not (folder / "documents").exists()
    prose, cited = jobs.ask(spark, str(out), "?")
    assert "Ada Berg (Example Co) proposal on 2025-03-04" in prose and cited.count() == 2
    before = out.read_text(encoding="utf-8")
    assert jobs.delete(spark, str(out), "Ada Berg", dry_run=True).deleted and out.read_text(encoding="utf-8") == before
    assert jobs.delete(spark, str(out), "Ada Berg").deleted["statements_changed"] == 1
    assert "Ada Berg" not in out.read_text(encoding="utf-8")
    assert jobs.delete(spark, str(out), "Nobody Such").deleted is None
    with pytest.raises(ValueError):
        jobs.delete(spark, str(out), " ")
    with pytest.raises(FileNotFoundError):
        jobs.delete(spark, str(folder / "none.json"), "x")


def test_nothing_extracted_writes_nothing(spark, folder):
    out = folder / "statements.json"
    out.write_text("old")
    assert jobs.extract(spark, str(folder / "in"), str(out), lambda *_: [], at_a_time=5) == 1
    assert out.read_text() == "old" and (folder / "documents").exists()
    assert jobs.extract(spark, str(folder / "in"), str(out), model, only=["nothing"]) == 2


def test_annotate_without_model(spark, folder):
    people = folder / "people.json"
    people.write_text('{"canonical_id":"p1","name":"Per Holm","org":"Vendor","title":null,"emails":[]}\n')
    assert jobs.annotate(spark, str(folder / "in"), corpus.registry(spark, str(people)), str(folder / "out"), None) == 0
    assert spark.read.json(str(folder / "out" / "segments")).filter("speech_act = 'other'").count() >= 3


def test_command_line(spark, folder, capsys):
    out = folder / "s.json"
    sinks.json_file(out, archive())
    assert jobs.main(["delete", "Ada Berg", "--statements", str(out), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["deleted"]["name"] == "Ada Berg"
    assert jobs.main(["delete", "Nobody Such", "--statements", str(out)]) == 1
    assert jobs.main(["delete", "x", "--statements", str(folder / "none.json")]) == 2
    assert jobs.main(["extract", "--archive", str(folder / "in"), "--out", str(out)]) == 2
    assert jobs.main(["ask", "why", "--statements", str(out)]) == 0
    assert jobs.health() == {"status": "ok"}
    assert jobs.Settings.from_env({"LEDGERLINE_TIMEOUT": "5", "LEDGERLINE_DUMMY": "true"}) == jobs.Settings(timeout=5.0, dummy=True)


def test_statements_reader(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"documents": [{"id": "é", "type": "email", "date": "2025-01-02", "extra": 1, "statements": [{"claim": "c", "speech_act": "report", "actor": {"name": "n", "organization": "o"}, "statement_date": "2025-01-02T10:00:00"}]}] * 2}), encoding="utf-8")
    blocks = corpus.statements_file(spark, str(path))
    assert blocks.first()["people"] == [] and blocks.first()["summary"] == ""
    flat = statements.flattened(blocks).collect()
    assert [r["id"] for r in flat] == ["é#1"] and str(flat[0]["statement_date"]) == "2025-01-02 10:00:00"
    path.write_text("{broken", encoding="utf-8")
    with pytest.raises(Exception):
        corpus.statements_file(spark, str(path)).collect()


def test_swapped_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.swapped_parquet(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_vocabulary(tmp_path):
    assert sinks.vocabulary(tmp_path / "v.json") == set()
    sinks.vocabulary(tmp_path / "v.json", {"b", "a"})
    assert json.loads((tmp_path / "v.json").read_text()) == ["a", "b"] and sinks.vocabulary(tmp_path / "v.json") == {"a", "b"}


REPLIES = ["plain words only", 'first ===CITATIONS===["a"]', "ends with ===CITAT", "===CITATIONS===[]", "x=" * 30 + "===CITATIONS===[1] ===CITATIONS===", ""]


def chunked(text, size):
    parts = [text[i : i + size] for i in range(0, len(text), size)] or [""]
    return [(k, p, k == len(parts) - 1) for k, p in enumerate(parts)]


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_hold_back_never_leaks(spark, size):
    rows = [(i, k, p, last) for i, r in enumerate(REPLIES) for k, p, last in chunked(r, size)]
    df = spark.createDataFrame(rows, "request long, seq long, chunk string, last boolean")
    batch = {(r["request"], r["seq"]): r["text"] for r in holdback.held_back_batch(df).collect()}
    for i, reply in enumerate(REPLIES):
        h, out = holdback.HoldBack(), []
        for k, part, last in chunked(reply, size):
            text = h.feed(part) + (h.finish() if last else "")
            assert batch[(i, k)] == text
            out.append(text)
        assert "".join(out) == reply.partition("===CITATIONS===")[0]


def test_hold_back_stream(spark, tmp_path):
    rows = [(i, k, p, last) for i, r in enumerate(REPLIES) for k, p, last in chunked(r, 5)]
    schema = "request long, seq long, chunk string, last boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"), ignoreNullFields=False)
    out = holdback.held_back(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("held").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {}
    for r in sorted(spark.table("held").collect(), key=lambda r: (r["request"], r["seq"])):
        k = int(r["request"])
        got[k] = got.get(k, "") + r["text"]
        assert r["complete"] in (None, REPLIES[k])
    assert got == {i: r.partition("===CITATIONS===")[0] for i, r in enumerate(REPLIES)}


def test_incremental_ingest(spark, folder):
    seen = []
    stream = ingest.arriving(spark, str(folder / "in"))
    q = ingest.each_batch(stream, lambda df, n: seen.append((n, [r["doc_id"] for r in df.select("doc_id").collect()])), str(folder / "cp"))
    q.awaitTermination(120)
    assert sorted(d for _, ds in seen for d in ds) == ["emails/x", "transcripts/a%20b", "transcripts/c"] or sorted(d for _, ds in seen for d in ds) == ["emails/x", "transcripts/a b", "transcripts/c"]
    assert all(len(ds) == 1 for _, ds in seen)


def test_sse_round_trip(spark):
    from pyspark.sql import functions as F

    prose = spark.createDataFrame([(1, "Two words ")], "request int, prose string")
    tokens = prose.select("request", F.posexplode(sse.tokens(F.col("prose"))).alias("seq", "text")).withColumn("seq", F.col("seq").cast("long"))
    cites = spark.createDataFrame([(1, '[{"marker":1}]'), (2, "[]")], "request int, json string")
    errors = spark.createDataFrame([(2, "gone")], "request int, message string")
    frames = sse.answer_events(tokens, cites, errors)
    lines = frames.withColumn("l", F.split("frame", "\n")).select("request", "n", F.posexplode(F.slice("l", 1, 3)).alias("p", "text")).withColumn("line_no", F.col("n") * 3 + F.col("p"))
    ev = sse.events(lines)
    assert [r["event"] for r in ev.filter("request = 1").orderBy("n").collect()] == ["token", "token", "citations", "done"]
    got = {r["request"]: r for r in sse.folded(ev).collect()}
    assert got[1]["answer"] == "Two words " and json.loads(got[1]["citations"]) == [{"marker": 1}] and got[1]["error"] is None
    assert got[2]["error"] == "gone" and got[2]["citations"] is None


def test_sse_bad_data_is_passed_over(spark):
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["event: token", 'data: {"text":"a"}', "", "event: token", "data: {broken", "", "data: no event", "", "event: token", 'data: {"text":"b"}'])], "request int, line_no int, text string")
    assert sse.folded(sse.events(lines)).first()["answer"] == "ab"
