"""Live replies of many requests: delimiters over chunks, failed and abandoned requests, late verification."""

import json
import time

from ledgerline.streaming import holdback

SCHEMA = "request string, seq long, chunk string, last boolean, error string"


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder), ignoreNullFields=False)


def test_live(spark, tmp_path):
    source, seen = tmp_path / "in", []
    put(spark, source, 0, [("ok", 0, "An answer [1] ===CIT", False, None), ("bad", 0, "Some words that are long enough", False, None), ("gone", 0, "A reply that never ends, alas", False, None)])
    rows = [("d#1", "d", "2025-01-02", "c", ("Ann", "Org"), "report", "2025-01-02")]
    table = spark.createDataFrame(rows, "id string, document_id string, document_date string, claim string, actor struct<name:string,organization:string>, speech_act string, statement_date string")
    events = holdback.live(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)), silence=15_000)
    frames = lambda df, _: seen.extend(tuple(r) for r in holdback.verified_frames(df, table).collect())
    q = events.writeStream.foreachBatch(frames).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not any(r[0] == "gone" for r in seen):
            time.sleep(0.2)
        put(spark, source, 1, [("ok", 1, "ATI", False, None), ("bad", 1, None, False, "The model did not answer: 500")])
        put(spark, source, 2, [("ok", 2, 'ONS===["d#1", ', False, None), ("ok", 3, '"made up"]', True, None), ("bad", 2, "late words that nobody sees, really", True, None)])
        while time.time() < deadline and not all(any(r[0] == k and e in r[2] for r in seen) for k, e in (("ok", "done"), ("bad", "error"), ("gone", "error"))):
            time.sleep(0.2)
    finally:
        q.stop()
    got = {k: [(f.split("\n")[0][7:], json.loads(f.split("\n")[1][6:])) for r, _, f in sorted(seen) if r == k] for k in ("ok", "bad", "gone")}
    assert "".join(d.get("text", "") for _, d in got["ok"]) == "An answer [1] " and [e for e, _ in got["ok"]][-2:] == ["citations", "done"]
    assert [(c["marker"], c["statement_id"]) for c in got["ok"][-2][1]["citations"]] == [(1, "d#1")]
    assert got["bad"][-1] == ("error", {"message": "The model did not answer: 500"}) and [e for e, _ in got["bad"]].count("error") == 1
    assert got["gone"][-1] == ("error", {"message": holdback.SILENT}) and not any(e in ("citations", "done") for e, _ in got["gone"] + got["bad"])


def test_state_is_a_tail():
    h, out = holdback.HoldBack(), []
    for k in range(0, 100_000, 10):
        out.append(h.feed(f"{k:010d}"))
        assert len(h.tail) < len(holdback.DELIMITER)
    assert "".join(out) + h.finish() == "".join(f"{k:010d}" for k in range(0, 100_000, 10))
