"""Hold-back over whole, long replies, chunk by chunk as the state machine gives them."""

import time

from ledgerline.operators.answers import DELIMITER
from ledgerline.streaming import holdback


def test_long_replies(spark):
    long = "words and === more " * 20_000
    replies = [long + DELIMITER + '["x"]' + DELIMITER, long + DELIMITER[:-1], DELIMITER + long[:500], "ab" + DELIMITER]
    rows, want = [], {}
    for r, (text, step) in enumerate(zip(replies, (20, 20, 7, 1), strict=True)):
        cut = [text[i : i + step] for i in range(0, len(text), step)]
        cut = [x for c in cut for x in ([c, None, ""] if step < 20 else [c])]
        h = holdback.HoldBack()
        for seq, c in enumerate(cut):
            last = seq + 1 == len(cut)
            want[r, seq] = (h.feed(c or "") if step < 20 or len(cut) < 100 else None, last)
            rows.append((r, seq, c, last))
    df = spark.createDataFrame(rows, "request int, seq long, chunk string, last boolean")
    began = time.perf_counter()
    got = sorted(holdback.held_back_batch(df).collect(), key=lambda r: (r["request"], r["seq"]))
    assert time.perf_counter() - began < 60
    for r, text in enumerate(replies):
        own = [x for x in got if x["request"] == r]
        assert "".join(x["text"] for x in own) == text.split(DELIMITER)[0] and own[-1]["complete"] == text
        assert all(x["text"] == want[r, x["seq"]][0] for x in own[:-1] if want[r, x["seq"]][0] is not None)
