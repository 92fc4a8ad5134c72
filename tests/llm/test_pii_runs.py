"""Cards and IBANs beside other numbers and words."""

import re

import pytest

from ledgerline.llm import pii
from tests.llm.test_texts import docs, luhn

CARD, IBAN = "4111 1111 1111 1111", "AT611904300234573201"


def plain(text):
    return re.sub("[ -]", "", text)


BESIDE = [
    (f"{CARD} 12 items", [CARD], 1), ("4111111111111111 123 Main St", ["4111111111111111"], 1), ("pay 4 4111111111111111", ["4111111111111111"], 1),
    ("4111111111111111 161.17.88.162", ["4111111111111111", "161.17.88.162"], 2), (f"{IBAN} EUR", [IBAN], 1), (f"{IBAN} {CARD}", [IBAN, CARD], 2),
    (f"{IBAN} 2021-03-04", [IBAN, "2021-03-04"], 2), (f"{CARD} 4207051279108084 7", [CARD, "4207051279108084"], 2), (f"AB12 {CARD} X", [CARD], 1),
    ("4111111111111111 7joe@mail.example.com", ["4111111111111111", "7joe@mail"], 2), ("12-4111-1111-1111-1111-9", ["4111-1111-1111-1111"], 1), (f"{IBAN} GB82 WEST 1234 5698 7654 32 X", [IBAN, "GB82 WEST 1234 5698 7654 32"], 2),
    ("1 2 3 4 5 6 7 8 9 10 11 12 13 " + "77 " * 30_000 + f"x {CARD} 12", [CARD], None),
]


def test_values_beside_others(spark):
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, [t for t, _, _ in BESIDE])).collect()}
    alone = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(spark, [v for _, values, _ in BESIDE for v in values])).collect()}
    k = 0
    for i, (text, values, n) in enumerate(BESIDE):
        got = rows[i]["text"]
        for v in values:
            assert v not in got and (alone[k] in got or "@" in v), (text[:60], got[:60])
            k += 1
        assert n is None or rows[i]["n_values"] == n, (text, got)
    assert rows[0]["text"].endswith(" 12 items") and luhn(plain(rows[0]["text"][:19])) and rows[4]["text"].endswith(" EUR")


@pytest.mark.parametrize("value", ["k" * 5000, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "a.bcdefghi", "ab." * 5_000 + "c"])
def test_secrets_are_replaced_whole(spark, value):
    row = pii.pseudonymise(docs(spark, [f"token={value}. Next"])).first()
    assert row["n_values"] == 1 and row["text"].startswith("token=") and row["text"].endswith(". Next")
    new = row["text"][len("token=") : -len(". Next")]
    assert len(new) == len(value) and all(a[-30:] != b[-30:] for a, b in zip(value.split("."), new.split("."), strict=True) if len(a) > 7)


GONE = [
    ("ann.lee@a.b.c.d.e.f.g.h.i.j.k.secretcorp.com", ["secretcorp", "ann.lee"]), ("x" * 80 + "@mail.example.com", ["x" * 20, "example"]), ("password: 'hunter2hunter2'", ["hunter2"]),
    ("token=`abcdefgh1234`", ["abcdefgh1234"]), ("GB82-WEST-1234-5698-7654-32", ["1234-5698", "WEST"]), ("pay DE89 3704-0044 0532-0130 00 now", ["3704", "0130"]),
]


def test_values_that_were_missed(spark):
    for (text, words), row in zip(GONE, pii.pseudonymise(docs(spark, [t for t, _ in GONE])).orderBy("doc_id").collect(), strict=True):
        assert row["n_values"] == 1 and not any(w in row["text"] for w in words), row
        assert len(row["text"]) == len(text) and [c for c in row["text"] if not c.isalnum()] == [c for c in text if not c.isalnum()]
