import json
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.operators import deletion as D
from ledgerline.schemas import STATEMENTS_FILE

TYPE = STATEMENTS_FILE["documents"].dataType.elementType


def s(claim, name, org="Not stated", act="report"):
    return {"claim": claim, "speech_act": act, "actor": {"name": name, "organization": org}, "statement_date": "2025-01-02"}


def archive():
    return [
        {
            "id": "notes-Ada Berg", "type": "transcript", "date": "2025-01-02", "people": ["Ada Berg", "Per Holm"], "summary": "Talk with Ada Berg",
            "statements": [
                s("Ada Berg said Ada will call +47 123 456 789.", "Ada Berg", "Example Co"),
                s("Write to ada.berg@example.com or a.berg@x.org, Berg, Ada knows.", "Per Holm", "Vendor"),
                s("Åda Berg and an adage; ada stays small, Berg goes.", "Áda Berg", "Example Co"),
                s("Ada Lind came too.", "Per Holm", "Vendor"),
                s("Nobody here.", "Guest 1"),
            ],
        },
        {"id": "m", "type": "email", "date": "2025-01-03", "people": [], "summary": "", "statements": [s("Nothing.", "Per Holm", "Other")]},
    ]


def frame(spark, blocks=None):
    return spark.createDataFrame(blocks or archive(), TYPE)


def test_people(spark):
    got = {r["key"]: (r["name"], r["spellings"], r["evidence"]) for r in D.people(frame(spark)).collect()}
    assert got["ada berg"] == ("Ada Berg", ["Ada Berg", "Áda Berg", "Åda Berg"], 2)
    assert got["ada lind"] == ("Ada Lind", ["Ada Lind"], 1)
    assert got["per holm"][2] == 3 and not any("guest" in k for k in got)


def test_delete(spark):
    after, receipt = D.delete_person(frame(spark), "ada berg")
    text = json.dumps([r.asDict(True) for r in after.drop("id").collect()], ensure_ascii=False)
    assert "Berg" not in text and "ada.berg" not in text and "a.berg" not in text
    assert "Ada will call" in text and "Ada Lind" in text and "adage; ada stays" in text
    assert receipt.deleted["placeholder"] == "[former customer employee]" and receipt.deleted["statements_changed"] == 3
    assert receipt.considered[0] == {"name": "Ada Berg", "statements": 2, "outcome": "removed"} and receipt.considered[1]["name"] == "Ada Lind"
    assert any(n.startswith("Ada alone, a name that Ada Lind") for n in receipt.left_in_place)
    assert any("phone number, in 1 statement" in n for n in receipt.left_in_place)
    assert after.filter("id = 'notes-Ada Berg'").count() == 1  # ids stay
    again, second = D.delete_person(after, "Ada Berg")
    assert second.deleted is None and again.collect() == after.collect()
    assert "was replaced by" in D.receipt_sentence(receipt) and "Nobody was removed" in D.receipt_sentence(second)


def test_resolution(spark):
    blocks = frame(spark)
    everyone = D.people(blocks)
    chosen, others = D.resolve(blocks, everyone, "Ada")
    assert (chosen.name, [o.name for o in others]) == ("Ada Berg", ["Ada Lind"])  # most statements win
    assert D.resolve(blocks, everyone, "guest 1") == (None, []) and D.resolve(blocks, everyone, "  ") == (None, [])
    nobody, alike = D.resolve(blocks, everyone, "Ada Nowhere")
    assert nobody is None and {p.name for p in alike} == {"Ada Berg", "Ada Lind"}


def test_roles(spark):
    roles = D.Roles(marks=(("vendor", "[former vendor employee]"),))
    _, receipt = D.delete_person(frame(spark), "Per Holm", roles)
    assert receipt.deleted["placeholder"] == "[former vendor employee]"
    _, unknown = D.delete_person(frame(spark), "Ada Lind", roles)
    assert unknown.deleted["placeholder"] == "[former participant]"


@pytest.mark.parametrize(
    "text,want,n",
    [("Berg, Ada x", "# x", 1), ("ada-berg@a.b Ada Berg", "# #", 2), ("berg ada", "berg ada", 0), ("Ada  Berg Berg", "# #", 2), ("café", "café", 0), ("bergen Berger", "bergen Berger", 0)],
)
def test_redacted_text(spark, text, want, n):
    block = {"id": "d", "type": "email", "date": "2025-01-02", "people": [], "summary": text, "statements": []}
    got = D.redacted(frame(spark, [block]), D.forms(D.Person("ada berg", "Ada Berg", [], 1), ["ada"]), "#").first()
    assert (got["summary"], got["n_replaced"]) == (want, n)


def test_precedence_and_texts_beyond_the_first_plane(spark):
    texts = ["😀 Ada Berg 😀 Berg", "Berg, Ada Berg", "x" * 5000 + " Ada  Berg" * 200, None, ""]
    blocks = [{"id": str(k), "type": "email", "date": "2025-01-02", "people": [t], "summary": "Ada Berg", "statements": [s(t, None)]} for k, t in enumerate(texts)]
    got = D.redacted(frame(spark, blocks), D.forms(D.Person("ada berg", "Ada Berg", [], 1)), "#").orderBy("id").collect()
    assert [r["people"][0] for r in got] == ["😀 # 😀 #", "#, #", "x" * 5000 + " #" * 200, None, ""]
    assert [r["statements"][0]["claim"] for r in got] == [r["people"][0] for r in got] and all(r["summary"] == "#" for r in got)
    assert [(r["n_replaced"], r["n_changed"]) for r in got][0] == (5, 1) and [(r["n_replaced"], r["n_changed"]) for r in got][3] == (1, 0)


def spots_by_force(plain, folded, wanted):
    """Every hit against every kept one."""
    kept = []
    for pattern, capital in wanted:
        for hit in pattern.finditer(folded):
            if (not capital or plain[hit.start()].isupper()) and not any(a < hit.end() and hit.start() < b for a, b in kept):
                kept.append(hit.span())
    return sorted(kept)


@settings(max_examples=200, deadline=None)
@given(st.text("abAB ,.", max_size=60))
def test_spots_equal_brute_force(text):
    wanted = [(re.compile(p), c) for p, c in ((r"\bab\b", False), (r"b,\s*a", False), (r"a[. ]b", True), (r"a", True))]
    assert D.spots(text, text.lower(), wanted) == spots_by_force(text, text.lower(), wanted)


def test_many_hits_in_one_text(spark):
    text = "Ada Berg and Berg, Ada; " * 50_000
    block = {"id": "d", "type": "email", "date": "2025-01-02", "people": [], "summary": text, "statements": []}
    began = time.perf_counter()
    got = D.redacted(frame(spark, [block]), D.forms(D.Person("ada berg", "Ada Berg", [], 1)), "#").first()
    assert got["summary"] == "# and #; " * 50_000 and got["n_replaced"] == 100_000
    assert time.perf_counter() - began < 10
