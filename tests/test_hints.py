import random

import pytest

from beaconaudit import LIVE, detect, register_rules
from beaconaudit.functions import hints
from beaconaudit.operators import findings as ops
from beaconaudit.rules import Rulebook


def book_of(families):
    return register_rules(Rulebook(()), "Notes", [".md"], families)


def found(spark, text, book, indexed, monkeypatch):
    monkeypatch.setattr(ops, "INDEXED", indexed)
    files = spark.createDataFrame([("/p/a.md", text)], "path string, content string")
    return {r["line_number"]: (r["family"], r["data_being_sent"]) for r in detect(files, book).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_findings_as_trying_every_family(spark, seed, monkeypatch):
    rng = random.Random(seed)
    def word():
        return "".join(rng.choice("ab.('é\\x") for _ in range(rng.randint(1, 7)))
    families = []
    for i in range(60):
        w = word().replace("\\x", "x").replace("\\", "b")
        literal = "".join("\\" + c if c in ".('" else c for c in w)
        family = {"name": f"f{i}", "patterns": [literal + rng.choice(["", "x*", "(?=b|$)"])], "hints": [w.lower(), "never here"][:rng.randint(1, 2)]}
        if i % 7 == 0:
            family["fields"] = {"k": "(" + literal + ".?)"}
        if i % 13 == 0:
            del family["hints"]  # such a family is tried on every line
        families.append(family)
    book = book_of(families)
    text = "\n".join("".join(rng.choice("abAB.('éÉx ") for _ in range(rng.randint(0, 12))) for _ in range(80))
    plain = found(spark, text, book, 10**9, monkeypatch)
    assert len(plain) > 20
    assert found(spark, text, book, 1, monkeypatch) == plain


def test_a_family_needs_one_of_its_hints(spark, monkeypatch):
    book = book_of([{"name": "a", "patterns": ["datum"], "hints": ["data"]}, {"name": "b", "patterns": ["dat"], "hints": ["datu", "dato"]}])
    for indexed in (1, 10**9):
        got = found(spark, "datum\ndata datum\ndat\nDATO", book, indexed, monkeypatch)
        assert {n: f for n, (f, _) in got.items()} == {1: "b", 2: "a", 4: "b"}


def test_first_family_wins_whatever_its_bucket(spark, monkeypatch):
    families = [{"name": f"w{i}", "patterns": [rf"\bw{i}\b"], "hints": [f"w{i}"]} for i in range(1030)]
    got = found(spark, "w1027 w1029\nw3 w12\nw1030 w\nW77", book_of(families), 1, monkeypatch)
    assert {n: f for n, (f, _) in got.items()} == {1: "w1027", 2: "w3", 4: "w77"}


def test_rare_grams_are_chosen():
    words = [f"service.call{i:03}" for i in range(500)]
    gram = hints.filed_under(words)
    assert all(g in h for h, g in gram.items())
    table, sizes = hints.buckets([(i, (w,)) for i, w in enumerate(words)])
    assert sizes == [hints.GRAM] and max(map(len, table)) < 20 and sum(map(len, table)) == 500


def test_live_rules_by_index(spark, monkeypatch):
    text = "import { datadogRum } from '@datadog/browser-rum';\ndatadogRum.addAction('click');\nlogger.info('x'); logger.error('y')\nx = datadogRum(1)"
    files = spark.createDataFrame([("/p/a.ts", text)], "path string, content string")
    plain = detect(files, LIVE).collect()
    monkeypatch.setattr(ops, "INDEXED", 2)
    assert detect(files, LIVE).collect() == plain and len(plain) == 4


def test_families_after_the_first_hit_are_not_tried(spark):
    families = [(0, ("never",), "never"), (1, ("aab",), "a+b"), (2, ("aab",), "(")]  # the last pattern cannot be tried
    first = hints.first_hit(families, "line", "line")
    rows = spark.createDataFrame([("xaab",), ("xyz",)], "line string").selectExpr("line", f"{first} AS n").collect()
    assert {r["line"]: r["n"] for r in rows} == {"xaab": 1, "xyz": None}
