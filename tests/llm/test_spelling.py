import random
import re
import zlib
from collections import Counter

import pytest

from beaconaudit.llm import spelling
from tests.llm.conftest import edge_rows


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def buckets_of(words, shortest, splits):
    """Buckets as (m, lo, hi, words), every range halved so many times."""
    found = {}

    def put(word, m, lo, hi, left):
        if left and hi - lo > 1:
            put(word, m, lo, (lo + hi) // 2, left - 1)
            put(word, m, (lo + hi) // 2, hi, left - 1)
        else:
            found.setdefault((m, lo, hi, word[:lo], word[len(word) - max(m - hi, 0):]), []).append(word)

    for word in words:
        for m in (len(word) - 1, len(word)):
            if m >= shortest:
                put(word, m, 0, m + 1, splits)
    return [(*key[:3], some) for key, some in sorted(found.items())]


@pytest.mark.parametrize("splits", [0, 1, 2, 9])
def test_pairs_against_all_pairs(splits):
    rng = random.Random(splits)
    for _ in range(60):
        shortest, more, letters = rng.choice([1, 2, 6]), rng.choice([3, 8]), rng.choice(["ab", "abé", "aÿ𐐀"])
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(shortest, shortest + more))) for _ in range(rng.choice([1, 40, 120]))}
        found = [(w[i], w[j]) for w, a, b in spelling.pairs(buckets_of(words, shortest, splits)) for i, j in zip(a.tolist(), b.tolist())]
        assert sorted(found) == sorted((a, b) for a in words for b in words if near(a, b))


def test_few_lookups_at_a_time(monkeypatch):
    monkeypatch.setattr(spelling, "_LOOKUPS", 3)
    test_pairs_against_all_pairs(2)


def test_long_words():
    word = "ab" * 3000
    words = [word, word[1:], word[:2500] + "c" + word[2501:], word + "cc", "z" * 5000]
    found = [(w[i], w[j]) for w, a, b in spelling.pairs(buckets_of(words, 6, 1)) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(found) == sorted((a, b) for a in words for b in words if near(a, b))


def plain_words(rows, shortest=6, fewest=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= fewest}


def plain(counts, times=5):
    form, found = {}, []
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        if others and -others[0][0] >= times * n:
            form[w] = others[0][1]
        found.append((w, len(others)))
    rows = []
    for w, n_near in found:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, counts[w], n_near, counts.get(form.get(w))))
    return sorted(rows)


def edge_documents():
    rng = random.Random(4)
    rows = [r[:2] for r in edge_rows()]
    # a third of all runs are one word; chains of forms, ties, the limits of n, marks and capitals, doubled rows
    rows += [(100 + i, "Relative " * 60 + "relatives " * 9 + "relativess raletive RELATIVE× ") for i in range(6)]
    rows += [(200 + i, " ".join(rng.choice(["garden", "garten", "gardenÉ", "jardin", "gardin", "gar-den", "Çgarden"]) for _ in range(40))) for i in range(30)]
    return rows + [(300, "xyzzyx" * 9000 + " " + "tenfold tenfolds " * 5)] * 2


@pytest.mark.parametrize("limit", [2, 20_000])
def test_edges(spark, limit):
    rows = edge_documents()
    frame = spark.createDataFrame([(*r, 1, "w", "x") for r in rows], "doc_id long, text string, n long, word string, m string").repartition(3)
    words = spelling.vocabulary(frame)
    counts = plain_words(rows)
    assert len(counts) > 10 and {r["word"]: r["n"] for r in words.collect()} == counts
    found = sorted((tuple(r) for r in spelling.group(words, limit=limit).collect()))
    assert found == plain(counts) and any(f for _, f, *_ in found)
    assert spelling.group(spelling.vocabulary(frame.where("1 = 0"))).count() == 0


def test_buckets_are_bounded_by_halving(spark):
    rng = random.Random(2)
    words = sorted({"common" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    held = spelling.buckets(frame, limit=40).groupBy(*spelling._KEY).count().agg({"count": "max"}).first()[0]
    assert held <= 40
    found = {r["word"]: r["n_near"] for r in spelling.near_words(frame, limit=40).collect()}
    assert found == {w: n for w in words if (n := sum(near(w, x) for x in words))}


def test_chains_of_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(19)] + [(f"x{i}", "w3") for i in range(50)]
    found = spelling.roots(spark.createDataFrame(links, "word string, form string"))
    assert {r["word"]: r["root"] for r in found.collect()} == {w: "w19" for w, _ in links}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_what_grows_with_the_vocabulary_is_not_broadcast(spark, monkeypatch):
    plans, kept = [], spelling.stored

    def seen(frame):
        plans.append(frame._jdf.queryExecution().sparkPlan().toString())
        return kept(frame)

    monkeypatch.setattr(spelling, "stored", seen)
    links = [(f"word{i:04}", "wordform" if i else "wordforms") for i in range(400)] + [("wordform", "word0000")]
    found = spelling.roots(spark.createDataFrame(links, "word string, form string"))
    assert {r["root"] for r in found.collect()} == {"wordforms"} and found.count() == 401
    followed = [p for p in plans if "further" in p]
    # the keys that are heavy, at most one per task, are; the links are not
    assert followed and all("SortMergeJoin [root#" in p and "__salt#" in p.split("SortMergeJoin [root#")[1].split("\n")[0] for p in followed)
    words = spark.createDataFrame([(w, 9) for w, _ in links[:40]] + [("wordform", 900)], "word string, n long")
    last = spelling.group(words)
    assert "BroadcastHashJoin" not in last._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in next(p for p in plans if "n_near" in p and "form_n" in p)
