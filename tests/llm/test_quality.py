import re
from collections import Counter

from beaconaudit.llm import quality
from tests.llm.conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    counts = (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered))
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def test_counts(spark):
    texts = [r[1] for r in edge_rows()] + ["a b c a b c", "a b a b a b a", "x#*y $% & |<>", "a\n a\na\n\n\n", "😀 é b c", "w " * 5000, "a b c d"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", quality.F.lit("s"))
    found = {r["doc_id"]: tuple(r[c] for c in (*quality.FEATURES, "base_failed")) for r in quality.judge(frame).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}


def test_edges(edge, no_documents):
    rows = quality.judge(edge).collect()
    assert len(rows) == len(edge_rows())
    assert all(r["host_failed"] is None for r in rows if r["source"] is None)
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert quality.judge(no_documents).count() == quality.keep_good(no_documents).count() == 0


def test_hosts_shrink_towards_the_corpus(spark):
    rows = [("good", False)] * 95 + [("good", True)] * 5 + [("bad", True)] * 60 + [("one", True)] + [(None, True)] * 9
    rows += [(f"h{i}", j == 0) for i in range(8) for j in range(30)]
    found = {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert None not in found
    assert found["bad"]["host_failed"] and not found["good"]["host_failed"]
    assert found["bad"]["host_rate"] < 1 and found["one"]["host_rate"] < found["bad"]["host_rate"]


def test_a_rejected_host_takes_its_good_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(40)] + [(40, good, "bad")] + [(50 + i, good, "fine") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in quality.keep_good(frame).collect()} == set(range(50, 90))


def test_no_python_in_the_plan(edge):
    plan = quality.keep_good(edge)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
