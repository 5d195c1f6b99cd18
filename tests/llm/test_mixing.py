import math

import pytest

from beaconaudit.llm import mixing
from tests.llm.conftest import edge_rows


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 1, "b": 1}, {"a": 9, "b": 1}, {"a": 10, **{f"s{i}": 1 for i in range(10)}},
                                    {"a": 7, "b": 5, "c": 3, "d": 2, "e": 1}, {"a": 50, "b": 33, "c": 17, "d": 1}])
def test_windows_and_deviation(spark, shares):
    """Every block lies between release and deadline, and no prefix is a block off its weights."""
    rows = mixing.schedule(spark.createDataFrame(list(shares.items()), "key string, c int")).collect()
    q = sum(shares.values())
    assert sorted(t for r in rows for t in r["slots"]) == list(range(q))
    for r in rows:
        assert r["q"] == q and len(r["slots"]) == shares[r["key"]] == r["c"]
        for k, t in enumerate(r["slots"]):
            assert math.floor(k * q / r["c"]) <= t < math.ceil((k + 1) * q / r["c"])
        for t in range(q + 1):
            assert abs(sum(s < t for s in r["slots"]) - t * r["c"] / q) < 1


def test_the_mix_follows_the_weights_while_sources_last(spark):
    rows = [(i, "big") for i in range(4000)] + [(5000 + i, "small") for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, source string").repartition(7)
    found = sorted((r["position"], r["source"], r["doc_id"]) for r in mixing.mix(frame, {"big": 1, "small": 1}, block=4).collect())
    assert [p for p, _, _ in found] == list(range(4800)) and len({i for _, _, i in found}) == 4800
    for at in range(0, 1600, 4):
        assert abs(sum(s == "small" for _, s, _ in found[:at]) - at / 2) < 4 + 1
    assert {s for _, s, _ in found[1600:]} == {"big"}


def test_edges(edge, no_documents):
    found = mixing.mix(edge).collect()
    assert sorted(r["position"] for r in found) == list(range(len(edge_rows())))
    assert sorted(str((r["doc_id"], r["source"])) for r in found) == sorted(str((r[0], r[2])) for r in edge_rows())
    mixed = mixing.in_mixed_order(edge)
    assert mixed.columns == edge.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in mixed.collect()) == sorted(str(r[:2]) for r in edge_rows())
    assert mixing.mix(no_documents).count() == mixing.in_mixed_order(no_documents).count() == 0


def test_written_files_are_in_mixed_order(edge, tmp_path):
    mixing.in_mixed_order(edge).write.parquet(str(tmp_path / "out"))
    first = {}
    for r in mixing.mix(edge).collect():
        first[r["doc_id"]] = min(r["position"], first.get(r["doc_id"], 1 << 30))
    order = [r["doc_id"] for f in sorted((tmp_path / "out").glob("part-*.parquet")) for r in edge.sparkSession.read.parquet(str(f)).collect()]
    assert [first[i] for i in order] == sorted(first[i] for i in order)


def test_no_python_in_the_plan(edge):
    plan = mixing.in_mixed_order(edge)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_places_are_merged_with_the_texts(edge):
    """Places have a row per document, so no size of theirs may send them through the driver."""
    places = mixing.in_mixed_order(edge)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in places
