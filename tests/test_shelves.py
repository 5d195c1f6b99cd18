import random

import pytest
from pyspark.sql import functions as F

from beaconaudit.operators import report, shelves
from beaconaudit.operators.store import new_folder
from beaconaudit.plans.scan import scan_files

BASE = "https://github.com/example"


@pytest.fixture(scope="module")
def findings(spark):
    """One project with most of the findings, many small ones, and a rare word."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "größe", "naïve"]
    files = []
    for i in range(60):
        project = "hot" if i % 3 else f"p{i}"
        lines = [f"logger.info('{rng.choice(words)} {rng.choice(words)} {i}');" for _ in range(20)]
        files.append((f"/r/{project}", f"/r/{project}/src/f{i}.ts", "\n".join(lines + (["logger.warn('Zebra''s crossing');"] if i == 30 else []))))
    files = spark.createDataFrame(files, "project_path string, path string, content string")
    return scan_files(files, base_url=BASE)


@pytest.fixture(scope="module")
def shelved(findings):
    return shelves.shelve(findings, part_rows=40)


def rows(frame):
    return sorted((r["file_path"], r["line_number"]) for r in frame.collect())


@pytest.mark.parametrize("term, project, category", [
    ("zebra", "", ""), ("ZEBRA'S", "", ""), ("größe", "", ""), ("alpha beta", "", ""), ("al", "", ""), ("", "hot", ""), ("gamma", "p30", ""),
    ("nothing like it", "", ""), ("delta", "hot", "system_data"), ("delta", "", "user_data"), ("", "", ""), ("view on github copy", "", "")])
def test_same_rows_as_a_search_of_everything(findings, shelved, term, project, category):
    found = shelves.search(shelved, term, project, category)
    assert found.columns == findings.columns
    assert rows(found) == rows(report.search(findings, term, project, category))


def test_the_rarer_the_term_the_fewer_files(shelved):
    def files(term, project=""):
        """Files that a scan of the candidates opens."""
        plan = shelves.candidates(shelved, term, project)._jdf.queryExecution().executedPlan()
        plan.execute().count()
        leaf = plan.collectLeaves().head()
        return leaf.metrics().apply("numFiles").value() if "FileScan" in leaf.toString() else 0

    every = files("")
    assert every > 20 and files("logger") == every
    assert files("zebra") == 1 and files("nothing like it") == 0
    assert files("zebra", "hot") == 0 and 0 < files("", "p30") < every // 4


def test_a_project_is_read_from_its_shelf(spark, shelved, findings):
    kept = shelves.of_project(shelved, "p30")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan and rows(kept) == rows(report.by_project(findings, "p30"))
    projects = spark.createDataFrame([("hot", "/r/hot"), ("p30", "/r/p30"), ("none", "/r/none")], "name string, path string")
    for name in ("hot", "none", "", None):
        ours, ours_counted = shelves.filter_project(shelved, projects, name)
        theirs, theirs_counted = report.filter_project(findings, projects, name)
        assert rows(ours) == rows(theirs)
        if name:
            assert ours_counted.collect() == theirs_counted.collect()


def test_a_large_project_fills_many_parts(shelved):
    sizes = [r["count"] for r in shelved.findings.groupBy("shelf", "part").count().collect()]
    hot = shelved.findings.where("project_name = 'hot'").select("part").distinct().count()
    assert max(sizes) < 120 and hot > 10


def test_more_parts_than_a_plan_names(shelved, findings, monkeypatch):
    monkeypatch.setattr(shelves, "MOST_NAMED", 2)
    assert rows(shelves.search(shelved, "alpha")) == rows(report.search(findings, "alpha"))


def test_written_shelves_are_opened_again(spark, findings):
    folder = new_folder(spark)
    written = shelves.shelve(findings.where("project_name != 'hot'"), folder, part_rows=30)
    opened = shelves.open_shelves(spark, folder)
    assert opened.shelves == written.shelves and rows(shelves.search(opened, "zebra")) == rows(shelves.search(written, "zebra")) != []


def test_no_findings(findings):
    empty = shelves.shelve(findings.where("1 = 0"))
    assert shelves.search(empty, "alpha").count() == 0 and shelves.of_project(empty, "hot").count() == 0


def test_very_many_parts_share_directories(findings, monkeypatch):
    monkeypatch.setattr(shelves, "MOST_FILES", 3)
    kept = shelves.shelve(findings, part_rows=40)
    assert kept.findings.select("file").distinct().count() <= 3
    assert kept.findings.select("shelf", "part").distinct().count() >= 30
    for term in ("zebra", "größe", "al", "nothing like it"):
        assert rows(shelves.search(kept, term)) == rows(report.search(findings, term))
    assert {r["count"] <= 40 for r in kept.findings.groupBy("shelf", "part").count().collect()} == {True}


def test_postings_are_the_trigrams_of_each_text(spark, shelved):
    import pyarrow as pa

    texts = ["abc\0", "", "xy", None, "äö😀ü", "bcd", "abc"]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5 + [2] * 2, pa.int32()), pa.array([7] * 7, pa.int64()), pa.array(texts)], names=["shelf", "part", "shown"])
    found = [r for b in shelves._postings(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert sorted((r["shelf"], r["gram"]) for r in found) == sorted(
        {(s, t[i:i + 3]) for s, t in zip([1] * 5 + [2] * 2, texts) if t for i in range(len(t) - 2)})
