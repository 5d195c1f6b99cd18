import pytest
from pyspark.sql import functions as F

from beaconaudit import scan_directories
from beaconaudit.operators.store import stored
from beaconaudit.plans import scan as plans
from beaconaudit.sources import corpus, overlaps

BASE = "https://github.com/example"
CODE = "logger.info('x')\nlogger.error('y')"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "root string, path string, content string")


def counted(result):
    return sorted((r["root"], r["path"], r["findings_count"]) for r in result.projects.collect())


def scan_rows(spark, rows, **options):
    files = rows_of(spark, rows)
    return plans.scan(files.select("root", "path", F.lit(False).alias("is_dir")), files, base_url=BASE, **options)


def test_a_file_of_several_roots_is_searched_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(plans, "detect", lambda files, *a, f=plans.detect: seen.append(files) or f(files, *a))
    rows = [(root, f"/w/a/b/{n}.ts", CODE) for root in ("/w", "/w/a", "/w/a/b") for n in range(5)]
    rows += [("/w", "/w/a/package.json", "{}"), ("/w/a", "/w/a/package.json", "{}"), ("/w/a/b", "/w/a/b/package.json", "{}")]
    result = scan_rows(spark, rows)
    assert [r["path"] for r in seen[0].select("path").orderBy("path").collect()] == [f"/w/a/b/{n}.ts" for n in range(5)]
    assert counted(result) == [("/w", "/w/a", 10), ("/w/a", "/w/a", 10), ("/w/a/b", "/w/a/b", 10)]
    assert result.findings.count() == 30 and "digest" not in result.findings.columns


def test_same_path_with_another_text_is_another_file(spark):
    rows = [("/w", "/w/a/x.ts", CODE), ("/w/a", "/w/a/x.ts", CODE + "\nlogger.warn('z')"), ("/w", "/w/a/y.ts", CODE), ("/w/a", "/w/a/y.ts", CODE),
            ("/w", "/w/a/package.json", "{}"), ("/w/a", "/w/a/package.json", "{}")]
    assert counted(scan_rows(spark, rows)) == [("/w", "/w/a", 4), ("/w/a", "/w/a", 5)]
    texts, shared = plans.each_once(rows_of(spark, rows[:4]))
    assert sorted((r["root"], r["path"]) for r in texts.collect()) == [("/w", "/w/a/x.ts"), ("/w", "/w/a/y.ts"), ("/w/a", "/w/a/x.ts")]
    assert [(r["path"], r["root"], [tuple(x) for x in r["roots"]]) for r in shared.collect()] == [("/w/a/y.ts", "/w", [(2, "/w", 1), (4, "/w/a", 1)])]


def test_a_root_is_scanned_as_often_as_it_is_given(spark):
    rows = [("/w", "/w/package.json", "{}")] + [("/w", "/w/x.ts", CODE)] * 2 + [("/w/a", "/w/x.ts", CODE)] * 3 + [("/w/a", "/w/package.json", "{}")]
    result = scan_rows(spark, rows)
    assert sorted((r["root"], r["count"]) for r in result.findings.groupBy("root").count().collect()) == [("/w", 4)]
    found = rows_of(spark, [("/w", "/w/x.ts", "t")] * 2).select("root", "path", F.md5("content").alias("digest"), F.lit(1).alias("line_number"))
    given = rows_of(spark, [("/w", "/w/x.ts", "t")] * 2 + [("/w/a", "/w/x.ts", "t")] * 3)
    shared = overlaps.shared_files(given.select("root", "path", F.md5("content").alias("digest")))
    placed = overlaps.to_all_roots(found, shared)
    assert sorted(r["root"] for r in placed.collect()) == ["/w"] * 2 + ["/w/a"] * 3


def test_what_one_root_ignores_another_may_scan(spark):
    rows = [("/w", "/w/package.json", "{}"), ("/w", "/w/dist/src/x.ts", CODE), ("/w/dist", "/w/dist/src/x.ts", CODE), ("/w/dist", "/w/dist/package.json", "{}")]
    assert counted(scan_rows(spark, rows, user_globs=["dist/**"])) == [("/w", "/w", 0), ("/w/dist", "/w/dist", 2)]


def test_without_shared_paths_nothing_is_hashed(spark):
    files = rows_of(spark, [("/a", "/a/x.ts", CODE), ("/b", "/b/x.ts", CODE), ("/b", "/b/null.ts", None)])
    texts, shared = plans.each_once(files)
    assert shared is None and texts.columns == files.columns and texts.count() == 2
    none, shared = plans.each_once(files.where("1 = 0"))
    assert shared is None and none.count() == 0


def test_contents_meet_only_roots(spark, monkeypatch):
    """Below the detection contents are joined to names of roots, by a broadcast."""
    files = stored(rows_of(spark, [(root, f"/w/a/{n}.ts", CODE) for root in ("/w", "/w/a") for n in range(9)]))
    texts, _ = plans.each_once(files)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [root" in plan and "SortMergeJoin" not in plan and plan.count("Join [") == 1


@pytest.fixture
def tree(tmp_path):
    for name, text in (("web/package.json", "{}"), ("web/src/a.ts", CODE), ("web/lib/package.json", "{}"), ("web/lib/b.ts", CODE)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_directories_are_opened_once(spark, tree, monkeypatch):
    opened = []
    monkeypatch.setattr(corpus, "read_listed", lambda listed, f=corpus.read_listed: opened.append(listed) or f(listed))
    result = scan_directories(spark, [str(tree), str(tree / "web"), str(tree / "web/lib")], base_url=BASE)
    names = sorted(r["path"].removeprefix(str(tree)) for r in opened[-1].collect())
    assert names == ["/web/lib/b.ts", "/web/src/a.ts"]
    found = [(root.removeprefix(str(tree)), path.removeprefix(str(tree)), n) for root, path, n in counted(result)]
    assert found == [("", "/web", 4), ("/web", "/web", 4), ("/web/lib", "/web/lib", 2)]
