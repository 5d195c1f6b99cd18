import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from beaconaudit import derived, detect, scan_files
from beaconaudit.operators import findings as findings_of, report
from beaconaudit.sinks import exports
from beaconaudit.sources import corpus
from beaconaudit.sources.projects import count_findings

BASE = "https://github.com/example"


@pytest.fixture(scope="module")
def findings(spark):
    files = spark.createDataFrame([
        ("/r/one", "/r/one/src/a.ts", "logger.info('say \"hi\", é')\nx\ndatadogRum.addAction('tap', b)\nlogger.error('bad')"),
        ("/r/one", "/r/one/src/b.ts", "import a from '@datadog/browser-rum'\n"),
        ("/r/two", "/r/two/c.cs", 'x.Rum.AddError("no\\\\way");\nx.ClearAllData();\nsdk.Rum.AddAction("", x);// logger.info'),
    ], "project_path string, path string, content string")
    return scan_files(files, base_url=BASE).cache()


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame([("one", "/r/one", "react", f"{BASE}/one"), ("two", "/r/two", "unity", f"{BASE}/two"),
                                  ("none", "/r/none", "node", f"{BASE}/none")],
                                 "name string, path string, project_type string, github_url string")


def test_counts(findings, projects):
    assert {r["name"]: r["findings_count"] for r in count_findings(projects, findings).collect()} == {"one": 4, "two": 3, "none": 0}
    stats = {(r["dimension"], r["value"]): (r["findings"], r["files"]) for r in report.statistics(findings).collect()}
    assert stats[("total", None)] == (7, 3) and stats[("project", "one")] == (4, 2)
    assert sum(n for (d, _), (n, _) in stats.items() if d == "category") == 7
    assert sum(n for (d, _), (n, _) in stats.items() if d == "operation") == 7
    summary = [(r["data_category"], r["findings"]) for r in report.category_summary(findings).collect()]
    assert summary == sorted(summary) and sum(n for _, n in summary) == 7
    assert report.files_with_findings(findings).first()[0] == 3


def test_filters(findings, projects):
    kept, counted = report.filter_data_type(findings, projects, "error-data")
    assert kept.count() == 2 and {r["name"]: r["findings_count"] for r in counted.collect()} == {"one": 1, "two": 1, "none": 0}
    for unknown in ("no-such-data", "", None):
        assert report.filter_data_type(findings, projects, unknown)[0] is findings
    kept, counted = report.filter_project(findings, projects, "two")
    assert kept.count() == 3 and [(r["name"], r["findings_count"]) for r in counted.collect()] == [("two", 3)]
    assert report.by_operation(findings, "import").count() == 1
    assert report.by_category(findings, "user_data").count() == report.search(findings, category="user_data").count()


def test_search(findings):
    def lines(**given):
        return {(r["file_path"][-4:], r["line_number"]) for r in report.search(findings, **given).collect()}

    assert lines(term="A.TS") == {("a.ts", 1), ("a.ts", 3), ("a.ts", 4)}
    assert lines(term="line 4") == {("a.ts", 4)}
    assert lines(term="clearall", project="two", operation="configuration") == {("c.cs", 2)}
    # line 4 is the last context line of lines 1 and 3, which is not shown, but it shows in its own snippet
    assert lines(term="'bad'") == {("a.ts", 4)}
    assert len(lines()) == 7


def test_order_and_groups(findings, projects):
    ordered = [(r["project_name"], r["file_path"], r["line_number"]) for r in report.report_order(findings, projects).collect()]
    assert ordered == sorted(ordered) and len(ordered) == 7
    grouped = report.grouped_rows(findings, "project").collect()
    assert [r["project_name"] for r in grouped] == ["one"] * 4 + ["two"] * 3
    assert {r["group_size"] for r in grouped if r["project_name"] == "one"} == {4}
    assert report.union_scans(findings, findings).count() == 14


def test_csv_export(findings, tmp_path):
    exports.write_csv(findings, str(tmp_path / "csv"))
    rows = [row for part in glob.glob(str(tmp_path / "csv" / "*.csv")) for row in csv.DictReader(open(part, encoding="utf-8", newline=""))]
    assert len(rows) == 7 and list(rows[0]) == list(exports.TABLE_COLUMNS)
    by_place = {(r["File Path"][-4:], r["Line Number"]): r for r in rows}
    data = {(r["file_path"][-4:], str(r["line_number"])): r["data_being_sent"] for r in findings.collect()}
    for place, row in by_place.items():
        assert json.loads(row["Data Being Sent"]) == data[place]
    assert by_place[("c.cs", "1")]["Data Being Sent"].startswith('{"action_type": "Custom", "action_name": "no')


def test_json_document_is_one_document(findings, projects, spark, tmp_path):
    doubled = report.union_scans(findings, findings)
    totals = spark.createDataFrame([(9,)], "total_files_scanned long")
    exports.write_document(count_findings(projects, findings), doubled, totals, 1.5, str(tmp_path / "doc"))
    text = "\n".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(str(tmp_path / "doc" / "part-*"))))
    document = json.loads(text)
    assert list(document) == ["projects", "findings", "total_files_scanned", "scan_duration"]
    assert len(document["findings"]) == 14 and len(document["projects"]) == 3
    assert (document["total_files_scanned"], document["scan_duration"]) == (9, 1.5)
    assert set(document["findings"][0]) == set(findings.columns)
    empty = json.loads("\n".join(r["line"] for r in exports.document_lines(
        projects.limit(0), findings.limit(0), totals, 0.0).orderBy(*exports.document_order()).collect()))
    assert empty["findings"] == [] and empty["projects"] == []


def test_tasks_of_a_document_grow_in_number_with_its_items(spark, projects, monkeypatch):
    monkeypatch.setattr(exports, "ITEM_ROWS", 50)
    text = "\n".join(f"logger.info('line {i}');" for i in range(1000))
    found = scan_files(spark.createDataFrame([("/r/one", "/r/one/a.ts", text)], "project_path string, path string, content string"), base_url=BASE).cache()
    items = exports.document_lines(count_findings(projects, found), found, spark.range(1).toDF("total_files_scanned"), 0.0).where("section = 3")
    loads = [r["count"] for r in items.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(loads) == 1000 and max(loads) < 200


def test_text_is_made_once_and_above_a_shuffle(spark):
    files = spark.range(3).selectExpr("concat('/r/p/', id, '.ts') AS path", "cast(id AS string) AS text").hint("rebalance")
    files = files.selectExpr("path", "concat('logger.', text) AS content")
    plan = corpus.keyword_filter(corpus.decoded(files).where("length(content) > 0"))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions")
    assert "Filter" in above and "Filter" not in below and plan.count("concat(logger.") == 1


def test_rules_alone_look_for_no_symbols(spark):
    text = "import track from '@datadog/browser-rum';\ntrack(1);\nlogger.info('a');"
    files = spark.createDataFrame([("/r/p/a.ts", text)], "path string, content string")
    for made in (findings_of.rule_hits(files), findings_of.rule_findings(files)):
        assert "symbol_test" not in made._jdf.queryExecution().optimizedPlan().toString()
        assert sorted({(r["line_number"], r["family"]) for r in made.collect()}) == [(1, "imports"), (3, "log_info")]


def test_json_lines_and_report_tables(findings, projects, spark, tmp_path):
    exports.write_json(findings, projects, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/findings")).count() == 7
    totals = spark.createDataFrame([(9,)], "total_files_scanned long")
    exports.write_report(findings, projects, totals, str(tmp_path / "report"))
    read = spark.read.parquet
    assert read(str(tmp_path / "report/by_category")).groupBy("group").count().count() == report.category_summary(findings).count()
    assert {(r["metric"], r["value"]) for r in read(str(tmp_path / "report/totals")).collect()} == {
        ("projects", 3), ("files_scanned", 9), ("findings", 7)}
    assert read(str(tmp_path / "report/statistics")).count() == report.statistics(findings).count()


def test_detection_takes_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("/p/a.ts", "logger.info('x')")], "path string, content string").write.parquet(source)
    stream = detect(spark.readStream.schema("path string, content string").parquet(source))
    assert stream.isStreaming
    running = stream.writeStream.format("memory").queryName("found").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert spark.table("found").count() == 1


def test_heavy_keys_are_salted_in_proportion(spark):
    """A key with a third of the rows fills a third of 211 tasks; other keys and their facts stay as they are."""
    from beaconaudit.operators import joins
    from beaconaudit.operators.store import stored
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = stored(spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 1000 = 1 THEN NULL ELSE concat('k', id % 700) END AS k", "id"))
        heavy = {r["k"]: r["salts"] for r in joins.heavy_keys(rows, ["k"], 211).collect()}
        assert set(heavy) == {"hot"} and 70 <= heavy["hot"] <= 71
        facts = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, fact int")
        joined = joins.attach_measured(rows, facts, "k", ("id",))
        plain = rows.join(facts, "k", "left")
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.select(*joined.columns).collect()))
        inner = joins.attach_measured(rows, facts, "k", ("id",), how="inner")
        assert inner.count() == rows.join(facts, "k").count()
        from pyspark.sql import functions as F
        tasks = joined.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 40
        assert joins.attach_measured(rows.where("false"), facts, "k", ("id",)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_wanted_columns_are_those_of_whole_findings(spark):
    text = "\n".join(["import track from '@datadog/browser-rum';", "track(1);", "logger.info('a'); datadogRum.addAction('a longer name');", "logger.warn('b')",
                       "DD_RUM.addError(new Error('x')); logger.error('it is a much longer message');", "const a = 1;"])
    files = spark.createDataFrame([("/r/p/a.ts", text), ("/r/p/b.cs", 'x.Rum.AddError("no"); logger.Info("and more of it");\nx.ClearAllData();')], "path string, content string")
    whole = detect(files)
    for some in (("line_number",), ("line_number", "family"), ("line_number", "operation_type"), ("line_number", "data_category"),
                 ("line_number", "code_snippet", "context_lines"), ("line_number", "repr_length"), ("line_number", "data_being_sent")):
        assert (sorted(map(str, detect(files, wanted=some).select("path", *some).collect()))
                == sorted(map(str, whole.select("path", *some).collect()))), some
    assert "named_struct(length" not in detect(files, wanted=("line_number",))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [20_000, 0])
def test_groups_of_a_report_are_whole_sorted_and_not_shuffled(findings, projects, spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(exports, "MOST_FILES", most)
    ranged, plain = [], type(findings).repartitionByRange
    monkeypatch.setattr(type(findings), "repartitionByRange", lambda self, *keys: ranged.append(keys) or plain(self, *keys))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    exports.write_report(findings, projects, spark.createDataFrame([(9,)], "total_files_scanned long"), str(tmp_path / "report"))
    assert len(ranged) == (0 if most else 3) and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    for by, column in report.GROUPINGS.items():
        rows = spark.read.parquet(str(tmp_path / f"report/by_{by}")).select(
            "group", column, "file_path", "line_number", F.input_file_name().alias("file")).collect()
        assert len(rows) == findings.count() and all(r["group"] == r[column] for r in rows)
        for file in {r["file"] for r in rows}:
            places = [(r["file_path"], r["line_number"]) for r in rows if r["file"] == file]
            assert places == sorted(places)


def test_hints_are_looked_for_once_per_line(spark):
    files = spark.createDataFrame([("/r/p/a.cs", "sdk.Rum.AddAction(\"a\");\nRUM.ADDACTION(\nnothing\nl.Info(1); l.Warn(2);")], "path string, content string")
    for made in (findings_of.rule_hits(files), detect(files), detect(files, wanted=("line_number",))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        generate = next(line for line in plan.split("\n") if "Generate" in line)
        # once for each language, whatever its families, patterns and ways of reading
        assert plan.count(", .adderror)") == 2 or generate.count(", .adderror)") == 2
        assert sorted({r["line_number"] for r in made.collect()}) == [1, 4]


def test_tasks_of_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    for name, rows in (("documents", "id AS doc_id, concat('text ', id) AS text, 'en' AS lang, 'src1' AS source, 9L AS n_chars"),
                       ("events", "id AS event_id, id % 7 AS user_id, 'view' AS event_type, '{}' AS props")):
        spark.sql(f"SELECT {rows} FROM range(0, 5000, 1, 1)").write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(derived, "DOCUMENT_BYTES", 1000)
    monkeypatch.setattr(derived, "EVENT_BYTES", 2000)
    sf = str(tmp_path)
    for files, n in ((derived.document_files(spark, sf), 1000), (derived.event_files(spark, sf), 2000)):
        name = "documents" if n == 1000 else "events"
        tasks = derived.tasks_of(spark, f"{sf}/{name}.parquet", n)
        assert tasks > 4 and files.rdd.getNumPartitions() == tasks
        assert files.count() == (5000 if n == 1000 else 79)
