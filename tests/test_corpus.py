import os

import pytest
from pyspark.sql import functions as F

from beaconaudit import LEGACY, LIVE, detect, register_rules, rules, scan_directories
from beaconaudit.functions import urls
from beaconaudit.functions.globs import ignore_pattern
from beaconaudit.operators import joins
from beaconaudit.operators.store import stored
from beaconaudit.plans.scan import scan
from beaconaudit.sources import corpus, projects, repos

BASE = "https://github.com/example"


def one(spark, value, column, name="x"):
    return spark.createDataFrame([(value,)], f"{name} {'binary' if isinstance(value, bytes) else 'string'}").select(column).first()[0]


def test_routing(spark):
    names = ["a.ts", "a.TSX", "b.min.js", ".ts", "x/.js", "a.cs", "a.py", "noext", "d.ts/file", "a.b.JSX"]
    frame = spark.createDataFrame([("/p/" + n,) for n in names], "path string")
    got = {r["path"][3:] for r in corpus.route(frame).collect()}
    assert got == {"a.ts", "a.TSX", "b.min.js", "a.cs", "a.b.JSX"}
    legacy = {r["path"][3:] for r in corpus.route(frame, LEGACY).collect()}
    assert legacy == {"a.ts", "b.min.js"}


def test_decode(spark):
    cases = [("a\r\nb\rc".encode(), "a\nb\nc"), ("né".encode(), "né"), ("né".encode("latin-1"), "né"), (b"", "")]
    for raw, text in cases:
        found = corpus.decoded(spark.createDataFrame([(raw,)], "content binary"))
        assert found.first()[0] == text


def test_keyword_filter(spark):
    frame = spark.createDataFrame([("1", "import x from 'DATADOG'"), ("2", "const a = useState()"), ("3", "logger.warn('x')"),
                                   ("4", "logger.Error(x)"), ("5", "ADDTIMING")], "path string, content string")
    assert {r["path"] for r in corpus.keyword_filter(frame).collect()} == {"1", "4", "5"}


@pytest.mark.parametrize("globs, kept", [
    (["node_modules/**", "build/**"], {"src/test.ts", "src/a.min.js", "x/builds/a.ts"}),
    (["*.min.js"], {"src/test.ts", "node_modules/package/test.js", "build/test.js", "x/build/y.ts", "x/builds/a.ts"}),
    (["src/*.ts"], {"src/a.min.js", "node_modules/package/test.js", "build/test.js", "x/build/y.ts", "x/builds/a.ts"}),
    (["[bx]*/test.?s"], {"src/test.ts", "src/a.min.js", "node_modules/package/test.js", "x/build/y.ts", "x/builds/a.ts"}),
    ([], {"src/test.ts", "src/a.min.js", "node_modules/package/test.js", "build/test.js", "x/build/y.ts", "x/builds/a.ts"}),
])
def test_ignore_globs(spark, globs, kept):
    names = ["node_modules/package/test.js", "build/test.js", "src/test.ts", "src/a.min.js", "x/build/y.ts", "x/builds/a.ts"]
    frame = spark.createDataFrame([("/p", "/p/" + n) for n in names] + [("/p", "/elsewhere/src/a.ts")],
                                  "project_path string, path string")
    assert {r["path"][3:] for r in corpus.ignore_filter(frame, globs).collect()} == kept


def test_glob_without_anything_left_matches_no_component():
    assert ignore_pattern(["**"]) == r"(?s)\A(?:.*.*)\z"


def test_project_types(spark):
    rows = [("a", '{"dependencies": {"react": "1"}}', True, False, False, False, "react"),
            ("b", '{"dependencies": {"react": "1"}, "devDependencies": {"next": "1"}}', True, False, False, False, "nextjs"),
            ("c", '{"dependencies": {"express": "1"}}', True, True, True, False, "node"), ("d", "{bad", True, False, False, False, "node"),
            ("i", "{'dependencies': {'react': '1'}}", True, False, False, False, "node"),
            ("j", '{"dependencies": {"react": "1"}} trailing', True, False, False, False, "node"),
            ("k", '{"dependencies": {"react": "1"}}],[', True, False, False, False, "node"),
            ("l", ' {"dependencies": {"react": "1"}, "files": ["a"]}\n', True, False, False, False, "react"),
            ("e", None, True, False, False, False, "node"), ("f", None, False, True, True, False, "unity"),
            ("g", None, False, False, False, True, "unity"), ("h", None, False, True, False, False, "unknown")]
    frame = spark.createDataFrame(rows, "k string, m string, a boolean, b boolean, c boolean, d boolean, want string")
    for r in frame.select("k", "want", projects.project_type(*[F.col(c) for c in "mabcd"]).alias("got")).collect():
        assert r["got"] == r["want"], r["k"]


def test_discovery(spark):
    listing = spark.createDataFrame([
        ("/w", "/w/project1/package.json", False), ("/w", "/w/project2/src", True), ("/w", "/w/.hidden/src/a.ts", False),
        ("/w", "/w/plain/readme.md", False), ("/w", "/w/deep/lib/package.json", False), ("/w", "/w/file.ts", False),
        ("/self", "/self/App.csproj", False), ("/self", "/self/child/package.json", False),
    ], "root string, path string, is_dir boolean")
    manifests = spark.createDataFrame([("/w/project1", '{"dependencies": {"next": "1"}}')], "project_path string, content string")
    got = {(r["name"], r["path"], r["project_type"], r["github_url"]) for r in projects.discover(listing, manifests, BASE).collect()}
    assert got == {("project1", "/w/project1", "nextjs", f"{BASE}/project1"), ("project2", "/w/project2", "unknown", f"{BASE}/project2"),
                   ("self", "/self", "unity", f"{BASE}/self")}


def test_effective_globs(spark):
    frame = spark.createDataFrame([("react",), ("unity",), ("unknown",), ("react",)], "project_type string")
    got = projects.collect_globs(frame, ("custom/**", "dist/**"))
    assert got == sorted({*rules.IGNORE_GLOBS["react"], *rules.IGNORE_GLOBS["unity"], "custom/**"})


def test_branches_and_repository_facts(spark):
    meta = spark.createDataFrame([("1", "feature\n", "refs/remotes/origin/x", " https://h/r\n", "0123456789abcdef"),
                                  ("2", None, "refs/remotes/origin/develop", None, None), ("3", " ", "", None, "abc")], repos.REPO_META)
    got = {tuple(r) for r in repos.repository_info(meta).collect()}
    assert got == {("1", "feature", "https://h/r", "0123456"), ("2", "develop", None, None), ("3", "main", None, "abc")}


def test_links(spark):
    frame = spark.createDataFrame([("/s/app/src/app.ts", 42), ("/s/app/src/app.ts", 0), ("/other/place/app.ts", 42), ("s.ts", 1)],
                                  "path string, line int")
    link = urls.file_url(BASE, F.col("path"), F.col("line"), F.lit("/s"), F.lit("main"))
    got = [r[0] for r in frame.select(link).collect()]
    assert got == [f"{BASE}/app/blob/main/src/app.ts#L42", f"{BASE}/app/blob/main/src/app.ts",
                   f"{BASE}/other/blob/main/app.ts#L42", f"{BASE}/unknown/blob/main/s.ts#L1"]
    checks = {"https://github.com/a/b": True, "http://github.com": True, "https://x.github.com/p": True, "HTTPS://github.com/x": True,
              "ftp://github.com/a": False, "github.com/a": False, "https://gitlab.com/github.com": False, "": False, None: False}
    frame = spark.createDataFrame([(u,) for u in checks], "u string")
    assert [r[0] for r in frame.select(urls.is_valid_url(F.col("u"))).collect()] == list(checks.values())


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(400).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) AS k", "id % 2 AS j", "cast(id AS string) AS v")
    facts = spark.createDataFrame([("hot", 0, 1), ("hot", 1, 2), ("k1", 0, 3)], "k string, j bigint, f int")
    for how in ("left", "inner"):
        for on in ("k", ("k", "j")):
            side = facts.select("k", "f") if on == "k" else facts
            plain = rows.join(side, [on] if on == "k" else list(on), how)
            salted = joins.attach(rows, side, on, spread_by=("v",), how=how)
            assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_stored_table_is_in_the_shared_folder(spark):
    kept = stored(spark.range(5).toDF("n"))
    folder = spark.conf.get("spark.checkpoint.dir")
    assert kept.count() == 5 and all(folder in f for f in kept.inputFiles())


@pytest.fixture
def tree(tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())

    put("web/package.json", '{"dependencies": {"react": "18"}}')
    put("web/src/app.ts", "logger.info('a')\r\nx\r\nlogger.error('b')\n")
    put("web/__tests__/_e.ts", "datadogRum.addAction('tap')")
    put("web/src/.hidden/.f.ts", "DD_RUM.addError(e)")
    put("web/dist/bundle.ts", "logger.info('ignored')")
    put("web/src/empty.ts", "")
    put("web/src/quiet.ts", "const a = 1")
    put("web/src/latin.js", "logger.info('né')".encode("latin-1"))
    put("game/Game.csproj", "")
    put("game/Main.cs", 'using Datadog.Unity;\nsdk.Rum.AddTiming("t");')
    put("notes/readme.md", "datadog")
    os.makedirs(tmp_path / "empty" / "src")
    return tmp_path


def test_directory_scan(spark, tree):
    result = scan_directories(spark, [str(tree), str(tree / "missing")], base_url=BASE)
    found = {(r["project_name"], r["file_path"].removeprefix(str(tree)), r["line_number"], r["operation_type"])
             for r in result.findings.collect()}
    assert found == {
        ("web", "/web/src/app.ts", 1, "log_info"), ("web", "/web/src/app.ts", 3, "log_error"),
        ("web", "/web/__tests__/_e.ts", 1, "rum_action"), ("web", "/web/src/.hidden/.f.ts", 1, "rum_error"),
        ("web", "/web/src/latin.js", 1, "log_info"),
        ("game", "/game/Main.cs", 1, "import"), ("game", "/game/Main.cs", 2, "rum_timing")}
    counts = {r["name"]: (r["project_type"], r["findings_count"]) for r in result.projects.collect()}
    assert counts == {"web": ("react", 5), "game": ("unity", 2), "empty": ("unknown", 0)}
    assert result.total_files.first()[0] == 7
    links = [r["github_url"] for r in result.findings.where("line_number = 3").collect()]
    assert links == [f"{BASE}/web/blob/main/src/app.ts#L3"]


def test_binary_source_reads_the_same_bytes(spark, tree):
    files = corpus.read_directory(spark, str(tree), [".cs"])
    assert [bytes(r["content"]) for r in files.collect()] == [b'using Datadog.Unity;\nsdk.Rum.AddTiming("t");']


def test_globs_of_one_type_hold_for_all_projects(spark):
    files = spark.createDataFrame([
        ("/r", "/r/web/package.json", '{"dependencies": {"react": "1"}}'), ("/r", "/r/web/bin/a.ts", "logger.info(1)"),
        ("/r", "/r/web/src/a.ts", "logger.info(1)"), ("/r", "/r/game/x.csproj", ""), ("/r", "/r/game/a.cs", "x.Info(1); datadog"),
    ], "root string, path string, content string")
    listing = files.select("root", "path", F.lit(False).alias("is_dir"))
    result = scan(listing, files, base_url=BASE)
    assert {r["file_path"] for r in result.findings.collect()} == {"/r/web/src/a.ts", "/r/game/a.cs"}


def test_registered_language(spark):
    book = register_rules(LIVE, "Python", [".py", ".ts"], [
        {"name": "statsd", "operation": "custom_attribute", "patterns": [r"statsd\.\w+\("], "hints": ["statsd."],
         "fields": {"metric": r"\(\s*'([^']*)'"}}])
    files = spark.createDataFrame([("/p/a.py", "statsd.gauge('load', 1)"), ("/p/a.ts", "statsd.gauge('x')\nlogger.info('y')")],
                                  "path string, content string")
    got = {(r["path"], r["line_number"]): (r["language"], r["data_being_sent"]) for r in detect(files, book).collect()}
    assert got[("/p/a.py", 1)] == ("Python", {"metric": "load"})
    assert set(got) == {("/p/a.py", 1), ("/p/a.ts", 2)}


def test_language_lookup(spark):
    names = spark.createDataFrame([("script",), ("c# and more",), ("c",), ("cobol",)], "name string")
    got = {(r["name"], r["language"]) for r in rules.languages_like(names).collect()}
    assert got == {("script", "TypeScript/JavaScript"), ("c# and more", "C#"), ("c", "TypeScript/JavaScript"), ("c", "C#"), ("cobol", None)}


def test_every_rule_is_reached_through_its_hints(spark):
    """A line made from each pattern is found, so no hint hides a rule."""
    import re
    made = {}
    for language, calls, ext in (("w", rules.WEB_CALLS, "ts"), ("u", rules.UNITY_CALLS, "cs")):
        lines = []
        for name, _, _, patterns, hints in calls:
            for p in patterns:
                text = p.replace(r"\s+", "  ").replace(r"\s*", " ").replace(".*", " x ").replace(r"['\"]", "'")
                for choice in (0, -1):
                    line = re.sub(r"\(\?:([^)]*)\)", lambda m: m.group(1).split("|")[choice], text)
                    line = re.sub(r"\\(.)", r"\1", line)
                    assert any(h in line.lower() for h in hints), (name, line)
                    lines.append((name, line.upper()))
        made[f"/p/{language}.{ext}"] = lines
    files = spark.createDataFrame([(p, "\n".join(text for _, text in lines)) for p, lines in made.items()], "path string, content string")
    from beaconaudit.operators.findings import rule_hits
    got = {(r["path"], r["line_number"], r["family"]) for r in rule_hits(files).collect()}
    for path, lines in made.items():
        for number, (name, _) in enumerate(lines, 1):
            assert (path, number, name) in got, (path, number, name)


def test_files_may_be_bytes_with_any_line_end(spark):
    from beaconaudit.plans.scan import scan_files
    text = "x\r\nlogger.info('x')\rlogger.error('y')\r\nz"
    for content, kind in ((text, "string"), (text.encode(), "binary"), (text.replace("x'", "é'").encode("latin-1"), "binary")):
        files = spark.createDataFrame([("/p", "/p/a.ts", content)], f"project_path string, path string, content {kind}")
        found = scan_files(files, base_url=BASE).collect()
        assert sorted(r["line_number"] for r in found) == [2, 3]
        assert not any("\r" in line for r in found for line in r["context_lines"])


@pytest.fixture(scope="module")
def nested(spark):
    """Roots that overlap, and two projects of one name in different roots."""
    rows = [("/w", "/w/app/package.json", "{}"), ("/w/app", "/w/app/package.json", "{}"), ("/a", "/a/web/package.json", "{}"), ("/b", "/b/web/package.json", "{}"),
            ("/w", "/w/app/x.ts", "logger.info('x')"), ("/w/app", "/w/app/x.ts", "logger.info('x')"),
            ("/a", "/a/web/x.ts", "logger.info('x')\nlogger.info('y')"), ("/b", "/b/web/x.ts", "logger.info('z')")]
    files = spark.createDataFrame(rows, "root string, path string, content string")
    return scan(files.select("root", "path", F.lit(False).alias("is_dir")), files, base_url=BASE)


def test_overlapping_roots_and_namesakes(nested):
    counts = sorted((r["root"], r["path"], r["findings_count"]) for r in nested.projects.collect())
    assert counts == [("/a", "/a/web", 2), ("/b", "/b/web", 1), ("/w", "/w/app", 1), ("/w/app", "/w/app", 1)]
    assert nested.findings.count() == 5 and nested.total_files.first()[0] == 4


def test_two_rows_of_repository_facts_do_not_repeat_findings(spark):
    from beaconaudit.plans.scan import scan_files
    files = spark.createDataFrame([("/r/p", "/r/p/a.ts", "logger.info('x')")], "project_path string, path string, content string")
    meta = spark.createDataFrame([("/r/p", "b", None, None, None), ("/r/p", "a", None, None, None)], repos.REPO_META)
    assert [r["github_url"] for r in scan_files(files, meta, base_url=BASE).collect()] == [f"{BASE}/p/blob/a/a.ts#L1"]


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_results_of_a_scan_do_not_scan_again(nested, monkeypatch):
    """Detection leaves its mark in a plan, the context slices; counts and sinks hold none of it."""
    from beaconaudit.sinks import exports
    assert "inline" not in _plan(nested.findings) and "Generate" not in _plan(nested.findings)
    assert "symbol_test" not in _plan(nested.projects) and "Generate inline" not in _plan(nested.projects)
    assert "Generate inline" not in _plan(exports.document_lines(nested.projects, nested.findings, nested.total_files, 0.0))


def test_no_join_or_exchange_carries_file_contents(spark, monkeypatch):
    """What ``scan`` stores as findings: below the detection nothing but the files, above it no contents."""
    from beaconaudit.plans import scan as module
    kept = []
    monkeypatch.setattr(module, "stored", lambda frame: kept.append(frame) or stored(frame))
    files = spark.createDataFrame([("/r", "/r/web/package.json", "{}"), ("/r", "/r/web/a.ts", "logger.info(1)")], "root string, path string, content string")
    module.scan(files.select("root", "path", F.lit(False).alias("is_dir")), files, base_url=BASE)
    plan = kept[-1]._jdf.queryExecution().executedPlan().toString()
    joins_and_exchanges = [line for line in plan.splitlines() if "Join" in line or "Exchange" in line]
    assert joins_and_exchanges and "Generate" in plan
    below = plan[plan.index("Generate inline"):]
    assert "Join" not in below.split("Scan")[0].split("LocalTable")[0]
    assert not any("content#" in line for line in joins_and_exchanges)


def test_deep_and_wide_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_ENTRIES", 7)
    deep = tmp_path
    for i in range(12):
        deep = deep / f"d{i}"
        deep.mkdir()
        for j in range(5):
            (deep / f"f{j}.ts").write_text("x" * (i + j))
    listed = corpus.list_tree(spark, [str(tmp_path)])
    rows = {r["path"]: (r["is_dir"], r["size"]) for r in listed.collect()}
    expected = {str(p): (p.is_dir(), 0 if p.is_dir() else p.stat().st_size) for p in tmp_path.rglob("*")} | {str(tmp_path): (True, 0)}
    assert rows == expected and listed.count() == len(expected)
    files = listed.where("NOT is_dir")
    monkeypatch.setattr(corpus, "TASK_BYTES", 50_000)
    read = corpus.read_listed(files)
    assert read.rdd.getNumPartitions() == -(-files.selectExpr("sum(size + 4096)").first()[0] // 50_000)
    assert {r["path"]: len(r["content"]) for r in read.collect()} == {p: s for p, (d, s) in rows.items() if not d}


def test_bytes_are_dealt_out_evenly(spark):
    """A few files hold most of the bytes, and many are empty; no task gets twice its share."""
    import random
    rng = random.Random(1)
    sizes = [0] * 300 + [rng.randint(1, 2_000) for _ in range(500)] + [900_000] * 9
    listed = spark.createDataFrame([("/r", f"/r/{i}.ts", n) for i, n in enumerate(sizes)] + [("/r/x", "/r/7.ts", 5)], "root string, path string, size long")
    dealt, tasks = corpus.dealt_by_bytes(listed, 1_000_000)
    loads = {r["task"]: (r["n"], r["load"]) for r in dealt.groupBy("task").agg(F.count("*").alias("n"), F.sum(F.col("size") + 4096).alias("load")).collect()}
    total = sum(sizes) + 5 + 4096 * (len(sizes) + 1)
    assert tasks == -(-total // 1_000_000) and set(loads) <= set(range(tasks)) and sum(n for n, _ in loads.values()) == len(sizes) + 1
    assert max(load for _, load in loads.values()) < 2_000_000
    none, tasks = corpus.dealt_by_bytes(listed.where("false"), 1_000_000)
    assert tasks == 1 and none.count() == 0


def test_files_beyond_a_cell_are_unreadable(spark, tmp_path, monkeypatch):
    (tmp_path / "a.ts").write_text("12345")
    batch = corpus.pa.RecordBatch.from_pylist([{"root": "r", "path": str(tmp_path / "a.ts")}])
    monkeypatch.setattr(corpus, "MOST_BYTES", 4)
    assert [b["content"].to_pylist() for b in corpus._read(iter([batch]))] == [[None]]


def test_more_families_than_any_packing_holds(spark):
    book = register_rules(LIVE, "Many", [".many"], [
        {"name": f"f{i}", "operation": "custom_attribute", "patterns": [rf"\bw{i}\b"], "hints": ["w"]} for i in range(1030)])
    files = spark.createDataFrame([("/p/a.many", "w1027 w1029\nw3")], "path string, content string")
    assert {r["line_number"]: r["family"] for r in detect(files, book).collect()} == {1: "f1027", 2: "f3"}


def test_only_wanted_columns_are_built(spark):
    files = spark.createDataFrame([("/p/a.ts", "logger.info('x')")], "path string, content string")
    found = detect(files, wanted=("line_number", "operation_type"))
    assert found.columns == ["path", "language", "line_number", "operation_type"]
    assert "context_lines" not in _plan(found) and "context_lines" in _plan(detect(files))
