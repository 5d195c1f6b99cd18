import re

import pytest
from hypothesis import given, settings, strategies as st

from beaconaudit import LIVE, LIVE_SPLIT_IMPORTS
from beaconaudit.functions.text import quoted_length, record_length, strip
from beaconaudit.operators import findings as ops
from beaconaudit.operators.lines import explode_lines

TS = """import { datadogRum, type Init } from '@datadog/browser-rum';
import * as logs from '@datadog/browser-logs';

DD_RUM.init(options);
function track(name) {
  datadogRum.addAction('tap ' + name, { at: now() });
\tlogger.info('Order placed', order);
}
"""
CS = """using Datadog.Unity;
using Datadog.Unity.Logs;

DatadogSdk.Instance.SetSdkVerbosity(level);
sdk.Rum.StartAction(RumUserActionType.Swipe, "Map");
log = sdk.CreateLogger(options);
log.Info("Level loaded");
log.Error("Texture missing");
"""


def test_typescript_file(detect_text):
    rows = detect_text(TS)
    assert {n: (r["operation_type"], r["data_category"]) for n, r in rows.items()} == {
        1: ("import", "configuration_data"), 2: ("import", "configuration_data"),
        4: ("initialisation", "configuration_data"), 6: ("rum_action", "user_data"), 7: ("log_info", "system_data")}
    assert rows[4]["data_being_sent"] == {}
    assert rows[1]["data_being_sent"] == {"imported_items": "{ datadogRum, type Init }", "package": "@datadog/browser-rum"}
    assert rows[7]["code_snippet"] == "logger.info('Order placed', order);"
    assert rows[7]["data_being_sent"]["log_message"] == "Order placed"


def test_csharp_file(detect_text):
    rows = detect_text(CS, path="/p/Assets/Main.cs")
    assert [(n, rows[n]["operation_type"], rows[n]["data_category"]) for n in sorted(rows)] == [
        (1, "import", "configuration_data"), (2, "import", "configuration_data"), (4, "initialisation", "configuration_data"),
        (5, "rum_action", "user_data"), (6, "initialisation", "system_data"), (7, "log_info", "system_data"),
        (8, "log_error", "error_data")]
    assert rows[5]["data_being_sent"] == {"action_type": "Swipe", "action_name": "Map",
                                          "parameters": 'RumUserActionType.Swipe, "Map"'}


def test_empty_action_name_is_null_but_present(detect_text):
    row = detect_text('sdk.Rum.AddAction("", x);', path="/p/a.cs")[1]
    assert row["data_being_sent"] == {"action_type": "Custom", "action_name": None, "parameters": '"", x'}


def test_empty_literal_is_present(detect_text):
    assert detect_text('logger.info("")')[1]["data_being_sent"] == {"log_message": "", "parameters": '""'}


def test_live_gestures_differ_from_legacy(detect_text):
    rows = detect_text("datadogRum.addAction('form-submit');\ndatadogRum.addAction('menu-select');\n"
                       "datadogRum.addAction('a\tap');")
    # the quoted form of a tab is backslash and t, which spells a gesture
    assert [rows[n]["data_category"] for n in (1, 2, 3)] == ["system_data", "user_data", "user_data"]


def test_context_at_the_edges(detect_text):
    text = "\n".join(["logger.info('a')"] + [f"line {i}" for i in range(2, 8)])
    assert detect_text(text)[1]["context_lines"] == ["logger.info('a')", "line 2", "line 3", "line 4"]
    middle = "\n".join(["1", "2", "3", "logger.info('x')", "5", "6", "7"])
    assert len(detect_text(middle)[4]["context_lines"]) == 7
    assert detect_text(middle, context=0)[4]["context_lines"] == ["logger.info('x')"]


def test_longest_description_wins_and_ties_go_to_the_earlier_family(detect_text):
    rows = detect_text("logger.error(a); datadogRum.addError('a longer text', b)\nlogger.warn('x'); logger.error('x')")
    assert rows[1]["operation_type"] == "rum_error"
    assert rows[2]["operation_type"] == "log_error"


def test_braced_imports_count_as_one_symbol_unless_split(detect_text):
    text = "import { alpha, beta } from '@datadog/mobile';\nfoo(alpha, beta);\nalpha();\nbeta : 1\n"
    whole = detect_text(text)
    assert sorted(whole) == [1, 2] and whole[2]["data_being_sent"]["method_name"] == "alpha, beta"
    split = detect_text(text, rulebook=LIVE_SPLIT_IMPORTS)
    assert sorted(split) == [1, 2, 3]
    assert split[3]["data_being_sent"]["call_type"] == "function_call"


def test_import_may_span_lines_and_last_package_wins(spark):
    text = ("import {\n  one\n} from '@datadog/a-rum';\nimport two from '@datadog/b';\nimport two from '@datadog/c';\n"
            "import { } from '@datadog/d';\n")
    files = spark.createDataFrame([("/p/a.ts", text)], "path string, content string")
    row = ops.with_symbols(ops.route(files)).first()
    assert [(s["name"], s["origin"]) for s in row["symbols"]] == [("one", "@datadog/a-rum"), ("two", "@datadog/c")]


def _closing(text):
    """Offset after the parenthesis that closes the first one; after the first one if none does."""
    first = text.index("(")
    depth = 0
    for at in range(first, len(text)):
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        if depth == 0:
            return at + 1
    return first + 1


LINES = ["foo.plug(1)", "plug", "a = plug(b(c(d(e(f(g(1)))))), 2) + plug(", "x.plug  (plug : plug)", "plugplug plug:1",
         "PLUG(()", "))) plug ((x) y", "é.plug(é(ü)) ok", "new plug()", "plug\t(a)", "a-plug-(b)"]


def test_usages_against_a_plain_search(spark):
    text = "import plug from '@datadog/tool';\n" + "\n".join(LINES)
    files = spark.createDataFrame([("/p/a.ts", text)], "path string, content string")
    got = {(r["line_number"], r["finder_ord"], r["match_start"], r["match_end"], r["context"], r["parameters"])
           for r in ops.symbol_usages(files).collect() if r["line_number"] > 1}
    want = set()
    for number, line in enumerate(LINES, 2):
        for order, finder in enumerate((r"\bplug\s*\(", r"\.\s*plug\s*\(", r"\bplug\b(?!\s*:)")):
            for match in re.finditer(finder, line, re.I):
                tail = line[match.start():]
                if "(" in tail:
                    context = line[max(0, match.start() - 10):match.start() + _closing(tail)].strip()
                else:
                    context = line.strip()
                inner = re.search(r"\((.*)\)", context)
                want.add((number, order, match.start(), match.end(), context, (inner.group(1).strip() or None) if inner else None))
    assert got == want


def test_deep_nesting_on_a_long_line(detect_text):
    deep = "(" * 60 + "x" + ")" * 60
    line = "plug" + deep + " tail " + "y" * 50_000
    row = detect_text("import plug from '@datadog/tool';\n" + line)[2]
    assert row["data_being_sent"]["call_context"] == "plug" + deep


def test_csharp_types_come_with_their_namespace(spark):
    files = spark.createDataFrame([("/p/a.cs", "using Datadog.Unity.Rum;\nusing Datadog.Unity.Logs ;\n"
                                               "DdLogger log = x;\nvar t = RumUserActionType.Scroll;\n")], "path string, content string")
    row = ops.with_symbols(ops.route(files)).first()
    assert [(s["name"], s["import_type"]) for s in row["symbols"]] == [
        ("Rum", "using"), ("RumUserActionType", "enum"), ("IDdRum", "interface"),
        ("Logs", "using"), ("DdLogLevel", "enum"), ("DdLogger", "class")]
    uses = {r["line_number"]: r for r in ops.detect(files).collect() if r["family"] is None}
    assert uses[3]["data_being_sent"]["member_name"] == "log" and uses[3]["operation_type"] == "log_info"
    assert uses[4]["data_being_sent"]["usage_type"] == "property_access"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x05FF)), min_size=40, max_size=80))
def test_quoted_length_is_that_of_repr(spark, texts):
    texts = texts + ["", "it's", "it's \"x\"", "a\\b", "\t\n\r", "\x00\x7f\xa0\xad", " ​", "日本", "é"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in frame.selectExpr("i", f"{quoted_length('t')} AS n").collect()}
    assert got == {i: len(repr(t)) for i, t in enumerate(texts)}


def test_record_length_and_strip(spark):
    frame = spark.createDataFrame([("x", None, "  \ta b\x1f　")], "a string, b string, c string")
    entries = [("a", "a", "true"), ("bb", "b", "true"), ("c", "c", "false")]
    row = frame.selectExpr(f"{record_length(entries)} AS n", f"{strip('c')} AS s").first()
    assert row["n"] == len(str({"a": "x", "bb": None})) and row["s"] == "a b"


def test_at_most_one_finding_per_line_and_same_choice_by_grouping(spark):
    text = "\n".join(["logger.info('a'); logger.error('b'); datadogRum.addAction('tap', z);", "DD_RUM.init(", "logger.warn(1)"] * 20)
    files = spark.createDataFrame([(f"/p/{i}.ts", text) for i in range(4)], "path string, content string")
    rowwise = {(r["path"], r["line_number"]): (r["family"], r["repr_length"]) for r in ops.detect(files).collect()}
    hits = ops.rule_findings(files).drop("line", "language")
    grouped = {(r["path"], r["line_number"]): (r["family"], r["repr_length"])
               for r in ops.best_per_line(hits, ("path", "line_number")).collect()}
    assert len(rowwise) == 240 and rowwise == grouped
    again = {(r["path"], r["line_number"]) for r in ops.detect(files.repartition(3)).collect()}
    assert again == set(rowwise)


@pytest.mark.parametrize("name", ["K", "ſ"])
def test_letters_equal_only_when_case_is_ignored(detect_text, name):
    line = {"K": "datadogRum.addAction('x'); // K", "ſ": "datadogLogſ.createLogger(x)"}[name]
    assert detect_text(line)[1]["operation_type"] == {"K": "rum_action", "ſ": "initialisation"}[name]


def test_lines_keep_the_empty_last_one(spark):
    frame = spark.createDataFrame([("a\nb\n",)], "content string")
    assert [(r["line_number"], r["line"]) for r in explode_lines(frame).collect()] == [(1, "a"), (2, "b"), (3, "")]
    assert LIVE.extensions() == [".cs", ".js", ".jsx", ".ts", ".tsx"]


def test_information_separators_are_blanks(detect_text):
    assert detect_text("logger.info\x1c('x')")[1]["operation_type"] == "log_info"
    assert detect_text("datadogRum.init\x1f(x)")[1]["operation_type"] == "initialisation"


def test_widened_patterns():
    from beaconaudit.functions.text import widened
    assert widened(r"a\s*[^\s(]\\s\w") == r"a[\s\x1c-\x1f]*[^\s\x1c-\x1f(]\\s\w"


def test_a_live_rulebook_has_no_details(detect_text):
    from dataclasses import replace
    assert detect_text("datadogRum.addAction('a', { b: 'c' })", rulebook=replace(LIVE, detailed=True))[1]["extracted_parameters"] is None


def test_uses_on_a_long_line(spark):
    """A line of a megabyte: every use is found, at its place, and twice the line takes about twice the time."""
    import time
    took = []
    for n in (12_000, 24_000):
        text = "import foo from '@datadog/x';\n" + "foo(x, 1, 2);" * n
        files = spark.createDataFrame([("/p/a.ts", text)], "path string, content string")
        start = time.time()
        used = ops.symbol_usages(files).where("finder_ord = 0 AND line_number = 2").selectExpr(
            "count(*) AS n", "sum(match_start) AS places", "count_if(context LIKE '%foo(x, 1, 2)') AS calls").first()
        took.append(time.time() - start)
        assert tuple(used) == (n, 13 * n * (n - 1) // 2, n)
    assert took[1] < 3.2 * took[0] + 2


def test_surroundings_of_uses_across_short_pieces(detect_text):
    line = "y=a.b(1);" * 9
    rows = detect_text("import b from '@datadog/x';\n" + line + "\nnew  b\n   b = b\nb((((((1))))))\nb(((\n")
    assert rows[2]["data_being_sent"]["call_context"] == "a.b(1);y=a.b(1)" and rows[2]["data_being_sent"]["call_type"] == "method_call"
    assert rows[5]["data_being_sent"]["call_context"] == "b((((((1))))))"
    assert rows[6]["data_being_sent"]["call_context"] == "b("
