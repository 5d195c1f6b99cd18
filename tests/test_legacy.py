import pytest

from beaconaudit import LEGACY, LEGACY_DETAILED

# one line each; all are put into one file, so that one job answers every case
CASES = [
    ("import { datadogRum as monitor } from '@datadog/browser-rum';", "import", "configuration_data"),
    ("import '@datadog/browser-rum-react';", "import", "configuration_data"),
    ("let sdk = require ( \"@datadog/browser-logs\" );", "import", "configuration_data"),
    ("datadogRum.addAction('open-click', { screen: 'cart' });", "rum_action", "user_data"),
    ("DD_RUM.addAction ('order-submit');", "rum_action", "user_data"),
    ("datadogRum.addAction('list-scroll');", "rum_action", "user_data"),
    ("datadogRum.addAction('card-tap');", "rum_action", "user_data"),
    ("datadogRum.addAction('fetch-orders');", "rum_action", "system_data"),
    ("DD_RUM.addError(new TypeError('Out of stock'));", "rum_error", "error_data"),
    ("datadogRum.addTiming('first-paint');", "rum_timing", "performance_data"),
    ("logger.info('Basket opened');", "log_info", "system_data"),
    ("logger.error(reason);", "log_error", "error_data"),
    ("datadogLogs.logger.warn('slow');", "log_warn", "system_data"),
    ("logger.debug(state);", "log_debug", "system_data"),
    ("DataDogRum.AddAction('fetch');", "rum_action", "system_data"),
    ("dd_rum.addaction('fetch');", "rum_action", "system_data"),
    ("datadogRum.addAction('a longer name'); logger.info('short');", "rum_action", "system_data"),
    ("datadogRum.init({ applicationId: 'shop-7', clientToken: 'tok88', site: 'eu1.example' });", "initialisation", "configuration_data"),
    ("DD_RUM.init({ clientToken: 'zyxwvutsrqponm' });", "initialisation", "configuration_data"),
]


@pytest.fixture(scope="module")
def found(detect_text):
    return detect_text("\n".join(line for line, _, _ in CASES), rulebook=LEGACY)


def test_operations_and_categories(found):
    assert len(found) == len(CASES)
    for number, (line, operation, category) in enumerate(CASES, 1):
        row = found[number]
        assert (row["operation_type"], row["data_category"], row["code_snippet"]) == (operation, category, line)
        assert row["extracted_parameters"] is None


def test_action_and_log_values(found):
    assert found[4]["data_being_sent"] == {"parameters": "'open-click', { screen: 'cart' }", "action_name": "open-click"}
    assert found[9]["data_being_sent"] == {"parameters": "new TypeError('Out of stock'", "error_message": "Out of stock"}
    assert found[11]["data_being_sent"]["log_message"] == "Basket opened"


def test_configuration_is_taken_apart_and_token_masked(found):
    data = found[18]["data_being_sent"]
    assert (data["application_id"], data["client_token"], data["site"]) == ("shop-7", "tok88...", "eu1.example")
    assert found[19]["data_being_sent"]["client_token"] == "zyxwvutsrq..."


def test_detailed_parameters(detect_text):
    rows = detect_text("datadogRum.addAction('pay', { amount: '12', currency: 'eur', amount: '13' });\nlogger.info(x)",
                       rulebook=LEGACY_DETAILED)
    assert rows[1]["extracted_parameters"]["kv"] == {"amount": "'13'", "currency": "'eur'"}
    assert rows[1]["extracted_parameters"]["string_literals"] == ["pay", "12", "eur", "13"]
    assert rows[2]["extracted_parameters"] is None


def test_extension_is_case_sensitive(detect_text):
    line = "logger.info('x')"
    assert detect_text(line, path="/p/a.TS", rulebook=LEGACY) == {}
    assert detect_text(line, path="/p/a.vue", rulebook=LEGACY)
    assert detect_text(line, path="/p/a.TS")


def test_named_imports_are_followed_without_alias(detect_text):
    rows = detect_text("import { datadogRum as rum, reactPlugin } from '@datadog/browser-rum';\n"
                       "import * as dd from '@datadog/browser-core';\n"
                       "const p = new reactPlugin();\nx.datadogRum(1)\ny = dd\nnew X, reactPlugin(2)\n",
                       rulebook=LEGACY)
    assert rows[3]["data_being_sent"] == {"method_name": "reactPlugin", "package": "@datadog/browser-rum",
                                          "call_context": "t p = new reactPlugin()", "call_type": "function_call"}
    assert rows[4]["data_being_sent"]["parameters"] == "1"
    assert rows[5]["data_being_sent"]["call_type"] == "assignment"
    # the word must be followed by something other than the name itself; such calls show no arguments
    assert rows[6]["data_being_sent"]["call_type"] == "constructor" and "parameters" not in rows[6]["data_being_sent"]


def test_nothing_in_empty_or_plain_files(detect_text):
    assert detect_text("", rulebook=LEGACY) == {}
    assert detect_text("const a = 1;\nfunction b() {}\n", rulebook=LEGACY) == {}
