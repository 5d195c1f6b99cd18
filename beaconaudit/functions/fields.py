"""What a matched line sends: one builder per call style.

A builder takes the line and returns ``[(key, value, present), ...]``, all SQL expressions.
A key that is not present is left out of the record; a present key may hold '' or null.
``present`` may be None: the key is then present when its value is not null.
"""

from __future__ import annotations

from beaconaudit.functions.text import case, group, groups, lit, not_blank, strip, widened

# The patterns that pick values out of a line. All are case-sensitive.
IMPORTED_ITEMS = r"import\s+(\{[^}]+\}|\w+)"
IMPORTED_PACKAGE = r"['\"](@datadog/[^'\"]+)['\"]"
WEB_LOG_MESSAGE = r"\.(?:info|error|warn|debug)\s*\(\s*['\"]([^'\"]*)['\"]"
WEB_LOG_ARGUMENTS = r"\.(?:info|error|warn|debug)\s*\(\s*([^)]+)\)"
WEB_RUM_NAME = r"\.(?:addAction|addError|addTiming)\s*\(\s*['\"]([^'\"]*)['\"]"
WEB_RUM_ARGUMENTS = r"\.(?:addAction|addError|addTiming)\s*\(\s*([^)]+)\)"
UNITY_NAMESPACE = r"using\s+(Datadog\.[A-Za-z.]+)"
UNITY_LOG_MESSAGE = r"\.(?:Log|Info|Error|Warn|Debug)\s*\(\s*(?:DdLogLevel\.\w+,\s*)?[\"']([^\"']*)[\"']"
UNITY_LOG_ARGUMENTS = r"\.(?:Log|Info|Error|Warn|Debug)\s*\(([^)]+)\)"
UNITY_RUM_CALL = (
    r"\.(?:Add|Start|Stop)(?:Action|Error|Timing)\s*\(\s*"
    r"(?:RumUserActionType\.(\w+),\s*)?[\"']([^\"']*)[\"']"
)
UNITY_RUM_ARGUMENTS = r"\.(?:Add|Start|Stop)(?:Action|Error|Timing)\s*\(([^)]+)\)"
UNITY_ATTRIBUTE = r"\.(?:Add|Remove)Attribute\s*\(\s*[\"']([^\"']*)[\"'](?:\s*,\s*([^)]+))?"
UNITY_USER_ARGUMENTS = r"\.(?:SetUserInfo|AddUserExtraInfo)\s*\(([^)]+)\)"
LEGACY_CONFIGURATION = r"\(\s*(\{[^}]+\})"
LEGACY_APPLICATION_ID = r"applicationId\s*:\s*['\"]([^'\"]+)['\"]"
LEGACY_CLIENT_TOKEN = r"clientToken\s*:\s*['\"]([^'\"]+)['\"]"
LEGACY_SITE = r"site\s*:\s*['\"]([^'\"]+)['\"]"
LEGACY_ARGUMENTS = r"\(\s*([^)]+)\)"
LEGACY_LITERAL = r"['\"]([^'\"]+)['\"]"
CALL_ARGUMENTS = r"\w+\s*\(\s*([^)]+)\)"
NAMED_ARGUMENT = r"(\w+)\s*:\s*([^,}]+)"
DEFAULT_ACTION_TYPE = "Custom"
TOKEN_CHARS_SHOWN = 10
TOKEN_MASK = "..."


def u(pattern: str) -> str:
    """Unicode classes, and ``.`` over every character: lines hold no line feed."""
    return "(?sU)" + widened(pattern)


def _found(key: str, value: str):
    return key, value, None


def _first_group(key: str, pattern: str):
    return lambda line: _found(key, group(line, u(pattern)))


def from_patterns(patterns: dict[str, str]):
    """A builder from values: key -> regex whose first group is the value."""
    if not patterns:
        return nothing
    parts = [_first_group(key, regex) for key, regex in patterns.items()]
    return lambda line: [part(line) for part in parts]


def nothing(line: str) -> list:
    return []


web_import = from_patterns({"imported_items": IMPORTED_ITEMS, "package": IMPORTED_PACKAGE})
web_log = from_patterns({"log_message": WEB_LOG_MESSAGE, "parameters": WEB_LOG_ARGUMENTS})
web_rum = from_patterns({"action_name": WEB_RUM_NAME, "parameters": WEB_RUM_ARGUMENTS})
unity_import = from_patterns({"namespace": UNITY_NAMESPACE})
unity_log = from_patterns({"log_message": UNITY_LOG_MESSAGE, "parameters": UNITY_LOG_ARGUMENTS})
unity_user = from_patterns({"parameters": UNITY_USER_ARGUMENTS})
legacy_call = from_patterns({"parameters": LEGACY_ARGUMENTS})


def unity_rum(line: str) -> list:
    kind, name = (group(line, u(UNITY_RUM_CALL), i) for i in (1, 2))
    given = not_blank(kind)
    return [("action_type", f"coalesce({given}, {lit(DEFAULT_ACTION_TYPE)})", f"{kind} IS NOT NULL"),
            ("action_name", f"coalesce({not_blank(name)}, {given})", f"{kind} IS NOT NULL"),
            _found("parameters", group(line, u(UNITY_RUM_ARGUMENTS)))]


def unity_attribute(line: str) -> list:
    return [_found("attribute_key", group(line, u(UNITY_ATTRIBUTE), 1)),
            _found("attribute_value", not_blank(group(line, u(UNITY_ATTRIBUTE), 2)))]


def legacy_init(line: str) -> list:
    config = group(line, u(LEGACY_CONFIGURATION))
    token = group(config, u(LEGACY_CLIENT_TOKEN))
    return [_found("configuration", config),
            _found("application_id", group(config, u(LEGACY_APPLICATION_ID))),
            _found("client_token", f"concat(substring({token}, 1, {TOKEN_CHARS_SHOWN}), {lit(TOKEN_MASK)})"),
            _found("site", group(config, u(LEGACY_SITE)))]


def _legacy_with_literal(key: str):
    def build(line: str) -> list:
        arguments = group(line, u(LEGACY_ARGUMENTS))
        return [_found("parameters", arguments), _found(key, group(arguments, u(LEGACY_LITERAL)))]

    return build


legacy_action = _legacy_with_literal("action_name")
legacy_error = _legacy_with_literal("error_message")
legacy_log = _legacy_with_literal("log_message")


def detailed_parameters(line: str) -> str:
    """Named arguments and string literals of the first call on the line, or null if none.

    Repeated names keep their last value. The literals are a separate array, since
    a map of strings cannot also hold a list.
    """
    arguments = group(line, u(CALL_ARGUMENTS))
    names, values = (groups(arguments, u(NAMED_ARGUMENT), i) for i in (1, 2))
    literals = groups(arguments, u(LEGACY_LITERAL))
    pairs = f"zip_with({names}, {values}, (k, v) -> named_struct('k', k, 'v', v))"
    value = strip(f"element_at(filter({pairs}, p -> p.k = n), -1).v")
    last = f"transform(array_distinct({names}), n -> named_struct('key', n, 'value', {value}))"
    return case((f"size({names}) > 0 OR size({literals}) > 0",
                 f"named_struct('kv', map_from_entries({last}), 'string_literals', {literals})"))
