"""Operation and data category of a finding, as SQL expressions."""

from __future__ import annotations

from beaconaudit.functions.text import case, has_any, lit

# Words looked for in symbol, package, type and member names.
RUM_NAMES = ("addAction", "addError", "addTiming")
LOG_NAMES = ("logger", "createLogger")
FRAMEWORK_NAMES = ("reactPlugin", "createBrowserRouter")
SYMBOL_GESTURES = ("click", "tap", "swipe", "scroll", "input")
MEMBER_GESTURES = ("tap", "click", "swipe", "scroll", "touch")


def _has(text: str, word: str) -> str:
    return has_any(f"lower({text})", (word,))


def _named(text: str, names) -> str:
    return f"{text} IN ({', '.join(lit(n) for n in names)})"


def _rum(word: str) -> str:
    return case((_has(word, "action"), "'rum_action'"), (_has(word, "error"), "'rum_error'"),
                (_has(word, "timing"), "'rum_timing'"), otherwise="'custom_attribute'")


def _log(word: str) -> str:
    return case((_has(word, "error"), "'log_error'"), (_has(word, "warn"), "'log_warn'"),
                (_has(word, "debug"), "'log_debug'"), otherwise="'log_info'")


def symbol_operation(name: str, package: str) -> str:
    return case((f"{_has(package, 'rum')} OR {_named(name, RUM_NAMES)}", _rum(name)),
                (f"{_has(package, 'log')} OR {_named(name, LOG_NAMES)}", _log(name)),
                (f"{_has(package, 'react')} OR {_named(name, FRAMEWORK_NAMES)}", "'configuration'"),
                otherwise="'custom_attribute'")


def symbol_category(name: str, package: str) -> str:
    low = f"lower({name})"
    return case((f"{_has(name, 'error')} OR {_has(package, 'error')}", "'error_data'"),
                (has_any(low, ("timing", "performance")), "'performance_data'"),
                (f"{_has(name, 'action')} AND {has_any(low, SYMBOL_GESTURES)}", "'user_data'"),
                (f"{_has(package, 'react')} OR {_has(name, 'plugin')}", "'configuration_data'"),
                otherwise="'system_data'")


def type_operation(type_name: str, member: str) -> str:
    return case((_has(type_name, "rum"), _rum(member)), (_has(type_name, "log"), _log(member)),
                (f"{_has(type_name, 'datadog')} AND {_has(type_name, 'sdk')}", "'configuration'"),
                otherwise="'custom_attribute'")


def type_category(type_name: str, member: str) -> str:
    low = f"lower({member})"
    return case((f"{_has(type_name, 'error')} OR {_has(member, 'error')}", "'error_data'"),
                (has_any(low, ("timing", "performance")), "'performance_data'"),
                (f"{_has(member, 'action')} AND {has_any(low, MEMBER_GESTURES)}", "'user_data'"),
                (f"{_has(type_name, 'config')} OR {has_any(low, ('init', 'setup'))}", "'configuration_data'"),
                otherwise="'system_data'")


def rule_category(families, family: str, record: str) -> str:
    """Category of a direct hit: the family's own, or user data where the record shows a gesture."""
    branches = []
    for category in dict.fromkeys(f.category for f in families):
        plain = [f.name for f in families if f.category == category and not f.gestures]
        if plain:
            branches.append((_named(family, plain), lit(category)))
    for f in families:
        if f.gestures:
            gesture = has_any(_searchable(record, f.gesture_key), f.gestures)
            branches.append((f"{family} = {lit(f.name)}", case((gesture, "'user_data'"), otherwise=lit(f.category))))
    return case(*branches)


def _searchable(record: str, key: str | None) -> str:
    if key is not None:
        return f"coalesce(lower(try_element_at({record}, {lit(key)})), '')"
    # the quoted form is what is searched: a tab reads as backslash and t
    tab, written = lit("\t"), lit("\\t")
    return f"lower(replace(array_join(map_values({record}), ' | '), {tab}, {written}))"
