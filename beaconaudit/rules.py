"""The rule catalogue: which source lines count as telemetry, and in which language.

Rules are data. A :class:`Family` is a group of patterns with one meaning, a
:class:`Language` is an ordered list of families plus the file extensions they
apply to, and a :class:`Rulebook` is what a scan runs with. Family order matters:
when two families describe a line equally well, the earlier one is kept.

Patterns are written for ``java.util.regex``; ``ci()`` adds the flags that make
them match without regard to case, over Unicode text, with ``.`` spanning
everything but the line feed that splits lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from beaconaudit.functions import fields
from beaconaudit.functions.text import widened


def ci(pattern: str) -> str:
    return "(?isU)" + widened(pattern)


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


@dataclass(frozen=True)
class Family:
    """``hints``: lower-case texts of which every matching line holds one. They are looked
    for before the patterns are tried; without hints the patterns are tried on every line."""

    name: str
    operation: str
    category: str
    patterns: tuple[str, ...]
    hints: tuple[str, ...] = ()
    fields: Callable = fields.nothing
    gestures: tuple[str, ...] = ()
    gesture_key: str | None = None

    @property
    def regex(self) -> str:
        return ci(any_of(self.patterns))


@dataclass(frozen=True)
class Language:
    """``symbols`` names the import style whose symbols are followed (``operators.symbols``);
    ``details`` says whether a detailed rulebook takes this language's arguments apart."""

    name: str
    extensions: tuple[str, ...]
    families: tuple[Family, ...]
    symbols: str | None = None
    details: bool = False


@dataclass(frozen=True)
class Rulebook:
    languages: tuple[Language, ...]
    fold_extension: bool = True
    detailed: bool = False

    def extensions(self) -> list[str]:
        return sorted({e for lang in self.languages for e in lang.extensions})

    def with_language(self, language: Language) -> "Rulebook":
        """Add a language. Extensions already routed keep their language: first one wins."""
        return replace(self, languages=self.languages + (language,))


def register_rules(rulebook: Rulebook, language: str, extensions, families) -> Rulebook:
    """Extend ``rulebook`` by plain values.

    ``families`` is a list of dicts with ``name``, ``operation``, ``category``,
    ``patterns`` and optionally ``hints`` and ``fields`` (key -> regex, first group is
    the value).
    """
    built = tuple(
        Family(f["name"], f.get("operation", "custom_attribute"), f.get("category", "system_data"),
               tuple(f["patterns"]), tuple(f.get("hints", ())), fields.from_patterns(f["fields"]) if f.get("fields") else fields.nothing)
        for f in families
    )
    return rulebook.with_language(Language(language, tuple(extensions), built))


# ---------------------------------------------------------------------------
# Fixed values. The SDK calls, words and names below are what results are
# compared on; they are stated once, here, and used everywhere else by name.
# ---------------------------------------------------------------------------

# Names accepted by the data type filter.
DATA_TYPES = {
    "user-data": "user_data",
    "system-data": "system_data",
    "error-data": "error_data",
    "performance-data": "performance_data",
    "configuration-data": "configuration_data",
}

# A file is scanned only if its lower-cased text holds one of these.
# (Longer keywords that contain one of them change nothing and are left out.)
FILE_KEYWORDS = (
    "datadog", "dd_rum", "browser-rum", "browser-logs",
    "addaction", "adderror", "addtiming", "logger.info", "logger.error",
)

# Words that make an action a user gesture, per profile.
WEB_GESTURES = ("click", "tap", "input", "select")
UNITY_GESTURES = ("tap", "click", "swipe", "scroll", "touch")
LEGACY_GESTURES = ("click", "tap", "swipe", "scroll", "input", "select", "submit")

# Web SDK calls, as (family, operation, category, patterns, hints).
WEB_CALLS = (
    ("imports", "import", "configuration_data", (
        r"import\s+.*@datadog/browser-rum",
        r"import\s+.*@datadog/browser-logs",
        r"import\s+.*@datadog/browser-rum-react",
        r"from\s+['\"]@datadog/browser-rum['\"]",
        r"from\s+['\"]@datadog/browser-logs['\"]",
        r"require\s*\(\s*['\"]@datadog/browser-rum['\"]",
        r"require\s*\(\s*['\"]@datadog/browser-logs['\"]",
    ), ("@datadog/browser-",)),
    ("init", "initialisation", "configuration_data", (
        r"datadogRum\.init\s*\(",
        r"datadogLogs\.createLogger\s*\(",
        r"DD_RUM\.init\s*\(",
    ), (".init", ".createlogger")),
    ("rum_action", "rum_action", "system_data", (
        r"datadogRum\.addAction\s*\(",
        r"DD_RUM\.addAction\s*\(",
    ), (".addaction",)),
    ("rum_error", "rum_error", "error_data", (
        r"datadogRum\.addError\s*\(",
        r"DD_RUM\.addError\s*\(",
    ), (".adderror",)),
    ("rum_timing", "rum_timing", "performance_data", (
        r"datadogRum\.addTiming\s*\(",
        r"DD_RUM\.addTiming\s*\(",
    ), (".addtiming",)),
    ("log_info", "log_info", "system_data", (
        r"logger\.info\s*\(",
        r"datadogLogs\.logger\.info\s*\(",
    ), ("logger.info",)),
    ("log_error", "log_error", "error_data", (
        r"logger\.error\s*\(",
        r"datadogLogs\.logger\.error\s*\(",
    ), ("logger.error",)),
    ("log_warn", "log_warn", "system_data", (
        r"logger\.warn\s*\(",
        r"datadogLogs\.logger\.warn\s*\(",
    ), ("logger.warn",)),
    ("log_debug", "log_debug", "system_data", (
        r"logger\.debug\s*\(",
        r"datadogLogs\.logger\.debug\s*\(",
    ), ("logger.debug",)),
)

# Unity SDK calls, as (family, operation, category, patterns, hints).
UNITY_CALLS = (
    ("imports", "import", "configuration_data", (
        r"using\s+Datadog\.Unity",
        r"using\s+Datadog\.Unity\.Rum",
        r"using\s+Datadog\.Unity\.Logs",
        r"using\s+Datadog\.Unity\.Core",
    ), ("datadog.unity",)),
    ("init", "initialisation", "configuration_data", (
        r"DatadogSdk\.InitWithPlatform\s*\(",
        r"DatadogSdk\.Instance\.SetTrackingConsent\s*\(",
        r"DatadogSdk\.Instance\.SetSdkVerbosity\s*\(",
    ), (".initwithplatform", ".settrackingconsent", ".setsdkverbosity")),
    ("rum_action", "rum_action", "system_data", (
        r"DatadogSdk\.Instance\.Rum\.(?:Add|Start)Action\s*\(",
        r"DatadogSdk\.Instance\.Rum\.StopAction\s*\(",
        r"\.Rum\.(?:Add|Start)Action\s*\(",
        r"\.Rum\.StopAction\s*\(",
    ), (".addaction", ".startaction", ".stopaction")),
    ("rum_error", "rum_error", "error_data", (
        r"DatadogSdk\.Instance\.Rum\.AddError\s*\(",
        r"\.Rum\.AddError\s*\(",
    ), (".adderror",)),
    ("rum_timing", "rum_timing", "performance_data", (
        r"DatadogSdk\.Instance\.Rum\.AddTiming\s*\(",
        r"\.Rum\.AddTiming\s*\(",
    ), (".addtiming",)),
    ("rum_view", "custom_attribute", "system_data", (
        r"DatadogSdk\.Instance\.Rum\.StartView\s*\(",
        r"DatadogSdk\.Instance\.Rum\.StopView\s*\(",
        r"\.Rum\.(?:Start|Stop)View\s*\(",
    ), (".startview", ".stopview")),
    ("rum_attribute", "custom_attribute", "system_data", (
        r"DatadogSdk\.Instance\.Rum\.AddAttribute\s*\(",
        r"DatadogSdk\.Instance\.Rum\.RemoveAttribute\s*\(",
        r"\.Rum\.(?:Add|Remove)Attribute\s*\(",
    ), (".addattribute", ".removeattribute")),
    ("log_create", "initialisation", "system_data", (
        r"DatadogSdk\.Instance\.CreateLogger\s*\(",
        r"\.CreateLogger\s*\(",
    ), (".createlogger",)),
    ("log_info", "log_info", "system_data", (
        r"\.Log\s*\(\s*DdLogLevel\.Info",
        r"\.Info\s*\(",
    ), (".info",)),
    ("log_error", "log_error", "error_data", (
        r"\.Log\s*\(\s*DdLogLevel\.Error",
        r"\.Error\s*\(",
    ), (".error",)),
    ("log_warn", "log_warn", "system_data", (
        r"\.Log\s*\(\s*DdLogLevel\.Warn",
        r"\.Warn\s*\(",
    ), (".warn",)),
    ("log_debug", "log_debug", "system_data", (
        r"\.Log\s*\(\s*DdLogLevel\.Debug",
        r"\.Debug\s*\(",
    ), (".debug",)),
    ("user_info", "configuration", "configuration_data", (
        r"DatadogSdk\.Instance\.SetUserInfo\s*\(",
        r"DatadogSdk\.Instance\.AddUserExtraInfo\s*\(",
        r"\.SetUserInfo\s*\(",
        r"\.AddUserExtraInfo\s*\(",
    ), (".setuserinfo", ".adduserextrainfo")),
    ("global_attributes", "custom_attribute", "configuration_data", (
        r"DatadogSdk\.Instance\.AddLogsAttribute\s*\(",
        r"DatadogSdk\.Instance\.AddLogsAttributes\s*\(",
        r"DatadogSdk\.Instance\.RemoveLogsAttribute\s*\(",
        r"\.(?:Add|Remove)LogsAttribute\s*\(",
    ), (".addlogsattribute", ".removelogsattribute")),
    ("clear_data", "configuration", "configuration_data", (
        r"DatadogSdk\.Instance\.ClearAllData\s*\(",
        r"\.ClearAllData\s*\(",
    ), (".clearalldata",)),
)

# Files that mark a directory as a project.
PROJECT_MARKERS = ("package.json", "Assets", "ProjectSettings", "src", "tsconfig.json", "next.config.js")
PROJECT_MARKER_SUFFIX = ".csproj"

# Paths skipped by default, per project type.
IGNORE_GLOBS = {
    "react": ("node_modules/**", "build/**", "dist/**", ".next/**", "coverage/**", "*.min.js", "*.bundle.js"),
    "nextjs": ("node_modules/**", "build/**", "dist/**", ".next/**", "out/**", "coverage/**", "*.min.js",
               "*.bundle.js"),
    "unity": ("Library/**", "Temp/**", "Build/**", "Builds/**", "obj/**", "bin/**", "*.meta"),
    "node": ("node_modules/**", "build/**", "dist/**", "coverage/**", "*.min.js", "*.bundle.js"),
}

# Extensions per language.
WEB_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
UNITY_EXTENSIONS = (".cs",)
LEGACY_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte")

# --------------------------- end of fixed values ---------------------------


def _families(calls, field_builders, gestures, gesture_key=None) -> tuple[Family, ...]:
    return tuple(
        Family(name, operation, category, patterns, hints,
               fields=field_builders.get(name, fields.nothing),
               gestures=gestures if name == "rum_action" else (),
               gesture_key=gesture_key)
        for name, operation, category, patterns, hints in calls
    )


WEB = Language(
    "TypeScript/JavaScript", WEB_EXTENSIONS,
    _families(WEB_CALLS, {
        "imports": fields.web_import,
        **dict.fromkeys(("rum_action", "rum_error", "rum_timing"), fields.web_rum),
        **dict.fromkeys(("log_info", "log_error", "log_warn", "log_debug"), fields.web_log),
    }, WEB_GESTURES),
    symbols="web",
)

UNITY = Language(
    "C#", UNITY_EXTENSIONS,
    _families(UNITY_CALLS, {
        "imports": fields.unity_import,
        **dict.fromkeys(("rum_action", "rum_error", "rum_timing"), fields.unity_rum),
        **dict.fromkeys(("log_info", "log_error", "log_warn", "log_debug"), fields.unity_log),
        "rum_attribute": fields.unity_attribute,
        "user_info": fields.unity_user,
    }, UNITY_GESTURES),
    symbols="unity",
)

LEGACY_WEB = Language(
    "TypeScript/JavaScript", LEGACY_EXTENSIONS,
    _families(WEB_CALLS, {
        "imports": fields.web_import,
        "init": fields.legacy_init,
        "rum_action": fields.legacy_action,
        "rum_error": fields.legacy_error,
        "rum_timing": fields.legacy_call,
        **dict.fromkeys(("log_info", "log_error", "log_warn", "log_debug"), fields.legacy_log),
    }, LEGACY_GESTURES, gesture_key="action_name"),
    symbols="legacy", details=True,
)

LIVE = Rulebook((WEB, UNITY))
LIVE_SPLIT_IMPORTS = Rulebook((replace(WEB, symbols="web_split"), UNITY))
LEGACY = Rulebook((LEGACY_WEB,), fold_extension=False)
LEGACY_DETAILED = replace(LEGACY, detailed=True)


def catalogue(spark, rulebook: Rulebook = LIVE):
    """The rulebook as a table: one row per pattern, in matching order."""
    return spark.createDataFrame(
        [(lang.name, list(lang.extensions), f.name, i, j, p, f.operation, f.category)
         for lang in rulebook.languages for i, f in enumerate(lang.families) for j, p in enumerate(f.patterns)],
        "language string, extensions array<string>, family string, family_ord int, pattern_ord int, "
        "pattern string, operation_type string, data_category string")


def languages_like(names: DataFrame, rulebook: Rulebook = LIVE) -> DataFrame:
    """``names(name)`` with the languages whose name holds it or is held by it, in any case; null where none does.

    The catalogue is a handful of rows, so every name is compared with all of them.
    """
    low = F.lower("name")
    known = [F.when(F.contains(low, F.lit(lang.name.lower())) | F.contains(F.lit(lang.name.lower()), low), F.lit(lang.name))
             for lang in rulebook.languages]
    return names.select("name", F.explode_outer(F.array_compact(F.array(*known))).alias("language"))
