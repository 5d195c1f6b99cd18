"""The queries again in plain SQL, for another engine to run on the same tables.

Only fixed values (patterns, words) are shared with the engine; what is done with them
is written out separately here, with joins, unnests and windows instead of row-local
expressions.
"""

from __future__ import annotations

from beaconaudit import derived, rules
from beaconaudit.functions import fields
from beaconaudit.operators import symbols as sym

BASE = "https://github.com/example"
WEB, UNITY = rules.WEB.name, rules.UNITY.name
LOGS = ("log_info", "log_error", "log_warn", "log_debug")
RUM = ("rum_action", "rum_error", "rum_timing")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, flags: str = "s") -> str:
    return q(f"(?{flags})" + pattern)


def value(pattern: str, group: int = 1, text: str = "line") -> str:
    return f"CASE WHEN regexp_matches({text}, {rx(pattern)}) THEN regexp_extract({text}, {rx(pattern)}, {group}) END"


def quoted(v: str) -> str:
    return (f"(length({v}) + 2 + length({v}) - length(replace({v}, '\\', '')) + length({v}) - length(replace({v}, chr(9), ''))"
            f" + CASE WHEN contains({v}, '''') AND contains({v}, '\"') THEN length({v}) - length(replace({v}, '''', '')) ELSE 0 END)")


# ------------------------------------------------------------------ shared steps

_FILES = f"""
files AS (
  SELECT project_path, path, content FROM ({derived.EVENT_FILES.replace('$JOINED', derived.DUCKDB_JOINED)}) ef
  UNION ALL SELECT project_path, path, content FROM ({derived.DOCUMENT_FILES}) df)"""

_EXT = "regexp_extract(path, '[^/](\\.[^./]+)$', 1)"
_LIVE_LANGUAGE = (f"CASE WHEN lower({_EXT}) IN ('.ts', '.tsx', '.js', '.jsx') THEN {q(WEB)} "
                  f"WHEN lower({_EXT}) = '.cs' THEN {q(UNITY)} END")
_LEGACY_LANGUAGE = f"CASE WHEN {_EXT} IN ('.js', '.jsx', '.ts', '.tsx', '.vue', '.svelte') THEN {q(WEB)} END"


def _lines(language: str, files: str = "files") -> str:
    return f"""
routed AS (SELECT * FROM (SELECT *, {language} AS language FROM {files}) r WHERE language IS NOT NULL),
lines AS (SELECT project_path, path, language, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) AS INT) AS line_number
          FROM (SELECT *, string_split(content, chr(10)) AS parts FROM routed) s)"""


def _calls(legacy: bool):
    """(language, position, family, operation, category, patterns, reading, gestures, gesture text)"""
    f = fields

    def web(name):
        if name == "imports":
            return [("imported_items", value(f.IMPORTED_ITEMS), None), ("package", value(f.IMPORTED_PACKAGE), None)]
        if not legacy:
            if name in LOGS:
                return [("log_message", value(f.WEB_LOG_MESSAGE), None), ("parameters", value(f.WEB_LOG_ARGUMENTS), None)]
            if name in RUM:
                return [("action_name", value(f.WEB_RUM_NAME), None), ("parameters", value(f.WEB_RUM_ARGUMENTS), None)]
            return []
        if name == "init":
            config = f"({value(f.LEGACY_CONFIGURATION)})"
            token = value(f.LEGACY_CLIENT_TOKEN, text=config)
            return [("configuration", config, None), ("application_id", value(f.LEGACY_APPLICATION_ID, text=config), None),
                    ("client_token", f"substr({token}, 1, 10) || '...'", None), ("site", value(f.LEGACY_SITE, text=config), None)]
        arguments = f"({value(f.LEGACY_ARGUMENTS)})"
        out = [("parameters", arguments, None)]
        key = {"rum_action": "action_name", "rum_error": "error_message"}.get(name, "log_message" if name in LOGS else None)
        return out + ([(key, value(f.LEGACY_LITERAL, text=arguments), None)] if key else [])

    def unity(name):
        if name == "imports":
            return [("namespace", value(f.UNITY_NAMESPACE), None)]
        if name in LOGS:
            return [("log_message", value(f.UNITY_LOG_MESSAGE), None), ("parameters", value(f.UNITY_LOG_ARGUMENTS), None)]
        if name in RUM:
            hit = f"regexp_matches(line, {rx(f.UNITY_RUM_CALL)})"
            kind, label = value(f.UNITY_RUM_CALL, 1), value(f.UNITY_RUM_CALL, 2)
            return [("action_type", f"CASE WHEN {hit} THEN coalesce(nullif({kind}, ''), 'Custom') END", hit),
                    ("action_name", f"coalesce(nullif({label}, ''), nullif({kind}, ''))", hit),
                    ("parameters", value(f.UNITY_RUM_ARGUMENTS), None)]
        if name == "rum_attribute":
            return [("attribute_key", value(f.UNITY_ATTRIBUTE, 1), None),
                    ("attribute_value", f"nullif({value(f.UNITY_ATTRIBUTE, 2)}, '')", None)]
        return [("parameters", value(f.UNITY_USER_ARGUMENTS), None)] if name == "user_info" else []

    for i, (name, op, cat, pats, _) in enumerate(rules.WEB_CALLS):
        words = (rules.LEGACY_GESTURES if legacy else rules.WEB_GESTURES) if name == "rum_action" else ()
        yield WEB, i, name, op, cat, pats, web(name), words, "k_action_name" if legacy else "data"
    if not legacy:
        for i, (name, op, cat, pats, _) in enumerate(rules.UNITY_CALLS):
            words = rules.UNITY_GESTURES if name == "rum_action" else ()
            yield UNITY, i, name, op, cat, pats, unity(name), words, "data"


def _direct(legacy: bool = False, only=None, keys=()) -> str:
    """Every (line, family) hit with its record as text, its length and category."""
    parts = []
    for language, i, name, op, cat, pats, reading, words, where in _calls(legacy):
        if only and (language, name) not in only:
            continue
        test = rx("|".join(f"(?:{p})" for p in pats), "is")
        cells = "".join(f", {v} AS k_{k}" for k, v, _ in reading)
        flags = "".join(f", {p} AS p_{k}" for k, _, p in reading if p)
        seen = {k: (f"p_{k}" if p else f"k_{k} IS NOT NULL") for k, _, p in reading}
        data = ", ".join(f"CASE WHEN {seen[k]} THEN concat('{k}=', coalesce(k_{k}, 'null')) END" for k in sorted(seen))
        json = ", ".join(f"CASE WHEN {seen[k]} THEN '\"{k}\": ' || coalesce(CAST(to_json(k_{k}) AS VARCHAR), 'null') END" for k in seen)
        page = ", ".join(f"CASE WHEN {seen[k]} THEN '  \"{k}\": ' || coalesce(CAST(to_json(k_{k}) AS VARCHAR), 'null') END" for k in sorted(seen))
        size = " + ".join(f"CASE WHEN {seen[k]} THEN {len(k) + 6} + coalesce({quoted('k_' + k)}, 4) ELSE 0 END" for k in seen)
        user = " OR ".join(f"contains(lower(coalesce({where}, '')), '{w}')" for w in words)
        category = f"CASE WHEN {user} THEN 'user_data' ELSE '{cat}' END" if words else f"'{cat}'"
        shown = "".join(f", k_{k} AS {k}" if k in seen else f", CAST(NULL AS VARCHAR) AS {k}" for k in keys)
        parts.append(f"""
SELECT path, project_path, line_number, line, language, '{name}' AS family, '{op}' AS operation_type, {i} AS ord, data, '{{' || json || '}}' AS json, '{{' || chr(10) || page || chr(10) || '}}' AS page,
       CAST(repr_length AS INT) AS repr_length, {category} AS data_category{shown}
FROM (SELECT *, {f"concat_ws('|', {data})" if data else "''"} AS data, {f"concat_ws(', ', {json})" if json else "''"} AS json, {f"concat_ws(',' || chr(10), {page})" if page else "''"} AS page, {f"greatest(2, {size})" if size else "2"} AS repr_length
      FROM (SELECT *{cells}{flags} FROM lines WHERE language = {q(language)} AND regexp_matches(line, {test})) c) d""")
    return "direct AS (" + " UNION ALL ".join(parts) + ")"


_BEST = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, line_number ORDER BY repr_length DESC, ord) AS place
                        FROM direct) b WHERE place = 1)"""


def _symbols(profile: str) -> str:
    """path, ord, name, origin, import_type"""
    both = "is"

    def pairs(pattern, source, rank, kind, text="content"):
        return (f"SELECT path, {rank} AS src, generate_subscripts(regexp_extract_all({text}, {rx(pattern, both)}, 1), 1) AS pos, "
                f"trim(unnest(regexp_extract_all({text}, {rx(pattern, both)}, 1))) AS items, "
                f"unnest(regexp_extract_all({text}, {rx(pattern, both)}, 2)) AS origin, {kind} AS import_type FROM {source}")

    if profile == "unity":
        ns = (f"SELECT path, generate_subscripts(regexp_extract_all(content, {rx(sym.USING, both)}, 1), 1) AS pos, "
              f"unnest(regexp_extract_all(content, {rx(sym.USING, both)}, 1)) AS origin FROM routed WHERE language = {q(UNITY)}")
        named = ["SELECT path, pos * 10 AS seq, regexp_extract(origin, '[^.]*$') AS name, origin, 'using' AS import_type FROM ns"]
        for word, types, base in (("Rum", sym.USING_RUM, 1), ("Logs", sym.USING_LOGS, 3)):
            for n, (name, kind) in enumerate(types):
                named.append(f"SELECT path, pos * 10 + {base + n}, '{name}', origin, '{kind}' FROM ns WHERE contains(origin, '{word}')")
        head = f"ns AS ({ns}), named AS ({' UNION ALL '.join(named)})"
    elif profile == "legacy":
        source = f"(SELECT * FROM lines WHERE language = {q(WEB)} AND contains(lower(line), '@datadog/')) l"
        kind = "CASE WHEN contains(line, '{') THEN 'named' ELSE 'default' END"
        parts = []
        for n, p in enumerate((sym.NAMED_IMPORT, sym.DEFAULT_IMPORT, sym.NAMESPACE_IMPORT)):
            parts.append(f"SELECT path, line_number * 10 + {n} AS src, trim(regexp_extract(line, {rx(p, both)}, 1)) AS items, "
                         f"regexp_extract(line, {rx(p, both)}, 2) AS origin, {kind} AS import_type, "
                         f"contains(line, '{{') AND contains(line, '}}') AS braces FROM {source} WHERE regexp_matches(line, {rx(p, both)})")
        split = ("SELECT path, src, origin, import_type, generate_subscripts(names, 1) AS pos, unnest(names) AS item FROM "
                 "(SELECT *, CASE WHEN braces THEN string_split(items, ',') ELSE [items] END AS names FROM found) n")
        head = (f"found AS ({' UNION ALL '.join(parts)}), named AS (SELECT path, src * 1000 + pos AS seq, "
                f"trim(string_split(trim(item), ' as ')[1]) AS name, origin, import_type FROM ({split}) s)")
    else:
        source = f"(SELECT * FROM routed WHERE language = {q(WEB)}) w"
        kind = "'destructured'" if profile == "web_split" else "'default'"
        found = (pairs(sym.NAMED_IMPORT, source, 0, kind) + " UNION ALL "
                 + pairs(sym.DEFAULT_IMPORT, source, 1, "'default'"))
        if profile == "web_split":
            inner = ("SELECT path, src, pos, origin, import_type, generate_subscripts(names, 1) AS sub, unnest(names) AS item FROM "
                     "(SELECT *, CASE WHEN src = 0 THEN string_split(items, ',') ELSE [items] END AS names FROM found) n")
            head = (f"found AS ({found}), named AS (SELECT path, src * 100000000 + pos * 1000 + sub AS seq, trim(item) AS name, "
                    f"origin, import_type FROM ({inner}) i)")
        else:
            head = f"found AS ({found}), named AS (SELECT path, src * 100000000 + pos * 1000 AS seq, items AS name, origin, import_type FROM found)"
    return head + """,
symbols AS (SELECT path, name, arg_max(origin, seq) AS origin, arg_max(import_type, seq) AS import_type,
                   CAST(row_number() OVER (PARTITION BY path ORDER BY min(seq)) - 1 AS INT) AS ord
            FROM named WHERE name != '' GROUP BY path, name)"""


def _usages(profile: str) -> str:
    """Each use on a line without a direct hit: offsets, context, kind, arguments, record, length."""
    unity, legacy = profile == "unity", profile == "legacy"
    language = UNITY if unity else WEB
    if unity:
        finders = [("'\\b' || name || '\\.(\\w+)'", None), ("'\\b' || name || '\\.(\\w+)\\s*\\('", None), ("'\\b' || name || '\\s+(\\w+)'", None)]
    else:
        finders = [("'\\b' || name || '\\s*\\('", None), ("'\\.\\s*' || name || '\\s*\\('", None), ("'\\b' || name || '\\b'", "colon")]
    parts = []
    for n, (finder, look) in enumerate(finders):
        pattern = f"'(?is)(.*?)(' || {finder} || ')'"
        member = f"regexp_extract_all(line, {pattern}, 3)[k]" if unity else "NULL"
        part = f"""
SELECT path, project_path, language, line_number, line, name, origin, ord AS symbol_ord, {n} AS finder_ord,
       CAST(list_sum([length(s) for s in segs[1:k]]) - length(texts[k]) AS INT) AS match_start,
       CAST(list_sum([length(s) for s in segs[1:k]]) AS INT) AS match_end, texts[k] AS text, {member} AS member
FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS k
      FROM (SELECT *, regexp_extract_all(line, {pattern}, 0) AS segs, regexp_extract_all(line, {pattern}, 2) AS texts FROM unhit) a) b"""
        parts.append(part if not look else
                     f"SELECT * FROM ({part}) z WHERE NOT regexp_matches(substr(line, match_end + 1), '^\\s*:')")
    head = "regexp_extract(tail, '(?s)^[^(]*\\((?:[^()]|\\((?:[^()]|\\([^()]*\\))*\\))*\\)')"
    to_paren = "regexp_extract(tail, '(?s)^[^(]*\\(')"
    before = "substr(line, greatest(match_start - 10, 0) + 1, least(match_start, 10))"
    call = f"CASE WHEN {head} != '' THEN {head} ELSE {to_paren} END"
    prefix = "trim(substr(line, 1, match_start))"
    if unity:
        context = f"trim({before} || CASE WHEN contains(substr(tail, 1, 50), '(') THEN {call} ELSE substr(tail, 1, 50) END)"
        kind = (f"CASE WHEN contains(substr(tail, length(text) + 1, 10), '(') THEN 'method_call' WHEN contains(text, '.') THEN 'property_access' "
                f"WHEN regexp_matches({before}, 'new |var |public |private ') THEN 'declaration' "
                f"WHEN suffix(trim({before}), '=') THEN 'assignment' ELSE 'reference' END")
        keys = [("type_name", "name"), ("member_name", "member"), ("namespace", "origin"), ("usage_context", "context"), ("usage_type", "kind")]
    else:
        context = f"CASE WHEN contains(tail, '(') THEN trim({before} || {call}) ELSE trim(line) END"
        if legacy:
            kind = (f"CASE WHEN suffix({prefix}, '.') THEN 'method_call' WHEN suffix({prefix}, '=') THEN 'assignment' "
                    f"WHEN contains(right({prefix}, 10), 'new ') THEN 'constructor' ELSE 'function_call' END")
        else:
            kind = (f"CASE WHEN suffix({prefix}, '=') THEN 'assignment' WHEN contains({prefix}, '.') THEN 'method_call' "
                    f"WHEN contains(substr(tail, 1, 20), '(') THEN 'function_call' ELSE 'reference' END")
        keys = [("method_name", "name"), ("package", "origin"), ("call_context", "context"), ("call_type", "kind")]
    arguments = "nullif(trim(regexp_extract(context, '(?s)\\((.*)\\)', 1)), '')"
    if legacy:
        arguments = f"CASE WHEN kind IN ('function_call', 'method_call') THEN {arguments} END"
    size = " + ".join(f"{len(k) + 6} + {quoted(v)}" for k, v in keys)
    json = ", ".join(f"'\"{k}\": ' || CAST(to_json({v}) AS VARCHAR)" for k, v in keys + [("parameters", "parameters")])
    ordered = sorted(keys + [("parameters", "parameters")])
    page = ", ".join(f"'  \"{k}\": ' || CAST(to_json({v}) AS VARCHAR)" for k, v in ordered)
    flat = ", ".join("CASE WHEN parameters IS NOT NULL THEN concat('parameters=', parameters) END" if k == "parameters"
                     else f"concat('{k}=', {v})" for k, v in ordered)
    if unity:
        rum = ("CASE WHEN contains(lower(member), 'action') THEN 'rum_action' WHEN contains(lower(member), 'error') THEN 'rum_error' "
               "WHEN contains(lower(member), 'timing') THEN 'rum_timing' ELSE 'custom_attribute' END")
        log = ("CASE WHEN contains(lower(member), 'error') THEN 'log_error' WHEN contains(lower(member), 'warn') THEN 'log_warn' "
               "WHEN contains(lower(member), 'debug') THEN 'log_debug' ELSE 'log_info' END")
        operation = (f"CASE WHEN contains(lower(name), 'rum') THEN {rum} WHEN contains(lower(name), 'log') THEN {log} "
                     "WHEN contains(lower(name), 'datadog') AND contains(lower(name), 'sdk') THEN 'configuration' ELSE 'custom_attribute' END")
        category = ("CASE WHEN contains(lower(name), 'error') OR contains(lower(member), 'error') THEN 'error_data' "
                    "WHEN regexp_matches(lower(member), 'timing|performance') THEN 'performance_data' "
                    "WHEN contains(lower(member), 'action') AND regexp_matches(lower(member), 'tap|click|swipe|scroll|touch') THEN 'user_data' "
                    "WHEN contains(lower(name), 'config') OR regexp_matches(lower(member), 'init|setup') THEN 'configuration_data' ELSE 'system_data' END")
    else:
        rum = ("CASE WHEN contains(lower(name), 'action') THEN 'rum_action' WHEN contains(lower(name), 'error') THEN 'rum_error' "
               "WHEN contains(lower(name), 'timing') THEN 'rum_timing' ELSE 'custom_attribute' END")
        log = ("CASE WHEN contains(lower(name), 'error') THEN 'log_error' WHEN contains(lower(name), 'warn') THEN 'log_warn' "
               "WHEN contains(lower(name), 'debug') THEN 'log_debug' ELSE 'log_info' END")
        operation = (f"CASE WHEN contains(lower(origin), 'rum') OR name IN ('addAction', 'addError', 'addTiming') THEN {rum} "
                     f"WHEN contains(lower(origin), 'log') OR name IN ('logger', 'createLogger') THEN {log} "
                     "WHEN contains(lower(origin), 'react') OR name IN ('reactPlugin', 'createBrowserRouter') THEN 'configuration' "
                     "ELSE 'custom_attribute' END")
        category = ("CASE WHEN contains(lower(name), 'error') OR contains(lower(origin), 'error') THEN 'error_data' "
                    "WHEN regexp_matches(lower(name), 'timing|performance') THEN 'performance_data' "
                    "WHEN contains(lower(name), 'action') AND regexp_matches(lower(name), 'click|tap|swipe|scroll|input') THEN 'user_data' "
                    "WHEN contains(lower(origin), 'react') OR contains(lower(name), 'plugin') THEN 'configuration_data' ELSE 'system_data' END")
    return f"""
unhit AS (SELECT l.*, s.name, s.origin, s.ord FROM lines l JOIN symbols s ON l.path = s.path
          LEFT JOIN (SELECT DISTINCT path, line_number FROM direct) d ON l.path = d.path AND l.line_number = d.line_number
          WHERE d.path IS NULL AND l.language = {q(language)} AND contains(lower(l.line), lower(s.name))),
matched AS ({' UNION ALL '.join(parts)}),
usages AS (SELECT *, CAST({size} + CASE WHEN parameters IS NOT NULL THEN 16 + {quoted('parameters')} ELSE 0 END AS INT) AS repr_length,
                  concat_ws('|', {flat}) AS data, '{{' || concat_ws(', ', {json}) || '}}' AS json, '{{' || chr(10) || concat_ws(',' || chr(10), {page}) || chr(10) || '}}' AS page, {operation} AS operation_type, {category} AS data_category
           FROM (SELECT *, {arguments} AS parameters FROM (SELECT *, {context} AS context, {kind} AS kind
                 FROM (SELECT *, substr(line, match_start + 1) AS tail FROM matched) t) c) p),
best_use AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, line_number
               ORDER BY repr_length DESC, symbol_ord, finder_ord, match_start) AS place FROM usages) u WHERE place = 1)"""


def _rename(ctes: str, suffix: str) -> str:
    """The usage steps once more under other names, so both languages fit in one statement."""
    import re
    return re.sub(r"\b(unhit|matched|usages|best_use|symbols|named|found|ns)\b(?! *\()", r"\1" + suffix, ctes)


_ROUTE = _FILES + "," + _lines(_LIVE_LANGUAGE)
_LEGACY_ROUTE = _FILES + "," + _lines(_LEGACY_LANGUAGE)


def _all_found(lines: str = _ROUTE) -> str:
    """All live findings: best direct hits and best uses, both languages."""
    web = _rename(_symbols("web") + "," + _usages("web"), "_w")
    unity = _rename(_symbols("unity") + "," + _usages("unity"), "_u")
    columns = "path, project_path, language, line_number, line, operation_type, data_category, repr_length, data, json, page"
    return f"""WITH {lines}, {_direct()}, {_BEST}, {web}, {unity},
found_all AS (SELECT {columns}, false AS by_symbol FROM best
  UNION ALL SELECT {columns}, true FROM best_use_w UNION ALL SELECT {columns}, true FROM best_use_u)"""


_FLAT = "path, line_number, trim(line) AS code_snippet, operation_type, data_category, repr_length, data"
_IGNORED = """(contains(rel, '/de/') OR regexp_matches(rel, '(^|/)(node_modules|build|dist|\\.next|coverage|Library|Temp|Build|Builds|obj|bin)(/|$)')
  OR regexp_matches(rel, '\\.(min\\.js|bundle\\.js|meta)$'))"""
_KEPT_FILES = f"""
kept AS (SELECT project_path, path, content FROM (SELECT *, substr(path, length(project_path) + 2) AS rel FROM files) f
         WHERE NOT {_IGNORED})"""
_KEYWORD = "(" + " OR ".join(f"contains(lower(content), {q(k)})" for k in rules.FILE_KEYWORDS) + ")"
_SCAN_ROUTE = _FILES + "," + _KEPT_FILES + f", worded AS (SELECT * FROM kept WHERE {_KEYWORD})," + _lines(_LIVE_LANGUAGE, "worded")
_BRANCH = "coalesce(nullif(trim(current_branch), ''), nullif(regexp_extract(coalesce(trim(origin_head), ''), '[^/]*$'), ''), 'main')"


def _scan() -> str:
    return _all_found(_SCAN_ROUTE) + f""",
repos AS (SELECT project_path, {_BRANCH} AS branch FROM ({derived.CORPUS_REPOS}) m),
scan AS (SELECT regexp_extract(f.project_path, '[^/]*$') AS project_name, f.path AS file_path, line_number, line,
                operation_type, data_category, data, json, page, '{BASE}/' || regexp_extract(f.project_path, '[^/]*$') || '/blob/' ||
                coalesce(branch, 'main') || '/' || substr(f.path, length(f.project_path) + 2) || '#L' || line_number AS github_url
         FROM found_all f LEFT JOIN repos r ON f.project_path = r.project_path),
projects AS (SELECT regexp_extract(project_path, '[^/]*$') AS name, project_path AS path, 'unknown' AS project_type,
                    '{BASE}/' || regexp_extract(project_path, '[^/]*$') AS github_url FROM repos)"""


def _recounted(where: str, projects: str = "true") -> str:
    return f"""{_scan()} SELECT name, path, project_type, github_url, coalesce(n, 0) AS findings_count FROM projects
LEFT JOIN (SELECT project_name, count(*) AS n FROM scan WHERE {where} GROUP BY project_name) c ON project_name = name WHERE {projects}"""


def _hits(language: str) -> str:
    calls = rules.WEB_CALLS if language == WEB else rules.UNITY_CALLS
    parts = [f"SELECT path, line_number, '{name}' AS family, {j} AS pattern_ord, '{op}' AS operation_type FROM lines "
             f"WHERE language = {q(language)} AND regexp_matches(line, {rx(p, 'is')})"
             for name, op, _, pats, _ in calls for j, p in enumerate(pats)]
    return " UNION ALL ".join(parts)


def _extract(language, families, keys, legacy=False) -> str:
    route = _LEGACY_ROUTE if legacy else _ROUTE
    return (f"WITH {route}, {_direct(legacy, {(language, f) for f in families}, keys)} "
            f"SELECT path, line_number, family, {', '.join(keys)} FROM direct")


def _categories(language, legacy=False) -> str:
    return (f"WITH {_LEGACY_ROUTE if legacy else _ROUTE}, {_direct(legacy)} "
            f"SELECT path, line_number, family, data_category FROM direct WHERE language = {q(language)}")


def _symbol_rows(profile) -> str:
    route = _LEGACY_ROUTE if profile == "legacy" else _ROUTE
    return f"WITH {route}, {_symbols(profile)} SELECT path, ord, name, origin, import_type FROM symbols"


def _usage_rows(profile, columns) -> str:
    legacy = profile == "legacy"
    route = _LEGACY_ROUTE if legacy else _ROUTE
    return f"WITH {route}, {_direct(legacy)}, {_symbols(profile)}, {_usages(profile)} SELECT {columns} FROM usages"


def _both_usages(columns) -> str:
    web = _rename(_symbols("web") + "," + _usages("web"), "_w")
    unity = _rename(_symbols("unity") + "," + _usages("unity"), "_u")
    return (f"WITH {_ROUTE}, {_direct()}, {web}, {unity} SELECT {columns} FROM usages_w "
            f"UNION ALL SELECT {columns} FROM usages_u")


_PLACE = "path, line_number, name, finder_ord, match_start"
_DISCOVER = f"""
WITH listing AS ({derived.LISTING}), manifests AS ({derived.MANIFESTS}),
parts AS (SELECT root, is_dir, string_split(substr(path, length(root) + 2), '/') AS p FROM listing),
named AS (SELECT root, is_dir, p[1] AS child, CASE WHEN len(p) > 1 THEN p[2] END AS entry FROM parts),
marks AS (SELECT *, coalesce(entry IN ('package.json', 'Assets', 'ProjectSettings', 'src', 'tsconfig.json', 'next.config.js')
                    OR entry LIKE '%.csproj', false) AS m,
                 coalesce(child IN ('package.json', 'Assets', 'ProjectSettings', 'src', 'tsconfig.json', 'next.config.js')
                    OR child LIKE '%.csproj', false) AS mc FROM named),
facts AS (
  SELECT root, root AS path, true AS is_self, bool_or(mc) AS is_root, bool_or(child = 'package.json') AS has_manifest,
         bool_or(child = 'Assets') AS has_assets, bool_or(child = 'ProjectSettings') AS has_settings,
         bool_or(child LIKE '%.csproj') AS has_csproj FROM marks GROUP BY root
  UNION ALL
  SELECT root, root || '/' || child, false, bool_or(m), bool_or(coalesce(entry = 'package.json', false)),
         bool_or(coalesce(entry = 'Assets', false)), bool_or(coalesce(entry = 'ProjectSettings', false)),
         bool_or(coalesce(entry LIKE '%.csproj', false))
  FROM marks WHERE child NOT LIKE '.%' GROUP BY root, child HAVING bool_or(is_dir OR entry IS NOT NULL)),
found AS (SELECT f.*, manifests.content FROM facts f LEFT JOIN manifests ON manifests.project_path = f.path
          WHERE f.is_root AND (f.is_self OR f.root NOT IN (SELECT root FROM facts WHERE is_self AND is_root))),
projects AS (SELECT root, regexp_extract(path, '[^/]*$') AS name, path, '{BASE}/' || regexp_extract(path, '[^/]*$') AS github_url,
  CASE WHEN has_manifest AND json_valid(content) AND content LIKE '%"next":%' THEN 'nextjs' WHEN has_manifest AND json_valid(content) AND content LIKE '%"react":%' THEN 'react'
       WHEN has_manifest THEN 'node' WHEN has_assets AND has_settings OR has_csproj THEN 'unity' ELSE 'unknown' END AS project_type
  FROM found)"""


def _globs_sql() -> str:
    rows = ", ".join(f"({q(t)}, {q(g)})" for t, globs in rules.IGNORE_GLOBS.items() for g in globs)
    return (f"{_DISCOVER} SELECT DISTINCT g AS glob FROM (SELECT g FROM (VALUES {rows}) v(t, g) "
            "JOIN projects ON t = project_type UNION ALL SELECT unnest(['*/de/*', 'coverage/**'])) u")


def _shown(scan: str) -> str:
    """Findings with the text they are shown with: file, labels, context without its last line, code, data."""
    return f"""{scan}, around AS (SELECT path, line_number AS n, list(line) OVER
    (PARTITION BY path ORDER BY line_number ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM lines),
shown AS (SELECT scan.*, lower(concat_ws(' ', regexp_extract(file_path, '[^/]*$'), operation_type, 'Line ' || line_number, array_to_string(w[1:len(w) - 1], ' '),
    trim(line), CASE WHEN data <> '' THEN 'Data Being Sent: ' || page END, 'View on GitHub Copy Code')) AS text
  FROM scan JOIN around ON path = file_path AND n = line_number)"""


def _encoded_rows() -> str:
    return ", ".join(f"({i}, {', '.join(q(x) for x in kind)})" for i, kind in enumerate(derived.ENCODED))


def _pattern_rows() -> str:
    return ", ".join(f"({q(lang)}, {q(name)}, {j})" for lang, calls in ((WEB, rules.WEB_CALLS), (UNITY, rules.UNITY_CALLS))
                     for name, _, _, pats, _ in calls for j in range(len(pats)))


def oracles() -> dict[str, str]:
    found, scan = _all_found(), _scan()
    out = {
        "ts_rule_hits": f"WITH {_ROUTE} {_hits(WEB)}",
        "cs_rule_hits": f"WITH {_ROUTE} {_hits(UNITY)}",
        "rule_hits_by_family":
            f"WITH {_ROUTE}, w AS ({_hits(WEB)}), u AS ({_hits(UNITY)}) "
            f"SELECT {q(WEB)} AS language, family, count(*) AS hits FROM w GROUP BY family "
            f"UNION ALL SELECT {q(UNITY)}, family, count(*) FROM u GROUP BY family",
        "operation_of_rule":
            f"WITH {_ROUTE}, {_direct()} SELECT language, family, operation_type, count(*) AS findings FROM direct GROUP BY ALL",
        "extract_ts_imports": _extract(WEB, ("imports",), ("imported_items", "package")),
        "extract_ts_logs": _extract(WEB, LOGS, ("log_message", "parameters")),
        "extract_ts_rum": _extract(WEB, RUM, ("action_name", "parameters")),
        "extract_cs_imports": _extract(UNITY, ("imports",), ("namespace",)),
        "extract_cs_logs": _extract(UNITY, LOGS, ("log_message", "parameters")),
        "extract_cs_rum": _extract(UNITY, RUM, ("action_type", "action_name", "parameters")),
        "extract_cs_attribute": _extract(UNITY, ("rum_attribute",), ("attribute_key", "attribute_value")),
        "extract_cs_user_info": _extract(UNITY, ("user_info",), ("parameters",)),
        "extract_legacy_init": _extract(WEB, ("init",), ("configuration", "application_id", "client_token", "site"), True),
        "extract_legacy_rum": _extract(WEB, RUM, ("parameters", "action_name", "error_message"), True),
        "extract_legacy_log": _extract(WEB, LOGS, ("parameters", "log_message"), True),
        "detailed_params": f"""WITH {_LEGACY_ROUTE}, {_direct(True)}, hit AS (SELECT DISTINCT path, line_number, line FROM direct),
args AS (SELECT path, line_number, {value(fields.CALL_ARGUMENTS)} AS a FROM hit),
pairs AS (SELECT path, line_number, unnest(regexp_extract_all(a, {rx(fields.NAMED_ARGUMENT)}, 1)) AS k,
                 unnest(regexp_extract_all(a, {rx(fields.NAMED_ARGUMENT)}, 2)) AS v,
                 generate_subscripts(regexp_extract_all(a, {rx(fields.NAMED_ARGUMENT)}, 1), 1) AS i FROM args),
kv AS (SELECT path, line_number, string_agg(k || '=' || v, '|' ORDER BY k) AS named FROM (
         SELECT path, line_number, k, trim(arg_max(v, i)) AS v FROM pairs GROUP BY path, line_number, k) l GROUP BY path, line_number)
SELECT args.path, args.line_number,
       CASE WHEN named IS NOT NULL OR len(regexp_extract_all(a, {rx(fields.LEGACY_LITERAL)}, 1)) > 0 THEN coalesce(named, '') END AS named,
       CASE WHEN named IS NOT NULL OR len(regexp_extract_all(a, {rx(fields.LEGACY_LITERAL)}, 1)) > 0
            THEN array_to_string(regexp_extract_all(a, {rx(fields.LEGACY_LITERAL)}, 1), '|') END AS literals
FROM args LEFT JOIN kv ON args.path = kv.path AND args.line_number = kv.line_number""",
        "category_ts": _categories(WEB),
        "category_cs": _categories(UNITY),
        "category_legacy": _categories(WEB, True),
        "ts_import_symbols": _symbol_rows("web"),
        "ts_import_symbols_split": _symbol_rows("web_split"),
        "legacy_import_symbols": _symbol_rows("legacy"),
        "cs_import_types": _symbol_rows("unity"),
        "ts_symbol_usages": _usage_rows("web", f"{_PLACE}, match_end, origin"),
        "ts_symbol_usages_split": _usage_rows("web_split", f"{_PLACE}, match_end, origin"),
        "legacy_symbol_usages": _usage_rows("legacy", f"{_PLACE}, origin, kind, parameters"),
        "cs_type_usages": _usage_rows("unity", f"{_PLACE}, match_end, member, origin"),
        "call_context": _both_usages(f"language, {_PLACE}, context AS call_context"),
        "call_type": _usage_rows("web", f"{_PLACE}, kind AS call_type"),
        "usage_type": _usage_rows("unity", f"{_PLACE}, kind AS usage_type"),
        "call_parameters": _both_usages(f"language, {_PLACE}, parameters"),
        "usage_only_unhit_lines": f"{found} SELECT language, by_symbol, count(*) AS lines, count(DISTINCT path) AS files FROM found_all GROUP BY ALL",
        "usage_findings": f"{found} SELECT path, line_number, operation_type, data_category, repr_length, data FROM found_all WHERE by_symbol",
        "legacy_usage_findings":
            f"WITH {_LEGACY_ROUTE}, {_direct(True)}, {_symbols('legacy')}, {_usages('legacy')} "
            "SELECT path, line_number, operation_type, data_category, repr_length, data FROM best_use",
        "best_finding_per_line": f"{found} SELECT {_FLAT} FROM found_all",
        "best_finding_by_grouping": f"WITH {_ROUTE}, {_direct()}, {_BEST} SELECT path, line_number, family, data_category, repr_length FROM best",
        "legacy_findings": f"WITH {_LEGACY_ROUTE}, {_direct(True)}, {_BEST} SELECT {_FLAT} FROM best",
        "repr_length": f"""
SELECT doc_id AS id, part, CAST({quoted('t')} AS INT) AS quoted FROM (
  SELECT doc_id, CAST(generate_subscripts(p, 1) AS INT) AS part, unnest(p) || '''' || '\\' AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) d) s
UNION ALL
SELECT conv_id, CAST(-turn - 1 AS INT), CAST(20 + {quoted('role')} + {quoted('said')} AS INT) FROM (
  SELECT conv_id, turn, role, replace(text, chr(10), chr(9)) AS said FROM conversations) c""",
        "context_lines": f"""{found}, numbered AS (SELECT path, line_number, line FROM lines)
SELECT f.path, f.line_number, string_agg(n.line, '~' ORDER BY n.line_number) AS context FROM found_all f
JOIN numbered n ON f.path = n.path AND n.line_number BETWEEN f.line_number - 3 AND f.line_number + 3 GROUP BY f.path, f.line_number""",
        "line_split": f"WITH {_FILES}, lines AS (SELECT path, CAST(generate_subscripts(parts, 1) AS INT) AS line_number, unnest(parts) AS line "
                      f"FROM (SELECT path, string_split(content, chr(10)) AS parts FROM files) s) SELECT path, count(*) AS lines, max(line_number) AS last, CAST(sum(length(line)) AS BIGINT) AS characters FROM lines GROUP BY path",
        "snippet_strip": "SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS snippet FROM conversations",
        "file_url": f"""WITH {_FILES}, placed AS (SELECT path, regexp_extract(project_path, '[^/]*$') AS project, substr(path, length(project_path) + 2) AS rel,
  string_split(path, '/') AS p, CASE WHEN length(path) % 5 > 0 THEN '#L' || (length(path) % 5) ELSE '' END AS anchor FROM files)
SELECT path, '{BASE}/' || project || '/blob/main/' || rel || anchor AS inside,
       '{BASE}/' || p[len(p) - 2] || '/blob/main/' || p[len(p)] || anchor AS outside FROM placed""",
        "project_url": f"SELECT s_suppkey, '{BASE}/' || s_name AS url FROM supplier",
        "project_name_from_path": f"""WITH {_FILES} SELECT path, string_split(path, '/')[3] AS inside,
  string_split(path, '/')[len(string_split(path, '/')) - 2] AS outside, 'unknown' AS short FROM files""",
        "url_validity": """WITH made AS (SELECT page_id, url FROM pages
  UNION ALL SELECT page_id + 1000000000, replace(url, 'example', 'github') FROM pages
  UNION ALL SELECT page_id + 2000000000, concat('https://github.com/', CAST(page_id AS STRING)) FROM pages
  UNION ALL SELECT page_id + 3000000000, concat('ftp://github.com/', CAST(page_id AS STRING)) FROM pages
  UNION ALL SELECT page_id + 4000000000, concat(url, '&next=github.com') FROM pages),
parts AS (SELECT page_id, string_split(url, '://') AS s FROM made)
SELECT page_id, lower(s[1]) IN ('http', 'https') AND contains(regexp_extract(s[2], '^[^/?#]*'), 'github.com') AS valid FROM parts""",
        "branch_resolution": f"SELECT project_path, {_BRANCH} AS branch FROM ({derived.REPO_META}) m",
        "repo_info": f"SELECT project_path, {_BRANCH} AS branch, trim(remote_url) AS remote_url, substr(commit_hash, 1, 7) AS commit_hash FROM ({derived.REPO_META}) m",
        "ext_route": f"WITH {_FILES} SELECT path, {_EXT} AS extension, {_LIVE_LANGUAGE} AS language FROM files",
        "language_catalogue": f"""WITH {_ROUTE}, known AS (SELECT * FROM (VALUES ({q(WEB)}, '.ts'), ({q(WEB)}, '.tsx'), ({q(WEB)}, '.js'),
  ({q(WEB)}, '.jsx'), ({q(UNITY)}, '.cs')) k(language, extension))
SELECT known.language, known.extension, count(path) AS files FROM known LEFT JOIN routed r
ON r.language = known.language AND lower({_EXT.replace('path', 'r.path')}) = known.extension GROUP BY ALL""",
        "legacy_file_predicate": f"WITH {_FILES} SELECT path, {_EXT} IN ('.js', '.jsx', '.ts', '.tsx', '.vue', '.svelte') AS eligible FROM files",
        "ignore_globs_effective": _globs_sql(),
        "ignore_filter": f"WITH {_FILES}, {_KEPT_FILES} SELECT project_path, path FROM kept",
        "keyword_filter": f"WITH {_FILES} SELECT path FROM files WHERE {_KEYWORD}",
        "decode_and_newlines": "SELECT doc_id, text AS content FROM documents",
        "charset_detection": f"""WITH kinds(i, charset, head, letters, own) AS (VALUES {_encoded_rows()})
SELECT doc_id, charset,
  head || CASE WHEN letters = '' THEN text ELSE translate(regexp_replace(text, '[^\\x00-\\x7f]', 'e', 'g'), letters, own) END AS content
FROM documents JOIN kinds ON doc_id % {len(derived.ENCODED)} = i""",
        "files_scanned": f"WITH {_FILES}, {_KEPT_FILES} SELECT count(*) AS total_files_scanned FROM kept WHERE {_LIVE_LANGUAGE} IS NOT NULL",
        "project_discovery": f"{_DISCOVER} SELECT root, name, path, github_url FROM projects",
        "project_type": f"{_DISCOVER} SELECT path, project_type FROM projects",
        "project_facts": f"{_DISCOVER} SELECT root, path, is_self, is_root, has_manifest, has_assets, has_settings, has_csproj FROM facts",
        "findings_by_project": f"{scan} SELECT file_path, line_number, github_url FROM scan WHERE project_name = 'src3'",
        "findings_by_category": f"{scan} SELECT file_path, line_number, project_name FROM scan WHERE data_category = 'performance_data'",
        "findings_by_operation": f"{scan} SELECT file_path, line_number, project_name FROM scan WHERE operation_type = 'rum_error'",
        "filter_data_type": _recounted("data_category = 'user_data'"),
        "filter_project": _recounted("project_name = 'src5'", "name = 'src5'"),
        "search_findings": f"""{scan}, near AS (SELECT s.file_path, s.line_number, any_value(s.line) AS line, any_value(s.page) AS page,
    string_agg(n.line, ' ' ORDER BY n.line_number) FILTER (WHERE n.line_number < least(s.line_number + 3, n.total)) AS around
  FROM scan s JOIN (SELECT *, max(line_number) OVER (PARTITION BY path) AS total FROM lines) n
    ON s.file_path = n.path AND n.line_number BETWEEN s.line_number - 3 AND s.line_number + 3
  WHERE s.data_category = 'error_data' AND s.operation_type = 'rum_error' GROUP BY s.file_path, s.line_number)
SELECT file_path, line_number FROM near WHERE contains(lower(concat_ws(' ', regexp_extract(file_path, '[^/]*$'), around, line, page)), '": "the')""",
        "search_by_index": f"""{_shown(scan)} SELECT term, file_path, line_number FROM shown
JOIN (SELECT unnest(['setSdkVerbosity', 'clickAction("A', 'Line 63 ', '": "the', 'no such words', 'x9', 'the']) AS term) t ON contains(shown.text, lower(term))""",
        "search_of_project_by_index": f"""{_shown(scan)} SELECT file_path, line_number FROM shown
WHERE contains(text, '": "the') AND project_name = 'src3' AND data_category = 'error_data' AND operation_type = 'log_error'""",
        "shelved_project": f"""{scan} SELECT project_name, operation_type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS findings_count
FROM scan WHERE project_name = 'src5' GROUP BY project_name, operation_type""",
        "filter_data_type_findings": f"{scan} SELECT file_path, line_number, operation_type FROM scan WHERE data_category = 'user_data'",
        "filter_project_findings": f"{scan} SELECT file_path, line_number, operation_type FROM scan WHERE project_name = 'src5'",
        "group_rows_by_project_and_category": f"""{scan}
SELECT project_name AS value, file_path, line_number, count(*) OVER (PARTITION BY project_name) AS group_size FROM scan
UNION ALL SELECT data_category, file_path, line_number, count(*) OVER (PARTITION BY data_category) FROM scan""",
        "statistics_grouping_sets": f"""{scan}
SELECT 'project' AS dimension, project_name AS value, count(*) AS findings, count(DISTINCT file_path) AS files FROM scan GROUP BY 2
UNION ALL SELECT 'category', data_category, count(*), count(DISTINCT file_path) FROM scan GROUP BY 2
UNION ALL SELECT 'operation', operation_type, count(*), count(DISTINCT file_path) FROM scan GROUP BY 2
UNION ALL SELECT 'total', NULL, count(*), count(DISTINCT file_path) FROM scan""",
        "group_rows": f"{scan} SELECT operation_type, file_path, line_number, count(*) OVER (PARTITION BY operation_type) AS group_size FROM scan",
        "files_with_findings": f"{scan} SELECT count(DISTINCT file_path) AS files_with_findings FROM scan",
        "findings_per_project": _recounted("true"),
        "category_summary": f"{scan} SELECT data_category, count(*) AS findings FROM scan GROUP BY data_category",
        "report_order": f"{scan} SELECT project_name, project_type, file_path, line_number FROM scan JOIN projects ON name = project_name",
        "scan_union": f"""{found} SELECT path, count(*) * CASE WHEN path IN (SELECT path FROM ({derived.DOCUMENT_FILES}) d) THEN 2 ELSE 1 END AS findings
FROM found_all GROUP BY path""",
        "scan_totals": f"""{scan} SELECT 'projects' AS metric, count(*) AS value FROM projects
UNION ALL SELECT 'files_scanned', count(*) FROM kept WHERE {_LIVE_LANGUAGE} IS NOT NULL
UNION ALL SELECT 'findings', count(*) FROM scan""",
        "csv_rows": f"""{scan} SELECT project_name AS project, file_path, line_number, operation_type, data_category,
  trim(line) AS code_snippet, json AS data_being_sent, github_url FROM scan""",
        "json_rows": f"""{scan}, around AS (SELECT path AS p, line_number AS n, string_agg(line, '~') OVER
    (PARTITION BY path ORDER BY line_number ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS context FROM lines)
SELECT 'file_path,line_number,code_snippet,operation_type,data_being_sent,data_category,context_lines,github_url,project_name,extracted_parameters' AS keys,
  file_path, line_number, trim(line) AS code_snippet, operation_type, data, data_category, context, github_url, project_name, CAST(NULL AS VARCHAR) AS extracted_parameters
FROM scan JOIN around ON p = file_path AND n = line_number""",
        "json_document": f"""{scan}, counted AS (SELECT projects.*, coalesce(n, 0) AS findings_count FROM projects
  LEFT JOIN (SELECT project_name, count(*) AS n FROM scan GROUP BY project_name) c ON project_name = name),
items AS (
  SELECT 0 AS section, '' AS k0, '' AS k1, CAST(0 AS BIGINT) AS number, '{{"projects":[' AS item
  UNION ALL SELECT 1, path, name, 0, 'name,path,project_type,github_url,findings_count|' || concat_ws('|', name, path, project_type, github_url, findings_count) FROM counted
  UNION ALL SELECT 2, '', '', 0, '],"findings":['
  UNION ALL SELECT 3, project_name, file_path, line_number, concat_ws('|', file_path, line_number, operation_type, github_url) FROM scan
  UNION ALL SELECT 4, '', '', 0, '],"total_files_scanned":' || count(*) || ',"scan_duration":0.0}}' FROM kept WHERE {_LIVE_LANGUAGE} IS NOT NULL)
SELECT section, k0, k1, number, 0 AS copy, section IN (1, 3) AND row_number() OVER (PARTITION BY section ORDER BY k0, k1, number) > 1 AS comma, item FROM items""",
        "report_feed": f"""{scan}, parts AS (
  SELECT 'by_project' AS part, project_name AS value, count(*) AS n FROM scan GROUP BY 2
  UNION ALL SELECT 'by_category', data_category, count(*) FROM scan GROUP BY 2
  UNION ALL SELECT 'by_operation', operation_type, count(*) FROM scan GROUP BY 2
  UNION ALL SELECT 'statistics_project', project_name, count(*) FROM scan GROUP BY 2
  UNION ALL SELECT 'statistics_category', data_category, count(*) FROM scan GROUP BY 2
  UNION ALL SELECT 'statistics_operation', operation_type, count(*) FROM scan GROUP BY 2
  UNION ALL SELECT 'statistics_total', NULL, count(*) FROM scan
  UNION ALL SELECT 'totals', 'projects', count(*) FROM projects
  UNION ALL SELECT 'totals', 'files_scanned', count(*) FROM kept WHERE {_LIVE_LANGUAGE} IS NOT NULL
  UNION ALL SELECT 'totals', 'findings', count(*) FROM scan
  UNION ALL SELECT 'projects', name, coalesce(n, 0) FROM projects LEFT JOIN (SELECT project_name, count(*) AS n FROM scan GROUP BY project_name) c ON project_name = name
  UNION ALL SELECT 'findings', project_name, count(*) FROM scan GROUP BY 2) SELECT * FROM parts""",
        "overlapping_roots": f"""{scan}, n AS (SELECT project_name, count(*) AS n FROM scan GROUP BY project_name)
SELECT '/repos' AS root, path, name, coalesce(n, 0) AS findings_count FROM projects LEFT JOIN n ON project_name = name
UNION ALL SELECT '/repos/src3', '/repos/src3', 'src3', n FROM n WHERE project_name = 'src3'
UNION ALL SELECT '/other', '/other/src3', 'src3', n FROM n WHERE project_name = 'src5'""",
        "files_read_once": f"""WITH {_FILES}, r AS (SELECT * FROM files WHERE {_LIVE_LANGUAGE} IS NOT NULL),
given AS (SELECT '/repos' AS root, path, content FROM r
  UNION ALL SELECT '/repos/src3', path, content FROM r WHERE project_path = '/repos/src3'
  UNION ALL SELECT '/other', replace(path, '/repos/src5/', '/other/src3/'), content FROM r WHERE project_path = '/repos/src5'
  UNION ALL SELECT '/repos/p1', path, content || CASE WHEN length(path) % 4 = 0 THEN '// changed' ELSE '' END FROM r WHERE project_path = '/repos/p1'),
once AS (SELECT path, content, arg_min(root, length(root)) AS root FROM given GROUP BY path, content)
SELECT root, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS characters FROM once GROUP BY root""",
        "overlapping_totals": f"""{scan}, f AS (SELECT project_path FROM kept WHERE {_LIVE_LANGUAGE} IS NOT NULL)
SELECT 'projects' AS metric, count(*) + 2 AS value FROM projects
UNION ALL SELECT 'files_scanned', CAST(sum(CASE WHEN project_path IN ('/repos/src3', '/repos/src5') THEN 2 ELSE 1 END) AS BIGINT) FROM f
UNION ALL SELECT 'findings', CAST(sum(CASE WHEN project_name IN ('src3', 'src5') THEN 2 ELSE 1 END) AS BIGINT) FROM scan""",
        "charset_scan": f"{scan} SELECT file_path, line_number, operation_type, trim(line) AS code_snippet FROM scan",
        "encoded_scan": f"{scan} SELECT file_path, line_number, operation_type, trim(line) AS code_snippet FROM scan",
        "many_families": f"""WITH notes AS (SELECT path, CAST(generate_subscripts(p, 1) AS INT) AS line_number, unnest(p) AS line
  FROM (SELECT path, string_split(content, chr(10)) AS p FROM ({derived.DOCUMENT_FILES}) d WHERE path LIKE '%.md') s),
numbers AS (SELECT path, line_number, list_filter(regexp_extract_all(line, '[0-9]+'), lambda x: regexp_matches(x, '^(0|[1-9][0-9]{{0,3}})$')) AS xs FROM notes),
least AS (SELECT path, line_number, list_min(list_transform(xs, lambda x: CAST(x AS INT))) AS x FROM numbers)
SELECT path, line_number, 'n' || x AS family FROM least WHERE x < 1500""",
        "thousands_of_ignore_globs": f"""WITH f AS (SELECT project_path, path, substr(path, length(project_path) + 2) AS rel FROM ({derived.DOCUMENT_FILES}) d),
p AS (SELECT *, string_split(rel, '/') AS c, TRY_CAST(regexp_extract(rel, '/d([0-9]+)\\.[^/]*$', 1) AS BIGINT) AS n FROM f)
SELECT project_path, path FROM p WHERE NOT (
  (rel LIKE '%.ts' AND n % 3 = 0 AND n < 9000) OR (rel LIKE '%.tsx' AND len(list_filter(range(0, 2000, 7), lambda i: ends_with(rel, i || '.tsx'))) > 0)
  OR (c[1] = 'src' AND c[2] IN ('de', 'en', 'fr', 'es') AND rel LIKE '%.js' AND rel NOT LIKE '%.min.js' AND n % 4 = 0 AND n < 8000)
  OR rel LIKE 'Assets/en/%' OR rel LIKE 'dist/_e/%')""",
        "observed_totals": f"""{scan} SELECT count(*) AS findings, (SELECT count(*) FROM kept WHERE {_LIVE_LANGUAGE} IS NOT NULL) AS total_files_scanned FROM scan""",
        "merged_scans": f"""{scan}, s AS (SELECT 'project' AS dimension, project_name AS value, count(*) AS findings, count(DISTINCT file_path) AS files FROM scan GROUP BY 2
UNION ALL SELECT 'category', data_category, count(*), count(DISTINCT file_path) FROM scan GROUP BY 2
UNION ALL SELECT 'operation', operation_type, count(*), count(DISTINCT file_path) FROM scan GROUP BY 2
UNION ALL SELECT 'total', NULL, count(*), count(DISTINCT file_path) FROM scan) SELECT *, true AS same, true AS close FROM s""",
        "directory_scan": f"""{scan} SELECT project_name, file_path, line_number, operation_type, '{BASE}/' || project_name || '/blob/main/' ||
  substr(file_path, length('/repos/' || project_name) + 2) || '#L' || line_number AS github_url FROM scan WHERE file_path LIKE '/repos/src%'""",
        "files_by_bytes": f"""SELECT count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes, true AS even, true AS numbered
FROM ({derived.DOCUMENT_FILES}) d""",
        "thousands_of_families": """WITH l AS (SELECT '/notes/' || doc_id || '.md' AS path, CAST(generate_subscripts(p, 1) AS INT) AS line_number, lower(unnest(p)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) s),
g AS (SELECT path, line_number, list_min(list_filter(list_transform(range(length(line) - 2), lambda i: substr(line, i + 1, 3)),
  lambda x: regexp_matches(x, '^[a-u]{3}$'))) AS family FROM l)
SELECT path, line_number, family FROM g WHERE family IS NOT NULL""",
        "live_detailed": f"{found} SELECT language, count(*) AS lines, CAST(0 AS BIGINT) AS detailed FROM found_all GROUP BY language",
        "pattern_hits": f"""WITH {_ROUTE}, w AS ({_hits(WEB)}), u AS ({_hits(UNITY)}),
hits AS (SELECT {q(WEB)} AS language, family, pattern_ord FROM w UNION ALL SELECT {q(UNITY)}, family, pattern_ord FROM u),
known AS (SELECT * FROM (VALUES {_pattern_rows()}) k(language, family, pattern_ord))
SELECT known.language, known.family, CAST(known.pattern_ord AS INT) AS pattern_ord, count(hits.family) AS hits FROM known
LEFT JOIN hits ON hits.language = known.language AND hits.family = known.family AND hits.pattern_ord = known.pattern_ord GROUP BY ALL""",
        "language_lookup": f"""WITH {_ROUTE}, names AS (
  SELECT DISTINCT substr(language, 1, length(path) % length(language) + 1) AS name FROM routed UNION SELECT {_EXT} FROM routed),
known AS (SELECT unnest([{q(WEB)}, {q(UNITY)}]) AS language)
SELECT name, known.language FROM names LEFT JOIN known ON contains(lower(known.language), lower(name)) OR contains(lower(name), lower(known.language))""",
        "full_scan": f"""{_all_found(_SCAN_ROUTE)}, repos AS (SELECT project_path, {_BRANCH} AS branch FROM ({derived.CORPUS_REPOS}) m),
linked AS (SELECT regexp_extract(f.project_path, '[^/]*$') AS project_name, '{BASE}/' || regexp_extract(f.project_path, '[^/]*$') || '/blob/' ||
  coalesce(branch, 'main') || '/' || substr(f.path, length(f.project_path) + 2) || '#L' || line_number AS url
  FROM found_all f LEFT JOIN repos r ON f.project_path = r.project_path)
SELECT project_name, count(*) AS findings, min(url) AS first_url, max(url) AS last_url FROM linked GROUP BY project_name""",
        "registered_rules": f"""WITH notes AS (SELECT path, CAST(generate_subscripts(p, 1) AS INT) AS line_number, unnest(p) AS line
  FROM (SELECT path, string_split(content, chr(10)) AS p FROM ({derived.DOCUMENT_FILES}) d WHERE path LIKE '%.md') s),
hit AS (SELECT *, regexp_matches(line, '[0-9]{{3,}}') AS num, regexp_matches(line, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])the(?:[^\\p{{L}}\\p{{N}}_]|$)') AS the,
   regexp_extract(line, '[0-9]{{3,}}') AS digits, regexp_extract(line, '(?:^|[^\\p{{L}}\\p{{N}}_])(the [\\p{{L}}\\p{{N}}_]+)', 1) AS word FROM notes),
sized AS (SELECT *, CASE WHEN num THEN 14 + length(digits) END AS a,
                 CASE WHEN the THEN CASE WHEN word = '' THEN 2 ELSE 12 + length(word) END END AS b FROM hit WHERE num OR the)
SELECT path, line_number, CASE WHEN coalesce(a, 0) >= coalesce(b, 0) THEN 'custom_attribute' ELSE 'configuration' END AS operation_type,
  CASE WHEN coalesce(a, 0) >= coalesce(b, 0) THEN 'system_data' ELSE 'user_data' END AS data_category,
  CASE WHEN coalesce(a, 0) >= coalesce(b, 0) THEN 'digits=' || digits WHEN word = '' THEN '' ELSE 'word=' || word END AS data FROM sized""",
        "scan_statistics": f"""{scan} SELECT project_name, data_category, operation_type, count(*) AS findings,
  count(DISTINCT file_path) AS files FROM scan GROUP BY ALL""",
    }
    return out
