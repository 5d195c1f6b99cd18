"""Imported names and the places that use them.

Symbols are an ordered array column of a file row, so following them needs no join:
file, line and symbol are already together. Every step is a SQL
expression over the row, built as text (see ``functions.text``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from beaconaudit.functions import labels
from beaconaudit.functions.text import case, folded, group, groups, lit, not_blank, quoted_length, strip, widened

# Import statements and the names they bring along.
NAMED_IMPORT = r"import\s+\{\s*([^}]+)\s*\}\s+from\s+['\"](@datadog/[^'\"]+)['\"]"
DEFAULT_IMPORT = r"import\s+(\w+)\s+from\s+['\"](@datadog/[^'\"]+)['\"]"
NAMESPACE_IMPORT = r"import\s+\*\s+as\s+(\w+)\s+from\s+['\"](@datadog/[^'\"]+)['\"]"
USING = r"using\s+(Datadog\.Unity(?:\.[A-Za-z]+)*)\s*;"
USING_RUM = (("RumUserActionType", "enum"), ("IDdRum", "interface"))
USING_LOGS = (("DdLogLevel", "enum"), ("DdLogger", "class"))
# How far the context of a use reaches.
BEFORE = 10
TYPE_REACH = 50
CALL_REACH = 20
MEMBER_REACH = 10

# A call up to its closing parenthesis, for up to four levels of nesting.
# Possessive throughout: linear time, and no deep recursion on long lines.
_NESTED = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"
_CALL_HEAD = r"(?s)^[^(]*+" + _NESTED

SYMBOLS = "array<struct<name:string,origin:string,import_type:string>>"
EMPTY = f"cast(array() AS {SYMBOLS})"


def _flags(pattern: str) -> str:
    return "(?isU)" + widened(pattern)


def _symbol(name: str, origin: str, import_type: str) -> str:
    return f"named_struct('name', {name}, 'origin', {origin}, 'import_type', {import_type})"


def _last_of_each_name(symbols: str) -> str:
    """One entry per name, in order of first sight, holding what was seen last.

    The inner array is bound once, by wrapping it, so it is not computed per name.
    """
    last = "transform(array_distinct(transform(found, s -> s.name)), n -> element_at(filter(found, s -> s.name = n), -1))"
    return f"transform(array({symbols}), found -> {last})[0]"


def _named(symbols: str) -> str:
    """Without blank names."""
    return f"filter({symbols}, s -> s.name != '')"


def _statements(text: str, pattern: str, import_type: str) -> str:
    """Symbols of import statements. The text is searched once; names are read from what was found."""
    name, origin = (f"regexp_extract(st, {lit(_flags(pattern))}, {i})" for i in (1, 2))
    return f"transform({groups(text, _flags(pattern), 0)}, st -> {_symbol(strip(name), origin, lit(import_type))})"


def web_symbols(content: str, split_named: bool = False) -> str:
    """Names imported from the SDK's packages.

    A braced list counts as one symbol, spelt as it stands between the braces.
    ``split_named`` takes the list apart instead. Blank lists name nothing.
    """
    braced = _statements(content, NAMED_IMPORT, "default")
    if split_named:
        item = _symbol(strip("n"), "b.origin", "'destructured'")
        braced = f"flatten(transform({braced}, b -> transform(split(b.name, ','), n -> {item})))"
    found = _named(f"concat({braced}, {_statements(content, DEFAULT_IMPORT, 'default')})")
    return case((f"contains(lower({content}), '@datadog/')", _last_of_each_name(found)), otherwise=EMPTY)


def legacy_symbols(content: str) -> str:
    """Names imported on one line each: named (aliases cut off), default and namespace imports."""
    kind = "if(contains(l, '{'), 'named', 'default')"
    name = strip(f"substring_index({strip('n')}, ' as ', 1)")

    def of_pattern(pattern: str) -> str:
        items, origin = (group("l", _flags(pattern), i) for i in (1, 2))
        names = f"if(contains(l, '{{') AND contains(l, '}}'), split({items}, ','), array({items}))"
        return case((f"{items} IS NOT NULL", f"transform({names}, n -> {_symbol(name, origin, kind)})"), otherwise=EMPTY)

    lines = f"filter(split({content}, '\\n', -1), l -> contains(lower(l), '@datadog/'))"
    of_line = f"concat({', '.join(of_pattern(p) for p in (NAMED_IMPORT, DEFAULT_IMPORT, NAMESPACE_IMPORT))})"
    return _last_of_each_name(_named(f"flatten(transform({lines}, l -> {of_line}))"))


def unity_types(content: str) -> str:
    """Last part of each imported namespace, plus the types known to come with it."""
    def companions(word: str, types) -> str:
        listed = ", ".join(_symbol(lit(n), "ns", lit(k)) for n, k in types)
        return case((f"contains(ns, '{word}')", f"array({listed})"), otherwise=EMPTY)

    own = _symbol("substring_index(ns, '.', -1)", "ns", "'using'")
    each = f"concat(array({own}), {companions('Rum', USING_RUM)}, {companions('Logs', USING_LOGS)})"
    return _last_of_each_name(f"flatten(transform({groups(content, _flags(USING), 1)}, ns -> {each}))")


# ------------------------------------------------------------------ uses of a symbol

def _quote(name: str) -> str:
    """A name as a literal pattern."""
    end = lit("\\E")
    return f"concat({lit(chr(92) + 'Q')}, replace({name}, {end}, {lit(chr(92) + 'E' + chr(92) * 2 + 'E' + chr(92) + 'Q')}), {end})"


# What stands around a quoted name, finder by finder.
_WEB_FINDERS = ((r"\b", r"\s*\("), (r"\.\s*", r"\s*\("), (r"\b", r"\b(?!\s*:)"))
_UNITY_FINDERS = ((r"\b", r"\.(\w+)"), (r"\b", r"\.(\w+)\s*\("), (r"\b", r"\s+(\w+)"))


def balanced_head(tail: str) -> str:
    """``tail`` up to the parenthesis closing its first one; up to the opening one if
    nothing closes it; null if it has none."""
    quick = f"regexp_extract({tail}, {lit(_CALL_HEAD)}, 0)"
    pieces = groups(tail, r"(?s)[^()]*+[()]", 0)
    step = ("named_struct('depth', if(endswith(piece, '('), acc.depth + 1, greatest(acc.depth - 1, 0)), "
            "'length', acc.length + length(piece), "
            "'opened', if(endswith(piece, '(') AND acc.opened = 0, acc.length + length(piece), acc.opened), "
            "'closed', if(endswith(piece, ')') AND acc.depth = 1 AND acc.closed = 0, acc.length + length(piece), acc.closed))")
    cut = (f"aggregate({pieces}, named_struct('depth', 0, 'length', 0, 'opened', 0, 'closed', 0), "
           f"(acc, piece) -> {step}, acc -> if(acc.closed > 0, acc.closed, acc.opened))")
    return case((f"NOT contains({tail}, '(')", "NULL"), (f"{quick} != ''", quick),
                otherwise=f"substring({tail}, 1, {cut})")


# A use is a struct ``x``: where it starts and ends, its text, the text just before it (``back``)
# and from it on (``ahead``), what follows it (``after``), and its call (``head``). ``at`` holds
# what is the same for all uses of a line. Nothing here reads more of a line than that.

_BEFORE = f"right(x.back, {BEFORE})"
_PREFIX = strip("x.back")


def call_context(line: str) -> str:
    """The call with a little text before it; the whole line if it opens no parenthesis."""
    return case(("x.head IS NULL", "at.whole"), otherwise=strip(f"concat({_BEFORE}, x.head)"))


def type_context(line: str) -> str:
    """Like a call context when a parenthesis is near, else a window around the start."""
    near = f"left(x.ahead, {TYPE_REACH})"
    return strip(f"concat({_BEFORE}, if(contains({near}, '('), x.head, {near}))")


def call_type(line: str) -> str:
    return case((f"endswith({_PREFIX}, '=')", "'assignment'"), ("at.dot BETWEEN 1 AND x.match_start", "'method_call'"),
                (f"contains(left(x.ahead, {CALL_REACH}), '(')", "'function_call'"), otherwise="'reference'")


def legacy_call_type(line: str) -> str:
    return case((f"endswith({_PREFIX}, '.')", "'method_call'"), (f"endswith({_PREFIX}, '=')", "'assignment'"),
                (f"contains(right({_PREFIX}, {BEFORE}), 'new ')", "'constructor'"), otherwise="'function_call'")


def usage_type(line: str) -> str:
    return case((f"contains(left(x.after, {MEMBER_REACH}), '(')", "'method_call'"), ("contains(x.text, '.')", "'property_access'"),
                (f"{_BEFORE} RLIKE 'new |var |public |private '", "'declaration'"),
                (f"endswith({strip(_BEFORE)}, '=')", "'assignment'"), otherwise="'reference'")


def call_parameters(context: str) -> str:
    """What stands between the first and the last parenthesis; null if nothing does."""
    return not_blank(strip(group(context, r"(?s)\((.*)\)")))


@dataclass(frozen=True)
class Style:
    """How one profile finds, describes and labels the uses of its symbols."""

    symbols: Callable[[str], str]
    finders: tuple[tuple[str, str], ...]
    has_member: bool
    context: Callable[[str], str]
    kind: Callable[[str], str]
    record: tuple[str, ...]
    gated: bool
    operation: Callable[[str, str], str]
    category: Callable[[str, str], str]


def _web_style(symbols, kind, gated) -> Style:
    return Style(symbols, _WEB_FINDERS, False, call_context, kind,
                 ("method_name", "package", "call_context", "call_type"), gated,
                 labels.symbol_operation, labels.symbol_category)


STYLES = {
    "web": _web_style(web_symbols, call_type, False),
    "web_split": _web_style(lambda content: web_symbols(content, True), call_type, False),
    "legacy": _web_style(legacy_symbols, legacy_call_type, True),
    "unity": Style(unity_types, _UNITY_FINDERS, True, type_context, usage_type,
                   ("type_name", "member_name", "namespace", "usage_context", "usage_type"), False,
                   labels.type_operation, labels.type_category),
}


def line_test(style: Style, symbols: str) -> str:
    """One pattern per file that a line matches exactly if it uses one of the symbols; null if there are none."""
    names = f"array_join(transform({symbols}, s -> {_quote('s.name')}), '|')"
    if style.has_member:
        test = f"concat({lit(r'(?isU)' + chr(92) + 'b(?:')}, {names}, {lit(widened(r')(?:\.|\s+)\w'))})"
    else:
        parts = (r"(?isU)(?:\b(?:", names), (r")(?:\s*\(|\b(?!\s*:))|\.\s*(?:", names)
        test = "concat(" + ", ".join(f"{lit(widened(a))}, {b}" for a, b in parts) + f", {lit(widened(r')\s*\()'))})"
    return case((f"size({symbols}) > 0", test))


# Pieces of a line are its matches and the gaps between them. Matches are not empty, so this many
# pieces hold all the text a use is judged by; each piece is cut to that length first.
REACH = TYPE_REACH + BEFORE
_FEW, _MANY = 2 * BEFORE + 2, 2 * REACH


def _running(lengths: str) -> str:
    """Sums of the first 1, 2, ... of an array of numbers, in two levels: linear time but for a block's square."""
    block = 128
    inner = "aggregate(part, array(0), (acc, n) -> array_append(acc, element_at(acc, -1) + n))"
    parts = f"transform(sequence(0, greatest(size(ls) - 1, 0) div {block}), b -> slice(ls, b * {block} + 1, {block}))"
    sums = f"transform({parts}, part -> slice({inner}, 2, {block}))"
    starts = "aggregate(blocks, array(0), (acc, block) -> array_append(acc, element_at(acc, -1) + coalesce(element_at(block, -1), 0)))"
    shifted = f"transform(array({starts}), firsts -> flatten(transform(blocks, (block, b) -> transform(block, n -> n + firsts[b]))))[0]"
    return f"transform(array({lengths}), ls -> transform(array({sums}), blocks -> {shifted})[0])[0]"


def _matches(line: str, name: str, finder_ord: int, finder: tuple[str, str], has_member: bool) -> str:
    """Non-overlapping matches of a finder with their offsets and surroundings, left to right.

    Splitting at a finder gives the text between its matches; what stands around a match is
    put together from the pieces next to it. A look-ahead in the pattern takes a match's call
    along, so that no text is searched once per match.
    """
    before, after = finder
    head = _CALL_HEAD.removeprefix("(?s)^")
    pattern = f"concat({lit(f'(?isU)(?=({head}|))' + widened(before))}, {_quote(name)}, {lit(widened(after))})"
    found = f"regexp_extract_all({line}, {pattern}, 0)"
    members = f"regexp_extract_all({line}, {pattern}, 2)" if has_member else "x.texts"
    heads = f"regexp_extract_all({line}, {pattern}, 1)"
    # gap 0, match 0, gap 1, ...: match i is piece 2 i + 2, counted from 1
    pieces = "flatten(zip_with(x.gaps, x.texts, (gap, text) -> array(gap, coalesce(text, ''))))"

    def joined(first: str, count: int, cut: int) -> str:
        return f"left(array_join(transform(slice(x.pieces, {first}, {count}), p -> left(p, {cut})), ''), {cut})"

    ahead = f"if(length(text) >= {REACH}, left(text, {REACH}), {joined('2 * i + 2', _MANY, REACH)})"
    back = f"array_join(slice(x.pieces, greatest(2 * i + 1 - {_FEW}, 1), least(2 * i + 1, {_FEW} + 1)), '')"
    after_text = joined("2 * i + 3", _FEW, MEMBER_REACH) if has_member else "''"
    ends = _running("zip_with(x.texts, slice(x.gaps, 1, size(x.texts)), (t, g) -> length(t) + length(g))")
    one = (f"named_struct('finder_ord', {finder_ord}, 'match_start', x.ends[i] - length(text), 'match_end', x.ends[i], 'text', text, "
           f"'member', x.members[i], 'call', x.heads[i], 'back', {back}, 'ahead', {ahead}, 'after', {after_text})")
    # most finders find nothing on a line: only those that do are split and placed
    parts = (f"transform(filter(array({found}), f -> size(f) > 0), "
             f"f -> named_struct('texts', f, 'gaps', split({line}, {pattern}, -1), 'heads', {heads}))")
    parts = f"transform({parts}, x -> named_struct('texts', x.texts, 'heads', x.heads, 'members', {members}, 'ends', {ends}, 'pieces', {pieces}))"
    return f"flatten(transform({parts}, x -> transform(x.texts, (text, i) -> {one})))"


USE_FIELDS = ("symbol_ord", "finder_ord", "match_start", "match_end", "name", "origin", "member", "context",
              "kind", "parameters", "repr_length")


def usages(style: Style, line: str, low: str, symbols: str) -> str:
    """All uses of the symbols on a line, in order of symbol, finder and position.

    Built in steps, each an array of structs over the one before, so that no value is
    computed twice: match, its call, context and kind, arguments, length. The time of a line
    grows with its length and its uses, but where a call nests deeper than the pattern goes.
    """
    per_finder = ", ".join(_matches(line, "s.name", n, f, style.has_member) for n, f in enumerate(style.finders))
    around = ["call", "back", "ahead", "after"]
    fields = ["symbol_ord", "finder_ord", "match_start", "match_end", "name", "origin", "member", "text", *around]

    def keep(more: dict, source: list[str]) -> str:
        kept = [f"'{f}', x.{f}" for f in source]
        return "named_struct(" + ", ".join(kept + [f"'{k}', {v}" for k, v in more.items()]) + ")"

    match = ", ".join(f"'{f}', " + {"symbol_ord": "i", "name": "s.name", "origin": "s.origin"}.get(f, f"m.{f}")
                      for f in fields)
    seen = f"if(contains({low}, {folded('s.name')}), concat({per_finder}), NULL)"
    numbered = f"transform({symbols}, (s, i) -> transform({seen}, m -> named_struct({match})))"
    out = f"flatten(filter({numbered}, found -> found IS NOT NULL))"
    # the call, unless it nests deeper than the pattern follows or nothing closes it
    head = case(("at.last <= x.match_start", "NULL"), ("x.call != ''", "x.call"),
                otherwise=f"transform(array(substring({line}, x.match_start + 1)), tail -> {balanced_head('tail')})[0]")
    steps = [{"head": head}, {"context": style.context(line), "kind": style.kind(line)}]
    for more in steps:
        out = f"transform({out}, x -> {keep(more, fields)})"
        fields = fields + list(more)
    # of the line: its first full stop, its last opening parenthesis, and itself without outer blanks
    whole = (f"named_struct('dot', instr({line}, '.'), 'last', if(contains({line}, '('), length({line}) - instr(reverse({line}), '(') + 1, 0), "
             f"'whole', {strip(line)})")
    out = f"transform(array({whole}), at -> {out})[0]"
    fields = [f for f in fields if f not in ("text", "head", *around)]
    arguments = call_parameters("x.context")
    if style.gated:
        arguments = case(("x.kind IN ('function_call', 'method_call')", arguments))
    out = f"transform({out}, x -> {keep({'parameters': arguments}, fields)})"
    return f"transform({out}, x -> {keep({'repr_length': _usage_length(style, 'x')}, fields + ['parameters'])})"


def _usage_entries(style: Style, use: str) -> list[tuple[str, str]]:
    names = ("name", "member", "origin", "context", "kind") if style.has_member else ("name", "origin", "context", "kind")
    return [(key, f"{use}.{field}") for key, field in zip(style.record, names)]


def _usage_length(style: Style, use: str) -> str:
    parts = [f"{len(key) + 6} + {quoted_length(value)}" for key, value in _usage_entries(style, use)]
    extra = case((f"{use}.parameters IS NOT NULL",
                  f"{len('parameters') + 6} + {quoted_length(use + '.parameters')}"), otherwise="0")
    return " + ".join(parts + [extra])


def best_usage(found: str) -> str:
    """The use described at most length; the earliest of equals; null for none."""
    return (f"transform(array({found}), found -> reduce(found, get(found, 0), "
            "(best, u) -> if(u.repr_length > best.repr_length, u, best)))[0]")


def usage_record(style: Style, use: str) -> str:
    """What a use sends, as a map."""
    pairs = ", ".join(f"{lit(key)}, {value}" for key, value in _usage_entries(style, use))
    return case((f"{use}.parameters IS NOT NULL", f"map({pairs}, 'parameters', {use}.parameters)"),
                otherwise=f"map({pairs})")


def usage_operation(style: Style, use: str) -> str:
    return style.operation(f"{use}.name", f"{use}.member" if style.has_member else f"{use}.origin")


def usage_category(style: Style, use: str) -> str:
    return style.category(f"{use}.name", f"{use}.member" if style.has_member else f"{use}.origin")
