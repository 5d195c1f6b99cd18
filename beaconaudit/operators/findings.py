"""From files to findings: one row per line that sends telemetry.

The whole step is a map over files. A file's lines are an array inside its row; they are
filtered there, what is left is described there step by step, and only findings become
rows. Nothing is shuffled, no group is collected, and no array is copied per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from beaconaudit.functions import hints, labels
from beaconaudit.functions.fields import detailed_parameters
from beaconaudit.functions.text import case, folded, has_any, lit, matches, record_length, strip
from beaconaudit.operators import symbols as sym
from beaconaudit.operators.lines import CONTEXT, line_array
from beaconaudit.rules import LIVE, Language, Rulebook, ci
from beaconaudit.sources.corpus import route

#: So many families that read a line alike are looked up in an index instead of tried in turn; findings are the same.
INDEXED = 200
#: So many families with hints fit the bits of one number.
BITS = 60
SCORE = "struct<length:int,early:int>"
EXTRACTED = "struct<kv:map<string,string>,string_literals:array<string>>"


def _is(language: Language) -> str:
    return f"language = {lit(language.name)}"


def _per_language(rulebook: Rulebook, make) -> str:
    """``make(language)`` where a file has that language; null where it gives None."""
    branches = [(_is(lang), made) for lang in rulebook.languages if (made := make(lang)) is not None]
    return case(*branches) if branches else "NULL"


def _style(language: Language) -> sym.Style | None:
    return sym.STYLES[language.symbols] if language.symbols else None


def with_symbols(files: DataFrame, rulebook: Rulebook = LIVE) -> DataFrame:
    """Adds each file's imported symbols."""
    found = _per_language(rulebook, lambda lang: _style(lang) and _style(lang).symbols("content"))
    return files.withColumn("symbols", F.expr(f"cast({found} AS {sym.SYMBOLS})"))


def prepare(files: DataFrame, rulebook: Rulebook = LIVE, symbols: bool = True) -> DataFrame:
    """Routes files and adds what their lines are looked at with; ``symbols`` where uses of imported names count."""
    low = F.expr(folded("content"))  # a letter stays a letter, so lines are as many and as they are by themselves
    if not symbols:
        return route(files, rulebook).withColumns({"lines": line_array(F.col("content")), "low_lines": line_array(low)})
    test = _per_language(rulebook, lambda lang: _style(lang) and sym.line_test(_style(lang), "symbols"))
    return with_symbols(route(files, rulebook), rulebook).withColumns({
        "lines": line_array(F.col("content")),
        "low_lines": line_array(low),
        "symbol_test": F.expr(f"cast({test} AS string)"),
        "symbol_hints": F.expr(f"transform(symbols, s -> {folded('s.name')})"),
    })


def _bits(language: Language) -> dict[str, int]:
    """The bit of ``row.seen`` that says whether a hint of a family stands in a line, by the family's hints; empty where there are too many."""
    hinted = dict.fromkeys(f.hints for f in language.families if f.hints)
    return {hints: 1 << i for i, hints in enumerate(hinted)} if len(hinted) <= BITS else {}


def _hinted(language: Language, family) -> str:
    """True if one of the family's hints stands in the line: a bit, where lines have been looked at for all hints."""
    if not family.hints:
        return "true"
    bit = _bits(language).get(family.hints)
    return has_any("row.low", family.hints) if bit is None else f"(row.seen & {bit}L) != 0"


def _hit(language: Language, family) -> str:
    """True if the family hits; its patterns are tried only where one of its hints stands."""
    exact = matches("row.line", family.regex)
    return f"({_hinted(language, family)} AND {exact})" if family.hints else exact


def _struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in values.items()) + ")"


class Lines:
    """The lines of one language's files: an expression for an array of structs, built in steps.

    ``add`` computes new fields from those there are; in expressions a line is ``row``
    and the file's own columns go by their names. Steps keep a value from being computed
    twice: what one step computes, later ones read.
    """

    def __init__(self, language: Language, array: str, fields: tuple[str, ...]):
        self.language, self.array, self.fields = language, array, fields

    def add(self, drop: tuple[str, ...] = (), **more: str) -> "Lines":
        kept = {f: f"row.{f}" for f in self.fields if f not in more and f not in drop}
        made = {**kept, **more}
        return Lines(self.language, f"transform({self.array}, row -> {_struct(made)})", tuple(made))

    def where(self, test: str) -> "Lines":
        return Lines(self.language, f"filter({self.array}, row -> {test})", self.fields)

    def only(self, **values: str) -> str:
        """The array with just these fields."""
        return f"transform({self.array}, row -> {_struct(values)})"

    def each(self, items: str, with_line: bool = True, **values: str) -> str:
        """One struct per element of the line's own array ``items``, an element being ``item``."""
        place = {f: f"row.{f}" for f in ("line_number", "line")[:1 + with_line]}
        return f"flatten(transform({self.array}, row -> transform({items}, item -> {_struct({**place, **values})})))"


def _explode(files: DataFrame, rulebook: Rulebook, array_of, symbols: bool = True) -> DataFrame:
    """One row per element of ``array_of(language)``, next to the file's own columns."""
    carried = [c for c in files.columns if c not in ("content", "language")] + ["language"]
    return prepare(files, rulebook, symbols).selectExpr(*carried, f"inline({_per_language(rulebook, array_of)})")


def _kinds(language: Language) -> list:
    """Families that read a line the same way, by their field builder."""
    kinds: dict = {}
    for position, family in enumerate(language.families):
        kinds.setdefault(family.fields, []).append((position, family))
    return list(kinds.items())


def _is_indexed(members) -> bool:
    return sum(hints.fits(f.hints, f.regex) for _, f in members) >= INDEXED


def _first(language: Language, members) -> str:
    """The position of the first of ``(position, family)`` that hits a line; null if none does.

    Few families are tried one after the other, many are looked up by what stands in the line.
    """
    if not _is_indexed(members):
        return case(*[(_hit(language, family), str(n)) for n, family in members])
    indexed = [(n, f) for n, f in members if hints.fits(f.hints, f.regex)]
    found = hints.first_hit([(n, f.hints, f.regex) for n, f in indexed], "row.line", "row.low")
    others = [(_hit(language, f), str(n)) for n, f in members if not hints.fits(f.hints, f.regex)]
    return f"least({found}, {case(*others)})" if others else found


def candidates(language: Language, symbols: bool = True, firsts: bool = True) -> Lines:
    """Exactly the lines that have a finding; most text is turned away by substring tests.
    Without ``symbols`` those that a rule hits.

    Hints are looked for once per line: ``seen`` has a bit per family. Per way of reading a line, ``first_*`` is the
    first family that hits: families that read a line alike describe it alike, so no later one can win. Without ``firsts``
    a line's families are tried up to the first that hits, whatever its way of reading.
    """
    bits = _bits(language)
    numbered = {"line_number": "i + 1", "line": "get(lines, i)", "low": "low"}
    if bits:
        numbered["seen"] = " | ".join(f"if({has_any('low', words)}, {bit}L, 0L)" for words, bit in bits.items())
    lines = Lines(language, f"transform(low_lines, (low, i) -> {_struct(numbered)})", tuple(numbered))
    words = dict.fromkeys(h for family in language.families for h in family.hints)
    hinted = "true"
    if all(f.hints for f in language.families):
        hinted = "row.seen != 0" if bits else has_any("row.low", words) if len(words) < INDEXED else "true"
    named = "exists(symbol_hints, h -> contains(row.low, h))"
    used = f"symbol_test IS NOT NULL AND {named} AND regexp_extract(row.line, symbol_test, 0) != ''"
    # most lines hold no hint at all: they go before any family is tried
    symbols = symbols and bool(language.symbols)
    lines = lines.where(f"{hinted} OR {named}" if symbols else hinted)
    if firsts:
        made = {f"first_{j}": _first(language, members) for j, (_, members) in enumerate(_kinds(language))}
        lines = lines.add(drop=() if symbols or not bits else ("low",), **made)
        hit = f"coalesce({', '.join(f'row.{f}' for f in made)}) IS NOT NULL"
    else:
        hit = " OR ".join(f"({_first(language, members)}) IS NOT NULL" if _is_indexed(members) else _hit(language, f)
                          for _, members in _kinds(language) for _, f in (members[:1] if _is_indexed(members) else members))
    return lines.where(f"({hit}) OR ({used})" if symbols else hit)


def _read(language: Language, symbols: bool = True) -> tuple[Lines, list]:
    """Candidates with the values read from them, each read once, and the ways of reading:
    ``(first field, members, entries)`` with entries ``(key, value, present)``."""
    cells, ways = {}, []
    for j, (builder, members) in enumerate(_kinds(language)):
        read, entries = {}, []
        for key, value, present in builder("row.line"):
            at = f"row.cells_{j}.{key}"
            read[key] = value
            if present is not None:
                read["has_" + key] = present
            entries.append((key, at, f"{at} IS NOT NULL" if present is None else f"row.cells_{j}.has_{key}"))
        if read:
            cells[f"cells_{j}"] = case((f"row.first_{j} IS NOT NULL", _struct(read)))
        ways.append((f"row.first_{j}", members, entries))
    lines = candidates(language, symbols)
    return (lines.add(**cells) if cells else lines), ways


def _record(entries) -> str:
    empty = "cast(map() AS map<string,string>)"
    parts = [case((present, f"map({lit(key)}, {value})"), otherwise=empty) for key, value, present in entries]
    return f"map_concat({', '.join(parts)})" if len(parts) > 1 else (parts or [empty])[0]


def described(language: Language, wanted: tuple[str, ...] | None = None) -> Lines:
    """Candidates with ``family_ord``, ``record`` and ``repr_length`` of each line's best rule,
    null where no rule hits, and ``use``, the best use of a symbol on such lines.

    Longest record wins; of equals, the earliest family: a pair that is compared as one. Of columns that are not
    ``wanted`` nothing is made: where neither rule nor use counts, candidates are all there is to say, and where the length
    itself does not, records are measured only on lines that are read in several ways.
    """
    def want(*names: str) -> bool:
        return wanted is None or any(n in wanted for n in names)

    if not want("operation_type", "data_being_sent", "data_category", "family", "repr_length"):
        return candidates(language, firsts=False)
    lines, ways = _read(language)

    def length(entries) -> str:
        told = f"cast({record_length(entries)} AS int)"
        return told if want("repr_length") else "0" if len(ways) == 1 else case(("row.ways > 1", told), otherwise="0")

    if len(ways) > 1 and not want("repr_length"):
        lines = lines.add(ways=" + ".join(f"if({first} IS NULL, 0, 1)" for first, _, _ in ways))
    scores = [case((f"{first} IS NOT NULL", f"named_struct('length', {length(entries)}, 'early', -{first})"))
              for first, _, entries in ways]
    lines = lines.add(score=f"greatest(cast(NULL AS {SCORE}), {', '.join(f'cast({s} AS {SCORE})' for s in scores)})")
    family_ord = "-row.score.early"
    record = case(*[(f"{family_ord} = {first}", _record(entries)) for first, _, entries in ways])
    style = _style(language)
    more = {"record": record} if want("data_being_sent", "data_category") else {}
    if style and want("operation_type", "data_being_sent", "data_category", "repr_length"):
        more["use"] = case(("row.score IS NULL", sym.best_usage(_uses(style))))
    spent = tuple(f for f in lines.fields if f not in ("line_number", "line"))
    return lines.add(drop=spent, family_ord=family_ord, repr_length="row.score.length", **more)


def _name_of(language: Language, attribute: str, position: str) -> str:
    return "get(array(%s), %s)" % (", ".join(lit(getattr(f, attribute)) for f in language.families), position)


# ------------------------------------------------------------------ direct hits

def rule_hits(files: DataFrame, rulebook: Rulebook = LIVE) -> DataFrame:
    """Every (line, pattern) hit, in rule order: the input of the best-per-line choice."""
    def array_of(language: Language) -> str:
        # patterns of a family are tried where one of its hints stands
        hits = []
        for i, family in enumerate(language.families):
            own = ", ".join(case((matches("row.line", ci(p)), _struct({"family_ord": str(i), "pattern_ord": str(j)})))
                            for j, p in enumerate(family.patterns))
            hits.append(case((_hinted(language, family), f"array({own})"), otherwise="array()"))
        return candidates(language, symbols=False).each(
            f"filter(flatten(array({', '.join(hits)})), hit -> hit IS NOT NULL)",
            family=_name_of(language, "name", "item.family_ord"),
            operation_type=_name_of(language, "operation", "item.family_ord"),
            family_ord="item.family_ord", pattern_ord="item.pattern_ord")

    return _explode(files, rulebook, array_of, symbols=False)


def rule_findings(files: DataFrame, rulebook: Rulebook = LIVE) -> DataFrame:
    """What every family that hits a line makes of it, before the best is chosen."""
    def array_of(language: Language) -> str:
        lines, ways = _read(language, symbols=False)
        # described once per way of reading; the families that hit share it
        told = {f"told_{j}": case((f"{first} IS NOT NULL", _struct(
            {"record": _record(entries), "repr_length": record_length(entries)})))
            for j, (first, _, entries) in enumerate(ways)}
        hits = [case((f"{first} IS NOT NULL AND {_hit(language, family)}",
                      _struct({"family": lit(family.name), "family_ord": str(position), "told": f"row.told_{j}"})))
                for j, (first, members, _) in enumerate(ways) for position, family in members]
        return lines.add(**told).each(
            f"filter(array({', '.join(hits)}), hit -> hit IS NOT NULL)",
            family="item.family", operation_type=_name_of(language, "operation", "item.family_ord"),
            family_ord="item.family_ord", pattern_ord="0", record="item.told.record", repr_length="item.told.repr_length",
            data_category=labels.rule_category(language.families, "item.family", "item.told.record"))

    return _explode(files, rulebook, array_of, symbols=False)


# ------------------------------------------------------------------ uses of symbols

def _uses(style: sym.Style) -> str:
    return sym.usages(style, "row.line", "row.low", "symbols")


def symbol_usages(files: DataFrame, rulebook: Rulebook = LIVE) -> DataFrame:
    """Every use of an imported symbol, on lines without a direct hit."""
    def array_of(language: Language) -> str | None:
        if not language.symbols:
            return None
        lines = candidates(language)
        firsts = ", ".join(f"row.{f}" for f in lines.fields if f.startswith("first_"))
        return lines.where(f"coalesce({firsts}) IS NULL").each(
            _uses(_style(language)), with_line=False, **{f: f"item.{f}" for f in sym.USE_FIELDS})

    return _explode(files, rulebook, array_of)


# ------------------------------------------------------------------ findings

def detect(files: DataFrame, rulebook: Rulebook = LIVE, context: int = CONTEXT,
           wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Findings of ``files(path, content, ...)``; other columns are carried along.

    At most one finding per (file, line). Works the same on a stream of files. ``wanted``
    names the columns of a finding to build; what is not wanted is not computed.
    """
    first, last = f"greatest(row.line_number - {context}, 1)", f"least(row.line_number + {context}, size(lines))"
    def array_of(language: Language) -> str:
        style = _style(language)
        extracted = detailed_parameters("row.line") if rulebook.detailed and language.details else "NULL"

        def either(by_rule: str, by_use) -> str:
            return case(("row.family_ord IS NOT NULL", by_rule), otherwise=by_use(style, "row.use")) if style else by_rule

        family = _name_of(language, "name", "row.family_ord")
        category = labels.rule_category(language.families, family, "row.record")
        fields = dict(
            line_number="row.line_number", code_snippet=strip("row.line"),
            operation_type=either(_name_of(language, "operation", "row.family_ord"), sym.usage_operation),
            data_being_sent=either("row.record", sym.usage_record),
            data_category=either(category, sym.usage_category),
            context_lines=f"slice(lines, {first}, {last} - {first} + 1)", family=family,
            repr_length="coalesce(row.repr_length, row.use.repr_length)" if style else "row.repr_length",
            extracted_parameters=f"cast({extracted} AS {EXTRACTED})")
        return described(language, wanted).only(**{k: v for k, v in fields.items() if wanted is None or k in wanted})

    return _explode(files, rulebook, array_of)


def best_per_line(hits: DataFrame, keys, length: str = "repr_length", order=("family_ord", "pattern_ord")) -> DataFrame:
    """The same choice over a table of hits: longest record per line, earliest of equals."""
    keys = list(keys)
    rest = [c for c in hits.columns if c not in keys]
    rank = F.struct(F.col(length), *[-F.col(c) for c in order])
    best = F.max_by(F.struct(*rest), rank).alias("best")
    return hits.groupBy(*keys).agg(best).select(*keys, "best.*")
