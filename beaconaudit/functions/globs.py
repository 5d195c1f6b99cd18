"""File globs: few as one regular expression, many as sets of names next to it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


def _translate(glob: str, any_char: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(any_char + "*")
        elif c == "?":
            out.append(any_char)
        elif close > 0:
            body = glob[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^")) + "]")
            i = close
        else:
            out.append(re.sub(r"([^\w\s/-])", r"\\\1", c))
        i += 1
    return "".join(out)


def ignore_pattern(globs) -> str | None:
    """Matches relative paths that a glob covers as a whole (``*`` crosses ``/``), or
    one of whose components matches the glob without its trailing ``/`` and ``*``."""
    globs = sorted(set(globs))
    whole = [_translate(g, ".") for g in globs]
    parts = [_translate(p, "[^/]") for p in (g.rstrip("/*") for g in globs) if p and "/" not in p]
    tests = []
    if whole:
        tests.append(r"\A(?:" + "|".join(whole) + r")\z")
    if parts:
        tests.append(r"(?:\A|/)(?:" + "|".join(parts) + r")(?:/|\z)")
    return "(?s)" + "|".join(tests) if tests else None


#: From so many globs on, those that are plain texts are looked up in sets; fewer make one pattern.
MANY = 64


@dataclass(frozen=True)
class GlobSets:
    """Globs by what they ask of a relative path.

    ``components``: names of any of its components; ``suffixes``: ends of any component; ``paths``: the whole path;
    ``prefixes``: directories it lies below, with their slash; ``patterns``: globs that are none of these.
    """

    components: tuple[str, ...]
    suffixes: tuple[str, ...]
    paths: tuple[str, ...]
    prefixes: tuple[str, ...]
    patterns: tuple[str, ...]


def glob_sets(globs) -> GlobSets:
    """Every glob in the sets that together ask what ``ignore_pattern`` asks of it."""
    found: dict[str, set[str]] = {f: set() for f in GlobSets.__dataclass_fields__}

    def plain(text: str) -> bool:
        return not any(c in text for c in "*?[")

    for glob in set(globs):
        name = glob.rstrip("/*")
        head, tail = glob.rstrip("*"), glob[1:]
        if plain(glob):
            found["paths"].add(glob)
            if name and "/" not in name:
                found["components"].add(name)
        elif plain(head) and head.endswith("/") and name:
            if "/" not in name:
                found["components"].add(name)
            if "/" in name or head != name + "/":  # else what lies below it has it as a component
                found["prefixes"].add(head)
        elif glob.startswith("*") and tail and plain(tail) and "/" not in tail:
            found["suffixes"].add(tail)
        else:
            found["patterns"].add(glob)
    return GlobSets(**{k: tuple(sorted(v)) for k, v in found.items()})


def ignored(rel: Column, globs) -> Column | None:
    """True for relative paths that one of the globs covers; None without globs. The time of a path does not grow with plain globs."""
    globs = sorted(set(globs))
    if len(globs) < MANY:
        pattern = ignore_pattern(globs)
        return None if pattern is None else rel.rlike(pattern)
    sets = glob_sets(globs)
    components = F.split(rel, "/")
    tests = []
    if sets.components:
        tests.append(F.exists(components, lambda c: c.isin(*sets.components)))
    if sets.suffixes:
        # a component shorter than the end that is taken is taken whole: then it is a suffix itself
        lengths = F.array(*(F.lit(n) for n in sorted({len(s) for s in sets.suffixes})))
        tests.append(F.exists(components, lambda c: F.exists(lengths, lambda n: F.right(c, n).isin(*sets.suffixes))))
    if sets.paths:
        tests.append(rel.isin(*sets.paths))
    if sets.prefixes:
        directories = F.slice(components, F.lit(1), F.size(components) - 1)
        above = F.transform(directories, lambda _, i: F.concat(F.array_join(F.slice(components, F.lit(1), i + 1), "/"), F.lit("/")))
        tests.append(F.exists(above, lambda p: p.isin(*sets.prefixes)))
    pattern = ignore_pattern(sets.patterns)
    if pattern is not None:
        tests.append(rel.rlike(pattern))
    return reduce(lambda a, b: a | b, tests)
