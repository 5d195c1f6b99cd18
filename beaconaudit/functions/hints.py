"""Which of very many families may hit a line, looked up by what stands in the line.

Trying every family's hints on every line takes time in proportion to the families. Here each
hint is filed under one of its grams, the one that the fewest hints have in common: up to ``GRAM`` characters in
a row. The index is an array of buckets by the gram's hash, a literal of the plan. A line's own grams are hashed
and name the buckets to look into; only families found there are tried, with their hints and their pattern. So the
time of a line grows with its length and with the families it really is about.
"""

from __future__ import annotations

import zlib
from collections import Counter

from beaconaudit.functions.text import lit

#: Longest gram; shorter hints are filed whole.
GRAM = 4
#: Separators inside the literals; neither stands in a line, a hint or a pattern of source code.
_FIELD, _ITEM = "\x1e", "\x1f"


def grams_of(hint: str) -> list[str]:
    size = min(len(hint), GRAM)
    return [hint[i:i + size] for i in range(len(hint) - size + 1)]


def filed_under(hints: list[str]) -> dict[str, str]:
    """The gram each hint is filed under: of its own the rarest among all hints, the first of equals."""
    common = Counter(g for h in hints for g in dict.fromkeys(grams_of(h)))
    return {h: min(grams_of(h), key=lambda g: common[g]) for h in hints}


def buckets(families: list[tuple[int, tuple[str, ...]]]) -> tuple[list[list[int]], list[int]]:
    """Positions in ``families`` by hash of the grams of their hints, and the lengths of the grams."""
    gram = filed_under(sorted({h for _, hints in families for h in hints}))
    size = 1 << max(6, (2 * len(set(gram.values()))).bit_length())
    table: list[set[int]] = [set() for _ in range(size)]
    for place, (_, hints) in enumerate(families):
        for h in hints:
            table[zlib.crc32(gram[h].encode()) % size].add(place)
    return [sorted(some) for some in table], sorted({len(g) for g in gram.values()})


def _array(values: list[str]) -> str:
    """An array literal, written as one text, which is parsed and folded once whatever its length."""
    return f"split({lit(_FIELD.join(values))}, {lit(_FIELD)}, -1)"


def candidates(families: list[tuple[int, tuple[str, ...]]], low: str) -> str:
    """Places in ``families``, ascending, of those of whose hints a gram stands in the lower-case text."""
    table, sizes = buckets(families)
    filled = _array([_ITEM.join(map(str, some)) for some in table])
    grams = [f"regexp_extract_all({low}, {lit(f'(?s)(?=({chr(46) * n}))')}, 1)" for n in sizes]
    every = f"concat({', '.join(grams)})" if len(grams) > 1 else grams[0]
    slots = f"array_distinct(transform({every}, g -> cast(crc32(g) % {len(table)} AS int)))"
    named = f"transform({slots}, s -> get({filled}, s))"
    places = f"flatten(transform(filter({named}, b -> b != ''), b -> cast(split(b, {lit(_ITEM)}, -1) AS array<int>)))"
    return f"sort_array(array_distinct({places}))"


def first_hit(families: list[tuple[int, tuple[str, ...], str]], line: str, low: str) -> str:
    """The number of the first of ``(number, hints, regex)``, in order of numbers, that hits the line; null if none does.
    Families after it are not tried."""
    numbers = _array([str(n) for n, _, _ in families])
    hints = _array([_ITEM.join(h) for _, h, _ in families])
    patterns = _array([p for _, _, p in families])
    hit = (f"exists(split(get({hints}, i), {lit(_ITEM)}, -1), h -> contains({low}, h)) AND {line} RLIKE get({patterns}, i)")
    first = f"aggregate({candidates([(n, h) for n, h, _ in families], low)}, cast(NULL AS int), (found, i) -> coalesce(found, if({hit}, i, NULL)))"
    return f"cast(get({numbers}, {first}) AS int)"


def fits(hints: tuple[str, ...], regex: str) -> bool:
    """Whether a family can be in an index: it has hints, and nothing in it is a separator."""
    return bool(hints) and all(hints) and not any(c in text for text in (*hints, regex) for c in (_FIELD, _ITEM))
