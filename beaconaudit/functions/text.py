"""Text helpers as SQL expressions.

Descriptions of a line are large expressions, so they are written as SQL text and handed
to Spark in one piece: each function takes and returns the text of an expression.
Arguments that are used more than once should be names, not computations.
"""

from __future__ import annotations

# The characters a Unicode-aware strip removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Letters equal to s, k and i when case is ignored, beyond lower-casing.
FOLDED_LETTERS = ("\u017f\u212a\u0130\u0131", "skii")

# Characters written as \xNN, \uNNNN or \UNNNNNNNN when text is quoted.
_HIDDEN = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ \t\n\r]]"
_HIDDEN_SHORT = r"[\x00-\x1f\x7f-\xa0\xad&&[^\t\n\r]]"
_HIDDEN_ASTRAL = r"[\x{10000}-\x{10FFFF}&&[\p{Cf}\p{Co}\p{Cn}]]"
# Any character that may change the length when quoted. Those below 256 are listed one
# by one, which makes them a single table lookup per character.
_SPECIAL = "[" + "".join(f"\\x{c:02x}" for c in (*range(0x20), 0x27, 0x5C, *range(0x7F, 0xA1), 0xAD)) + r"\x{250}-\x{10FFFF}]"


def widened(pattern: str) -> str:
    """A pattern whose ``\\s`` also takes U+001C to U+001F, which Java's class leaves out and a strip removes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i:i + 2]
            out.append(pair if pair != r"\s" else r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]")
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


def lit(value: str) -> str:
    """A string literal, whatever its characters."""
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = value.replace(plain, escaped)
    return f"'{value}'"


def case(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    """The value of the first test that holds. A test or two need no list of branches, which is slow to walk for every value."""
    if len(branches) <= 4:
        for test, value in reversed(branches):
            otherwise = f"if({test}, {value}, {otherwise})"
        return otherwise
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + f" ELSE {otherwise} END"


def matches(text: str, pattern: str) -> str:
    return f"{text} RLIKE {lit(pattern)}"


def strip(text: str) -> str:
    return f"btrim({text}, {lit(BLANKS)})"


def not_blank(text: str) -> str:
    """Null for ''."""
    return f"CASE WHEN {text} != '' THEN {text} END"


def group(text: str, pattern: str, index: int = 1) -> str:
    """A group of the first match; null when there is no match, '' when it matched nothing."""
    return f"get(regexp_extract_all({text}, {lit(pattern)}, {index}), 0)"


def groups(text: str, pattern: str, index: int = 1) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {index})"


def has_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def folded(text: str) -> str:
    """Lower case, with the letters that only ignoring case equates brought to their base letter."""
    base = f"translate({text}, {lit(FOLDED_LETTERS[0])}, {lit(FOLDED_LETTERS[1])})"
    return f"lower(if(octet_length({text}) = length({text}), {text}, {base}))"


def quoted_length(text: str) -> str:
    """Length of the text as a quoted literal: quotes added, backslashes, control and
    unprintable characters escaped; single quotes escaped only if both kinds occur."""
    doubled = "length(regexp_replace(%s, %s, 'xx'))" % (text, lit(r"[\\\t\n\r]"))
    quotes = case((f"contains({text}, {lit(chr(39))}) AND contains({text}, '\"')",
                   f"length({text}) - length(replace({text}, {lit(chr(39))}))"), otherwise="0")

    def count(pattern: str) -> str:
        return f"size({groups(text, pattern, 0)})"

    hidden = case((matches(text, _HIDDEN),
                   f"{count(_HIDDEN)} * 5 - {count(_HIDDEN_SHORT)} * 2 + {count(_HIDDEN_ASTRAL)} * 4"), otherwise="0")
    return f"(2 + if({matches(text, _SPECIAL)}, {doubled} + {quotes} + {hidden}, length({text})))"


def record_length(entries) -> str:
    """Length of ``{'key': 'value', ...}`` for ``(key, value, present)`` entries."""
    if not entries:
        return "2"
    parts = [case((present, f"{len(key) + 6} + coalesce({quoted_length(value)}, 4)"), otherwise="0")
             for key, value, present in entries]
    return f"greatest(2, {' + '.join(parts)})"
