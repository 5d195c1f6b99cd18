"""Which charset a file's bytes are in, and their text.

Valid UTF-8 is UTF-8. A byte-order mark names UTF-16 and UTF-32. What is left is scored per candidate
charset over all of its bytes, read as one character each, so that regular expressions see bytes:

* double-byte charsets: bytes that are in no valid sequence count against it, valid ones being taken in one after
  the other, which also keeps lead and trail bytes apart; counted are characters of the rows common
  text is written with, and the most frequent characters on top;
* alphabets of their own: letters that are frequent in their languages, and pairs of two such letters;
* Latin charsets: accented letters, by how usual they are in the charset's languages, that stand beside a plain
  letter or alone.

Scores are of high bytes and what stands beside them, so they are counted over the places of the high bytes of many files at
a time, as arrays in the tasks (``_counted``): patterns of all candidates over every byte took a hundred times as long.
The best score wins, the earlier candidate among equals; text that looks like none is read as
windows-1252, whose five undefined bytes stay control characters, so that every byte means something.
The rest is SQL functions, and only files that are neither UTF-8 nor marked are scored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

UTF8, FALLBACK = "UTF-8", "windows-1252"
#: Byte-order marks, longer ones first, as hexadecimal digits.
MARKS = (("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))

#: Double-byte charsets: (name, codec here, single bytes, lead and trail bytes, common rows, frequent characters).
DOUBLE_BYTE = (
    ("windows-31j", "cp932", r"\xa1-\xdf", r"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]",
     r"\x81[\x40-\xac]|\x82[\x4f-\xf1]|\x83[\x40-\x96]|[\x88-\x97][\x40-\x7e\x80-\xfc]",
     "のにはをたがでてとしれさいるなかもらこうすりく、。ーンスルトリアイックラ日本人年大"),
    ("EUC-JP", "euc_jp", r"\x8e", r"\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}|[\xa1-\xfe]{2}",
     r"\xa1[\xa1-\xfe]|[\xa4\xa5][\xa1-\xf6]|[\xb0-\xcf][\xa1-\xfe]",
     "のにはをたがでてとしれさいるなかもらこうすりく、。ーンスルトリアイックラ日本人年大"),
    ("GB18030", "gb18030", "", r"[\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39]|[\x81-\xfe][\x40-\x7e\x80-\xfe]",
     r"[\xa1\xa3][\xa1-\xfe]|[\xb0-\xd7][\xa1-\xfe]",
     "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里，。"),
    ("Big5", "big5", "", r"[\x81-\xfe][\x40-\x7e\xa1-\xfe]", r"[\xa1-\xa3][\x40-\x7e\xa1-\xfe]|[\xa4-\xc6][\x40-\x7e\xa1-\xfe]",
     "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡，。"),
    ("x-windows-949", "cp949", "", r"[\x81-\xfe][\x41-\x5a\x61-\x7a\x81-\xfe]", r"[\xa1\xa3][\xa1-\xfe]|[\xb0-\xc8][\xa1-\xfe]",
     "이다의는에을가한고로를은하지도기사서인어리나시대자스해일정부전수아그있것들과"),
)
#: Alphabets of their own: (name, codec here, frequent letters).
ALPHABETS = (
    ("windows-1251", "cp1251", "оеаинтсрвлкмдпуя"),
    ("KOI8-R", "koi8_r", "оеаинтсрвлкмдпуя"),
    ("windows-1253", "cp1253", "αοιετσνηυρςπκμλάίόή"),
    ("windows-1255", "cp1255", "יוהלארתמבשנםעד"),
    ("windows-1256", "cp1256", "اليمنورتبعدهسفةأ"),
)
#: Latin charsets: (name, codec here, accented letters that are usual, other letters of its languages).
LATIN = (
    ("windows-1252", "cp1252", "éèêëàâäáãåæçíìîïñóòôöõøœúùûüßÉÈÊËÀÂÄÁÃÅÆÇÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜðþÐÞ", "ýÿŠŽšžÝ"),
    ("windows-1250", "cp1250", "ąćęłńóśźżáčďéěíňřšťúůýžőűäöüßĄĆĘŁŃÓŚŹŻÁČĎÉĚÍŇŘŠŤÚŮÝŽŐŰÄÖÜ", "âăîşţđëô"),
    ("windows-1254", "cp1254", "çğıöşüâîÇĞİÖŞÜ", "éèêàáäñóôß"),
)
#: How much of a second a letter counts that is known to a charset's languages but rare.
_RARE = 0.4
#: A sequence that is not valid weighs as much against a charset as so many characters for it.
_WRONG = 8
#: A score below this is no evidence.
_LEAST = 0.2
#: Bytes, and pieces of files, that are counted at a time.
_TOGETHER, _PIECES = 1 << 17, 512
#: A file can be cut behind such a byte: it is in no sequence of several bytes, and beside it a high byte counts as at a text's end.
_BREAK = re.compile(rb"[\x00-\x2f]")
#: Plain bytes, three at either end of a run and what is between: no score looks further from a high byte than two.
_FAR = r"([\x00-\x7f]{3})[\x00-\x7f]+([\x00-\x7f]{3})"


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """While it lasts, ``decode`` is analysed with all charsets of the JVM and replaces malformed text instead of failing.

    Both are bound when a frame is made, not when it runs, so the session is as it was afterwards.
    """
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "true")
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _characters(codec: str) -> str:
    """What the bytes 0x80 to 0xFF are; bytes without a meaning stay the control characters they are read as."""
    found = []
    for byte in range(0x80, 0x100):
        try:
            found.append(bytes([byte]).decode(codec))
        except UnicodeDecodeError:
            found.append(chr(byte))
    return "".join(found)


def _single(view: Column, codec: str) -> Column:
    """Text of bytes that are read as one character each."""
    pairs = [(chr(0x80 + i), c) for i, c in enumerate(_characters(codec)) if c != chr(0x80 + i)]
    return F.translate(view, "".join(p[0] for p in pairs), "".join(p[1] for p in pairs))


def _byte_pairs(characters: str, codec: str) -> str:
    """A pattern of the byte pairs that these characters are, by lead byte."""
    trails: dict[int, list[str]] = {}
    for c in dict.fromkeys(characters):
        lead, trail = c.encode(codec)
        trails.setdefault(lead, []).append(f"\\x{trail:02x}")
    return "|".join(f"\\x{lead:02x}[{''.join(t)}]" for lead, t in trails.items())


def _standing(characters: str, codec: str) -> np.ndarray:
    """Which of the bytes 0x80 to 0xFF are some of these characters."""
    return np.array([c in characters for c in _characters(codec)])


def _pairs_of(pattern: str) -> np.ndarray:
    """Which pairs of a byte from 0x80 on and any byte are all of what a pattern of bytes takes."""
    whole = re.compile(pattern.encode("ascii"), re.DOTALL)
    return np.array([whole.fullmatch(bytes((lead, trail))) is not None for lead in range(0x80, 0x100) for trail in range(0x100)])


@cache
def _tables() -> tuple[np.ndarray, ...]:
    """What bytes and pairs of bytes are, made once per process.

    ``beside``: 1 for a plain letter, 2 for a high byte. ``latin`` (byte, usual and rare of every Latin charset), ``letters`` (byte, frequent
    and unknown of every alphabet), ``follows`` (pair: bits of two frequent letters, and of a small letter before a capital one), ``pairs``
    (pair: bits of unit, common and frequent of every double-byte charset), ``singles`` (every double-byte charset, byte).
    """
    beside = np.zeros(0x100, np.uint8)
    beside[[c for c in range(0x80) if chr(c).isalpha()]], beside[0x80:] = 1, 2
    latin = np.stack([_standing(some, codec) for _, codec, *both in LATIN for some in both], 1)
    letters, follows = [], np.zeros(0x8000, np.uint16)
    for i, (_, codec, frequent) in enumerate(ALPHABETS):
        known, characters = _standing(frequent, codec), _characters(codec)
        letters += [known, np.array([c == chr(0x80 + at) and at != 0x20 for at, c in enumerate(characters)])]
        # a small letter before a capital one within a word: what an alphabet in another order looks like
        small, capital = np.array([c.islower() for c in characters]), np.array([c.isupper() for c in characters])
        for k, (first, second) in enumerate(((known, known), (small, capital))):
            follows |= (first[:, None] & np.r_[np.zeros(0x80, bool), second]).reshape(-1).astype(np.uint16) << (2 * i + k)
    pairs = np.zeros(0x8000, np.uint16)
    for i, (_, codec, _, unit, common, frequent) in enumerate(DOUBLE_BYTE):
        for k, pattern in enumerate((unit, common, _byte_pairs(frequent, codec))):
            pairs |= _pairs_of(pattern).astype(np.uint16) << (3 * i + k)
    singles = [np.array([bool(one) and re.fullmatch(f"[{one}]", chr(c)) is not None for c in range(0x80, 0x100)]) for _, _, one, *_ in DOUBLE_BYTE]
    return beside, latin, np.stack(letters, 1), follows, pairs, np.stack(singles)


def _before(flags: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Per high byte, what the byte before it has in ``flags``, if that is a high byte, too."""
    found = np.zeros(len(flags), bool)
    found[1:] = flags[:-1]
    return found & joined


def _units(units: np.ndarray, at: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The pairs that are taken in, of those that could be: in a run of overlapping ones every second, from its first."""
    first = np.maximum.accumulate(np.where(units & ~_before(units, joined), at, 0))
    return units & ((at - first) & 1 == 0)


def _threes(units: np.ndarray, at: np.ndarray, joined: np.ndarray, byte: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of EUC-JP of three bytes; their first bytes, and those that are taken in behind."""
    second, third = data[at + 1], data[at + 2]
    long = (byte == 0x8F) & (second >= 0xA1) & (second <= 0xFE) & (third >= 0xA1) & (third <= 0xFE)
    behind = _before(long, joined)
    units &= ~behind  # the run of pairs behind such a unit's first byte starts with its other two
    return long, behind | _before(behind, joined)


def _fours(units: np.ndarray, at: np.ndarray, joined: np.ndarray, byte: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of GB18030 of four bytes: two pairs of a lead byte and a digit, taken in by twos from the first of a chain."""
    second = data[at + 1]
    halves = np.flatnonzero((byte >= 0x81) & (byte <= 0xFE) & (second >= 0x30) & (second <= 0x39) & ~_before(units, joined))
    new = np.ones(len(halves), bool)
    new[1:] = np.diff(at[halves]) != 2
    rank = np.arange(len(halves)) - np.maximum.accumulate(np.where(new, np.arange(len(halves)), 0)) if len(halves) else halves
    whole = np.flatnonzero((rank & 1 == 0) & np.r_[~new[1:], np.zeros(min(len(halves), 1), bool)])
    long, behind = np.zeros(len(at), bool), np.zeros(len(at), bool)
    long[halves[whole]], behind[halves[whole + 1]] = True, True
    return long, behind


#: Double-byte charsets with units of more than two bytes.
_LONGER = {"euc_jp": _threes, "gb18030": _fours}


def _counted(pieces: list[bytes]) -> np.ndarray:
    """Per piece of a file, what its scores are made of: high bytes, and what they are in every charset."""
    beside, latin, letters, follows, pairs, singles = _tables()
    n = len(pieces)
    data = np.frombuffer(b"\n\n" + b"\n".join(pieces) + b"\n\n", np.uint8)  # a line end is to all scores what a text's end is
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, n) + 1) + 1
    at = np.flatnonzero(data >= 0x80)
    of = np.repeat(np.arange(n), np.diff(np.r_[0, np.searchsorted(at, ends)]))
    byte = data[at]
    high, after = byte.astype(np.int64) - 0x80, data[at + 1]
    pair = high * 0x100 + after
    joined = data[at - 1] >= 0x80

    def bits(flags: np.ndarray, count: int) -> np.ndarray:
        held = np.bincount(of * (1 << count) + flags, minlength=n << count).reshape(n, 1 << count)
        return held @ (np.arange(1 << count)[:, None] >> np.arange(count) & 1).astype(np.float64)

    def of_bytes(rows: np.ndarray | slice, table: np.ndarray) -> np.ndarray:
        return np.bincount(of[rows] * 0x80 + high[rows], minlength=n * 0x80).reshape(n, 0x80) @ table.astype(np.float64)

    # a plain letter next to it or one further, or nothing but plain characters around it
    left, further_left, right, further_right = (beside[data[at + k]] for k in (-1, -2, 1, 2))
    near = (left == 1) | (right == 1) | ((left == 2) & (further_left == 1)) | ((right == 2) & (further_right == 1)) | ((left < 2) & (right < 2))
    # the marks that open a Spanish question or exclamation are letters in other charsets
    opening = ((byte == 0xA1) | (byte == 0xBF)) & (left == 0) & (right == 1)
    found = [np.bincount(of, minlength=n)[:, None], np.bincount(of[opening], minlength=n)[:, None], of_bytes(near, latin)]
    found.append(of_bytes(slice(None), letters))
    some = follows[pair]
    found += [bits(some >> shift & (1 << count) - 1, count) for shift, count in ((0, 6), (6, 2 * len(ALPHABETS) - 6))]
    some = pairs[pair]
    for i, (_, codec, *_) in enumerate(DOUBLE_BYTE):
        mine = some >> (3 * i)
        units = _units(mine & 1 == 1, at, joined)
        long, behind = _LONGER[codec](units, at, joined, byte, data) if codec in _LONGER else (False, False)
        behind = behind | _before(units, joined)
        units = units | long
        wrong = ~(units | behind | singles[i][high])
        first = np.where(behind, 0, mine & 6).astype(np.uint8)  # common and frequent, where a unit begins
        found.append(bits(units.view(np.uint8) | first | wrong.view(np.uint8) << 3, 4))
    return np.concatenate(found, 1)


def _best(counts: np.ndarray) -> list[str]:
    """The charset with the best score per row of counts."""
    columns = iter(counts.astype(np.float64).T)
    high, opening = np.maximum(next(columns), 1), next(columns)
    scores = {}
    for name, codec, *_ in LATIN:
        usual, rare = next(columns), next(columns)
        scores[name] = (usual + _RARE * rare + (opening if codec == "cp1252" else 0)) / high
    letters = [(next(columns), next(columns)) for _ in ALPHABETS]
    follows = [(next(columns), next(columns)) for _ in ALPHABETS]
    for name, *_ in DOUBLE_BYTE:
        units, common, frequent, wrong = (next(columns) for _ in range(4))
        scores[name] = (common + 2 * frequent - _WRONG * wrong) / np.maximum(units, 1)
    for (name, *_), (known, unknown), (two, turned) in zip(ALPHABETS, letters, follows):
        scores[name] = (two + known / 2 - unknown - turned) / high
    names, ranked = list(scores), np.stack(list(scores.values()))
    return [names[i] if best >= _LEAST else FALLBACK for i, best in zip(ranked.argmax(0).tolist(), ranked.max(0).tolist())]


def _pieces(content: bytes) -> Iterator[bytes]:
    """A file in pieces of a bounded size whose counts add up to its own; a longer one only where there is nowhere to cut."""
    start = 0
    while len(content) - start > _TOGETHER and (end := _BREAK.search(content, start + _TOGETHER)):
        yield content[start:end.end()]
        start = end.end()
    yield content[start:]


def _names(files: pa.Array) -> pa.Array:
    """The name that a file comes with, or else the charset that its content looks like; null without either."""
    names, contents = files.field("name").to_pylist(), files.field("content")
    found, pieces, of, held = None, [], [], 0
    given = [i for i, valid in enumerate(contents.is_valid().to_pylist()) if valid]

    def add() -> None:
        nonlocal found
        counts = _counted(pieces)
        found = np.zeros((len(given), counts.shape[1])) if found is None else found
        np.add.at(found, of, counts)

    for row, i in enumerate(given):
        for piece in _pieces(contents[i].as_py()):
            if pieces and (held + len(piece) > _TOGETHER or len(pieces) == _PIECES):
                add()
                pieces, of, held = [], [], 0
            pieces.append(piece)
            of.append(row)
            held += len(piece)
    if pieces:
        add()
    for i, name in zip(given, _best(found) if given else ()):
        names[i] = name
    return pa.array(names, pa.string())


_named = F.arrow_udf(_names, T.StringType())


def _near_high(view: Column) -> Column:
    """The view with long runs of plain bytes shortened; its scores are those of the whole.

    Scores are counted at high bytes alone, so nothing is shortened before: that took longer than handing the bytes over.
    """
    return F.regexp_replace(view, _FAR, "$1$2")


def _guess(view: Column) -> Column:
    """The charset that bytes, read as one character each, look like."""
    return _named(F.struct(F.lit(None).cast("string").alias("name"), F.encode(view, "ISO-8859-1").alias("content")))


def charset_of(content: Column) -> Column:
    """Name of the charset that bytes are in; null for null. Text without a byte above 0x7F is UTF-8."""
    chain = F.when(F.is_valid_utf8(content.cast("string")), F.lit(UTF8))
    for mark, name in MARKS:
        chain = chain.when(F.hex(F.substring(content, F.lit(1), F.lit(len(mark) // 2))) == mark, F.lit(name))
    # one argument, so that what is known is found once, and only bytes that are to be scored are handed over
    return _named(let(chain, lambda name: F.struct(name.alias("name"), F.when(name.isNull(), content).alias("content"))))


def text_of(content: Column, charset: Column) -> Column:
    """Text of bytes in a charset that ``charset_of`` names, without a mark that named it. Needs ``java_charsets``."""
    chain = F.when(charset == UTF8, content.cast("string"))
    for mark, name in MARKS:
        rest = F.substring(content, F.lit(len(mark) // 2 + 1), F.length(content))
        chain = chain.when(charset == name, F.decode(rest, name))
    for name, *_ in DOUBLE_BYTE:
        chain = chain.when(charset == name, F.decode(content, name))
    view = F.decode(content, "ISO-8859-1")
    for name, codec, *_ in (*ALPHABETS, *LATIN):
        chain = chain.when(charset == name, _single(view, codec))
    return chain


def decoded(files: DataFrame, content: str = "content", charset: str | None = None) -> DataFrame:
    """``files`` with a column of bytes as text, line ends left as they are.

    ``charset``: the column ``with_charset`` added, so that nothing is detected again.
    The text comes out of a generator, so filters on it stay above and find it made: Spark would
    otherwise detect and decode once more for each of them.
    """
    text = let(F.col(charset) if charset else charset_of(F.col(content)), lambda name: text_of(F.col(content), name))
    with java_charsets(files.sparkSession):
        return files.select(*(F.explode(F.array(text)).alias(c) if c == content else F.col(c) for c in files.columns))


def with_charset(files: DataFrame, content: str = "content", name: str = "charset") -> DataFrame:
    """``files`` with the name of the charset that a column of bytes is in."""
    return files.withColumn(name, charset_of(F.col(content)))


def all_charsets() -> list[str]:
    """Names that ``charset_of`` gives."""
    found = [[UTF8], [n for _, n in MARKS], *([n for n, *_ in group] for group in (LATIN, DOUBLE_BYTE, ALPHABETS))]
    return reduce(lambda a, b: a + b, found)
