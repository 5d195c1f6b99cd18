"""Personal data in texts: fixed base patterns, and spans that a semi-Markov CRF adds to them.

The base patterns find e-mail and IP addresses, card and telephone numbers in their plain spelling.
The model finds the same four kinds in other spellings (``name [at] host [dot] org``, numbers
without a plus sign, addresses written ``10[.]0[.]0[.]1``). It looks at a *window* around digits or
``@`` that no base span covers, scores every span of the window as a whole (digits in it, its
shape, the check digit, words before it) for every kind, and dynamic programming over the window
chooses boundaries and kinds of all entities together. An entity has a bounded number of tokens, so
a window costs its length times that bound.

The model is trained on the table itself: windows around the base spans of a bounded sample, each
also with its span respelt, and windows of numbers that are nothing of the kind.

Defined results: a null text is empty and has no spans; repeated rows and null ids are treated row
by row; an empty table gives no rows (the model is then trained without context from the table);
only doc_id and text are read, so other columns cannot clash. Work grows linearly with a text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents, those with the smallest ids, from whose windows the model is trained.
SAMPLE_DOCS = 2000
#: Windows of that sample that are used at most.
SAMPLE_WINDOWS = 240
#: Most tokens of one entity.
MAX_TOKENS = 26
#: Text on either side of an anchor that belongs to its window.
MARGIN = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# Starts inside a run of digits can only repeat what the start of the run gave, so they are left
# out, and runs are taken whole: both keep long numbers linear and change no match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed and then by start."""
    found: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at) if start < at else None
        floor = host.end() if host else at + 1
        if host:
            found.append(("email", start, floor))
        at = text.find("@", floor)
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# ---- windows and their spans -------------------------------------------------------------------

_ANCHOR = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[ ().\[\]/_-]{0,3}[0-9]){6,24}|@|[\[({<] ?(?:at|AT) ?[\])}>]|[\[({<]\.[\])}>]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_CUES = {
    "email": re.compile(r"(?:mail|contact|write|reach)\W*(?:\w+\W+)?$", re.I),
    "ip": re.compile(r"(?:\bip|host|server|address)\W*(?:\w+\W+)?$", re.I),
    "card": re.compile(r"(?:card|visa|credit|payment)\W*(?:\w+\W+)?$", re.I),
    "phone": re.compile(r"(?:phone|tel|call|mobile|fax)\W*(?:\w+\W+)?$", re.I),
}
_DOTTED = r"(?:\.| ?[\[({<] ?(?:\.|dot|DOT) ?[\])}>] ?)"
_SHAPES = {
    "email": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:{_DOTTED}[A-Za-z0-9_%+-]+)*(?:@| ?[\[({{<] ?(?:@|at|AT) ?[\])}}>] ?)"
                        rf"[A-Za-z0-9-]+(?:{_DOTTED}[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?: ?[\[({<]\.[\])}>] ?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}"),
    "phone": re.compile(r"(?:(?:\+|00)[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[.-])[0-9]{3,4}[ .-][0-9]{3,4}"),
}


def windows(text: str, covered: list[Span]) -> Iterator[tuple[int, int]]:
    """Places of the text where the model has to look: around anchors in the gaps between base spans."""
    gaps, at = [], 0
    for s, e in sorted((s, e) for _, s, e in covered):
        if s > at:
            gaps.append((at, s))
        at = max(at, e)
    gaps.append((at, len(text)))
    begin, end = -1, -1
    for first, last in gaps:
        for m in _ANCHOR.finditer(text, first, last):
            s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
            if begin >= 0 and s <= end:
                end = e
                continue
            if begin >= 0:
                yield begin, end
            begin, end = s, e
    if begin >= 0:
        yield begin, end


def _features(text: str, s: int, e: int, kind: str) -> list[str]:
    """What is known of the whole span ``text[s:e]`` as an entity of a kind."""
    span, digits = text[s:e], _digits(text[s:e])
    n = len(digits)
    size = "0" if n == 0 else "1-6" if n < 7 else "7-8" if n < 9 else "9-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20+"
    out = ["bias", f"digits {size}", "shape" if _SHAPES[kind].fullmatch(span) else "other shape"]
    if s and text[s - 1].isalnum() or e < len(text) and text[e].isalnum():
        out.append("cut word")
    if s and text[s - 1] in ".-/([{<+@" or e < len(text) - 1 and text[e] in ".-/@" and text[e + 1].isalnum():
        out.append("goes on")
    if kind == "card":
        out.append("check digit" if n and luhn(digits) else "no check digit")
    if kind == "ip":
        out.append("bytes" if n and all(int(p) < 256 for p in re.findall("[0-9]{1,9}", span)) else "no bytes")
    if _CUES[kind].search(text, max(0, s - 24), s):
        out.append("cue")
    return [f"{kind}: {f}" for f in out]


def _outside(token: str) -> str:
    return "O: digits" if token[0] in "0123456789" else "O: word" if token[0].isalnum() else "O: mark"


class Lattice:
    """All entities a window may hold: edges over its tokens, each with its features."""

    def __init__(self, text: str, blocked: Iterable[tuple[int, int]] = ()) -> None:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        self.tokens, n = tokens, len(tokens)
        blocked = list(blocked)
        free = [not any(s < e2 and s2 < e for s2, e2 in blocked) for s, e in tokens]
        #: by the place where they end: (start, kind or "", features)
        self.ending: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(n + 1)]
        for j in range(n):
            self.ending[j + 1].append((j, "", [_outside(text[tokens[j][0]:tokens[j][1]])]))
        for i in range(n):
            first = text[tokens[i][0]]
            if not (first.isalnum() or first in "(+"):
                continue
            digits = 0
            for j in range(i, min(n, i + MAX_TOKENS)):
                if not free[j]:
                    break
                s, e = tokens[j]
                digits += e - s if text[s] in "0123456789" else 0
                if "\n" in text[s:e]:
                    break
                if not text[e - 1].isalnum():
                    continue
                span = text[tokens[i][0]:e]
                for kind in KINDS:
                    if (("@" in span or "at" in span or "AT" in span) and j > i + 1) if kind == "email" else digits >= (4 if kind == "ip" else 7):
                        self.ending[j + 1].append((i, kind, _features(text, tokens[i][0], e, kind)))

    def best(self, weight: dict[str, float]) -> list[tuple[str, int, int]]:
        """The most probable segmentation, as spans."""
        best, back = [0.0] + [-math.inf] * len(self.tokens), [None] * (len(self.tokens) + 1)
        for j in range(1, len(best)):
            for edge in self.ending[j]:
                score = best[edge[0]] + sum(weight.get(f, 0.0) for f in edge[2])
                if score > best[j]:
                    best[j], back[j] = score, edge
        found, j = [], len(best) - 1
        while j:
            i, kind, _ = back[j]
            if kind:
                found.append((kind, self.tokens[i][0], self.tokens[j - 1][1]))
            j = i
        return found[::-1]

    def gradient(self, weight: dict[str, float], truth: set[Span]) -> dict[str, float]:
        """Observed less expected feature counts: the slope of the log-likelihood."""
        n = len(self.tokens)
        scores = [[sum(weight.get(f, 0.0) for f in e[2]) for e in edges] for edges in self.ending]
        ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[e[0]] + s for e, s in zip(self.ending[j], scores[j])])
        for j in range(n, 0, -1):
            for e, s in zip(self.ending[j], scores[j]):
                behind[e[0]] = _log_sum([behind[e[0]], behind[j] + s])
        inside = [any(s2 <= s < e2 for _, s2, e2 in truth) for s, _ in self.tokens]
        slope: dict[str, float] = {}
        for j in range(1, n + 1):
            for e, s in zip(self.ending[j], scores[j]):
                i, kind, features = e
                seen = not inside[i] if not kind else (kind, self.tokens[i][0], self.tokens[j - 1][1]) in truth
                change = seen - math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n]))
                if abs(change) > 1e-6:
                    for f in features:
                        slope[f] = slope.get(f, 0.0) + change
        return slope


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


# ---- training ----------------------------------------------------------------------------------

def respelt(kind: str, span: str, rng: random.Random) -> str | None:
    """Another spelling of a plain entity, which the base patterns do not take."""
    if kind == "email":
        a, z = rng.choice(["[]", "()", "{}"])
        gap = rng.choice(["", " "])
        dot = f"{gap}{a}dot{z}{gap}" if rng.random() < 0.7 else "."
        name, host = span.split("@", 1)
        return f"{name}{gap}{a}at{z}{gap}{host.replace('.', dot)}"
    if kind == "ip":
        return span.replace(".", rng.choice(["[.]", "(.)"]))
    digits = _digits(span)
    if kind == "card":
        if len(digits) != 16:
            return None
        return rng.choice("./_").join(digits[i:i + 4] for i in range(0, 16, 4))
    local = digits[-10:]
    if len(local) < 10:
        return None
    a, b, c = local[:3], local[3:6], local[6:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a}-{b}-{c}", f"({a}) {b} {c}"])


def _nothing(rng: random.Random) -> str:
    """A number, or a text around an ``@``, that is no personal data."""
    n = "".join(rng.choice("123456789") for _ in range(20))
    return rng.choice([
        f"20{n[:2]}-0{n[2]}-1{n[3]} 1{n[4]}:3{n[5]}:2{n[6]}", f"{n[:2]}/0{n[2]}/20{n[3:5]}", n[:rng.randint(7, 20)],
        f"{n[:2]}.{n[2:5]}.{n[5:8]}", f"{n[:1]},{n[1:4]},{n[4:7]},{n[7:10]}", f"{n[:3]} {n[3:6]} {n[6:9]}",
        f"978-{n[0]}-{n[1:4]}-{n[4:9]}-{n[9]}", f"{n[:8]}-{n[8:12]}-{n[12:16]}", f"@{'abcdefghi'[int(n[0]) - 1]}user",
        f"v{n[0]}.{n[1]}.{n[2]}.{n[3]}.{n[4]}", f"{n[:4]}.{n[4:8]}.{n[8:12]}.{n[12:15]}0" if not luhn(n[:15] + "0") else n[:9],
        f"{n[:4]}-{n[4:8]}", f"{n[:3]}[{n[3]}]", f"no. {n[:3]}/{n[3:6]}/{n[6:9]}", f"{n[:2]}:{n[2:4]}:{n[4:6]}:{n[6:8]}"])


def train(seen: list[tuple[str, str, str, str]], seed: int = 7, rounds: int = 12) -> dict[str, float]:
    """Weights from rows (kind, left text, span, right text); a few plain ones stand in where there are none."""
    rng = random.Random(seed)
    plain = {"email": "j.doe@host.example.org", "ip": "192.168.20.7", "card": "4539578763621486", "phone": "+1 (212) 555-0187"}
    seen = sorted(seen)[:SAMPLE_WINDOWS]
    contexts = [(left, right) for _, left, _, right in seen] or [("see ", " there"), ("", ""), ("", "."), ("the ", ", or")]
    examples: list[tuple[str, set[Span]]] = []
    for kind, left, span, right in seen + [(k, *c[:1], plain[k], *c[1:]) for k in KINDS for c in rng.choices(contexts, k=30)]:
        if other := respelt(kind, span, rng):
            examples.append((left + other + right, {(kind, len(left), len(left) + len(other))}))
    for left, right in rng.choices(contexts, k=max(160, len(examples))):
        examples.append((left + _nothing(rng) + right, set()))
    lattices = [(Lattice(text, [(s, e) for _, s, e in base_spans(text)]), truth) for text, truth in examples]
    weight: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(rounds):
        rng.shuffle(lattices)
        for lattice, truth in lattices:
            for f, g in lattice.gradient(weight, truth).items():
                g -= 1e-4 * weight.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + g * g
                weight[f] = weight.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f] + 1e-8)
    return weight


def find(text: str, weight: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those of the base and those the model adds beside them."""
    base = base_spans(text)
    added = []
    for s, e in windows(text, base):
        lattice = Lattice(text[s:e], [(b - s, f - s) for _, b, f in base if b < e and s < f])
        added += [(kind, s + b, s + f) for kind, b, f in lattice.best(weight)]
    return base, sorted(set(base + added), key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if added else base


# ---- over tables -------------------------------------------------------------------------------

def _sampled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(kind, text[max(0, s - MARGIN):s], text[s:e], text[e:e + MARGIN])
                for text in batch["text"].to_pylist() if text for kind, s, e in base_spans(text)[:8]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 4,
                                         names=["kind", "l", "span", "r"])


def model(documents: DataFrame) -> dict[str, float]:
    """Trains on ``SAMPLE_WINDOWS`` windows at most, from the ``SAMPLE_DOCS`` smallest ids."""
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").orderBy("doc_id").limit(SAMPLE_DOCS)
    last = ids.agg(F.max("doc_id")).first()[0]
    if last is None:
        return train([])
    rows = (documents.where(F.col("doc_id") <= last).select("text").where("text RLIKE '[0-9@]'")
            .mapInArrow(_sampled_windows, "kind string, l string, span string, r string")
            .distinct().orderBy(F.xxhash64("kind", "l", "span", "r"), "l", "span", "r").limit(SAMPLE_WINDOWS).collect())
    return train([tuple(r) for r in rows])


def personal_data(documents: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """Per document: doc_id, base (array of kind, start, end) and found (the same, with added spans)."""
    weight = model(documents) if weight is None else weight
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, weight) if t else ([], []) for t in batch["text"].to_pylist()]
            cells = [[[dict(zip(("kind", "start", "end"), s)) for s in f[side]] for f in found] for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, span) for c in cells)], names=["doc_id", "base", "found"])

    item = "array<struct<kind: string, start: int, end: int>>"
    return documents.select("doc_id", "text").mapInArrow(spans, f"doc_id {dict(documents.dtypes)['doc_id']}, base {item}, found {item}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as text."""
    def joined(name: str):
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))
