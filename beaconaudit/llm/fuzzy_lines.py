"""Fuzzy line deduplication: MinHash over character shingles, exact verification, union-find.

Lines are compared by their sets of five-character shingles (lower case, outer blanks off). A
signature has one minimum per bin of hashed shingles; empty bins take another bin's value by a fixed
rule, so equal sets keep equal signatures and one hash per shingle suffices. Rows of a signature make
bands. Lines that share a band are candidates, and candidates count if the Jaccard similarity of
their sets reaches the threshold. Of each component of such lines the earliest stays.

1. Hashes of lines and of bands meet, those of bands with a few bits that tell their lines apart. Lines seen
   twice, and bands of two different lines, go into a bitmap of bounded size.
2. A second pass keeps the lines that have such a band or are repeated, the former with their text, once per task:
   most lines are neither and go no further.
3. A bucket (all lines of a band) is compared in the task that gets it, pair by pair but for pairs
   that are connected already; a large bucket in pairs of blocks of bounded size. A bitmap of a line's
   shingles bounds how far two sets can be apart, so texts are compared hardly ever in vain; of the links
   found, those that connect something new go on. So a group of near copies costs its lines, not its pairs.
4. The first two bands connect most of what is similar. In the others only buckets that still hold
   different components are looked at. Every candidate pair is verified or already connected.
5. Components, the earliest place of each, and the removals meet as narrow rows. Only texts that
   lose a line (again by bitmap, then exactly) meet their removals in a shuffle.

Defined results: a null text has no lines and stays null; blank lines are never removed; a line
under five characters is a shingle of its own, so only equal ones are similar; rows that repeat an id and its text are one document and get the same result;
null ids come before all others; an empty table gives no rows; of the further columns
``dedup_lines`` passes all on. Earliest means smallest id, then a hash of the text, then the line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from beaconaudit.llm.bits import HashSet, hash_set, packed_twice, packed_with_tags, tagged, untagged
from beaconaudit.llm.common import fresh, partitions, tidied
from beaconaudit.llm.components import components
from beaconaudit.operators.store import stored

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares one of 20 bands of 6 with probability 0.998.
BANDS = 20
ROWS = 6
#: Characters of lines whose signatures are computed, or that are compared, at once.
CHUNK_CHARS = 2_000_000

#: Bins of a signature, of which the bands use the first.
BINS = 128
#: Bands whose buckets are looked at first; what they connect is not compared again in the others.
FIRST_BANDS = 2
#: Lines of a block, about: a bucket of more is compared in pairs of blocks.
BLOCK_LINES = 4096
#: Words of 64 bits in a bitmap of a line's shingles, and those of them that are looked at first.
WORDS = 16
FIRST_WORDS = 4

_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
_EMPTY = np.uint32(0xFFFFFFFF)


def shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    shared = len(x & y)
    return shared / (len(x) + len(y) - shared)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL[3]
    return h ^ (h >> np.uint64(29))


#: Bins in the order in which an empty bin (row) looks for a value, the same for all lines; and a bin's place in that order.
_ORDER = np.argsort(_mixed(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * _MUL[1]).reshape(BINS, BINS), axis=1)
_PLACE = np.argsort(_ORDER, axis=1)
#: Turns after which a line's filled bins are so few that they are ranked instead.
_TURNS = 8
#: Lines whose signatures are computed at once.
_LINES = 16_384


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (uint32) of all shingles, line by line, and how many each line has."""
    lines = [line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\0") for line in lines]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    # a shingle's hash at its first character; those that leave their line belong to no line
    h = chars[:len(chars) - SHINGLE + 1] * _ODD[0]
    for k in range(1, SHINGLE):
        h ^= h >> np.uint32(15)
        h *= _ODD[k]
        h += chars[k:len(chars) - SHINGLE + 1 + k]
    for k in (1, 2):
        h ^= h >> np.uint32(16)
        h *= _ODD[k]
    h ^= h >> np.uint32(15)
    start = np.cumsum(size) - size
    inside = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        inside[(start[1:] - k)] = False
    return h[inside], size - SHINGLE + 1


def bitmaps(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each line a bitmap (uint64) in which every shingle sets a bit, and its number of shingles, repeats included."""
    h, size = _hashes(lines)
    bits = np.zeros((len(lines), 64 * WORDS), bool)
    bits[np.repeat(np.arange(len(lines)), size), (h >> np.uint32(7)) % np.uint32(64 * WORDS)] = True
    return np.packbits(bits, axis=1).view(np.uint64), size


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of lines that are not empty: a minimum per bin (uint32), and how many of the bins had a value of their own."""
    n = len(lines)
    h, size = _hashes(lines)
    # the low bits say which bin; within a bin the high ones decide
    cell = np.repeat(np.arange(n) * BINS, size)
    cell += h & np.uint32(BINS - 1)
    least = np.full(n * BINS, _EMPTY)
    np.minimum.at(least, cell, np.minimum(h, _EMPTY - np.uint32(1)))
    least = least.reshape(n, BINS)
    filled = least != _EMPTY
    signature = least.copy()
    row, col = np.nonzero(~filled)
    for turn in range(_TURNS):
        source = _ORDER[col, turn]
        good = filled[row, source]
        r, c = row[good], col[good]
        signature[r, c] = least[r, source[good]] + np.uint32(turn + 1)
        row, col = row[~good], col[~good]
    if len(row):
        # of the line's filled bins the one that comes first in the bin's order
        own = filled.sum(axis=1)
        bins = np.nonzero(filled)[1]
        many = own[row]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(own) - own)[row] - (ends - many), many)
        first = np.minimum.reduceat(_PLACE[np.repeat(col, many), bins[at]], ends - many)
        signature[row, col] = least[row, _ORDER[col, first]] + (first + 1).astype(np.uint32)
    return signature, filled.sum(axis=1, dtype=np.int32)


def bands_of(lines: list[str]) -> np.ndarray:
    """The bands of lines that are not empty, some lines at a time."""
    return np.concatenate([bands(signatures(lines[i:i + _LINES])[0]) for i in range(0, len(lines), _LINES)])


def bands(signature: np.ndarray) -> np.ndarray:
    """The hashes (uint64) of each signature's bands."""
    wide = signature[:, :BANDS * ROWS].astype(np.uint64)
    out = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        out = _mixed((out + wide[:, k::ROWS]) * _MUL[k % 5] + np.uint64(k + 1))
    return _mixed(out + np.arange(1, BANDS + 1, dtype=np.uint64) * _MUL[0])


def lines_of(text: str) -> list[tuple[int, str]]:
    """The lines that take part: number and normal form."""
    found = ((i, line.strip()) for i, line in enumerate(text.lower().split("\n")))
    return [(i, line) for i, line in found if line]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[int], list[int], list[str]]]:
    """Places (doc_id, tie, line) and lines of bounded numbers of whole texts."""
    docs, ties, numbers, lines, size = [], [], [], [], 0
    for batch in batches:
        for doc_id, tie, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "tie", "text"))):
            found = lines_of(text or "")
            docs += [doc_id] * len(found)
            ties += [tie] * len(found)
            numbers += [i for i, _ in found]
            lines += [line for _, line in found]
            size += len(text or "")
            if size >= CHUNK_CHARS:
                yield docs, ties, numbers, lines
                docs, ties, numbers, lines, size = [], [], [], [], 0
    if lines:
        yield docs, ties, numbers, lines


def _distinct(lines: list[str]) -> tuple[list[str], np.ndarray]:
    place: dict[str, int] = {}
    of = np.fromiter((place.setdefault(line, len(place)) for line in lines), np.int64, len(lines))
    return list(place), of


def _line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")


def _bands_apart(value: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bands with tags that tell different lines (``ids``: a hash of each) apart, band by band anew."""
    turn = np.arange(1, BANDS + 1, dtype=np.uint64) * _MUL[2]
    return tagged(value, _mixed(ids[:, None] ^ turn) >> np.uint64(20))


def _id_hashes(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ids), np.uint64).reshape(-1, 2)[:, 0]


def _lists(values: np.ndarray, held: np.ndarray, there: np.ndarray) -> pa.Array:
    """Of each row the values that are held, null where it is not there."""
    held = held & there[:, None]
    ends = np.r_[0, np.cumsum(held.sum(axis=1))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.r_[~there, False]), pa.array(values[held].view(np.int64)))


def candidates(documents: DataFrame) -> DataFrame:
    """A row per line that is repeated or shares a band with a different one: doc_id, tie, line, id, again (it is repeated).

    The first in its chunk of those that share bands has its text and these bands too (``first``: of the first bands).
    """
    @tidied
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for _, _, _, lines in _chunks(batches):
                some, of = _distinct(lines)
                if some:
                    ids = _id_hashes([_line_id(line) for line in some])
                    yield [ids, ids[np.bincount(of) > 1]], _bands_apart(bands_of(some), ids).ravel()

        yield from packed_with_tags(values(), tasks)

    @tidied
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, ties, numbers, lines in _chunks(batches):
            some, of = _distinct(lines)
            if not some:
                continue
            ids = [_line_id(line) for line in some]
            again = held.holds(_id_hashes(ids))
            value = untagged(bands_of(some))
            near = held.holds(value.ravel()).reshape(value.shape)
            alike = near.any(axis=1)
            rows = np.flatnonzero((again | alike)[of])
            if not len(rows):
                continue
            line = of[rows]
            first = np.zeros(len(rows), bool)
            first[np.unique(line, return_index=True)[1]] = True
            first &= alike[line]
            value, near = value[line], near[line]
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[r] for r in rows.tolist()], pa.int64()), pa.array([ties[r] for r in rows.tolist()], pa.int64()),
                 pa.array([numbers[r] for r in rows.tolist()], pa.int32()), pa.array([ids[i] for i in line.tolist()], pa.binary()), pa.array(again[line]),
                 pa.array([some[i] if whole else None for i, whole in zip(line.tolist(), first.tolist())], pa.string()),
                 _lists(value[:, :FIRST_BANDS], near[:, :FIRST_BANDS], first), _lists(value, near, first)],
                names=["doc_id", "tie", "line", "id", "again", "text", "first", "bands"])

    rows, tasks = _rows(documents), partitions(documents.sparkSession)
    held = hash_set(stored(packed_twice(rows.mapInArrow(hashes, "part long, data binary"), "hash", tasks)))
    return stored(rows.mapInArrow(shared, "doc_id long, tie long, line int, id binary, again boolean, text string, first array<long>, bands array<long>"))


class _Sets:
    """The shingles of lines seen lately, of a bounded number of characters.

    Five characters of 12 bits are one number, so most lines' shingles are sorted numbers; those of other lines are strings.
    """

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray | None] = {}
        self.chars = 0

    def of(self, line: str) -> np.ndarray | None:
        if line not in self.known:
            if self.chars > CHUNK_CHARS:
                self.known.clear()
                self.chars = 0
            self.known[line] = _numbers(line)
            self.chars += len(line)
        return self.known[line]

    def similar(self, a: str, b: str, threshold: float) -> bool:
        x, y = self.of(a), self.of(b)
        if x is None or y is None:
            some, others = shingles(a), shingles(b)
            shared, both = len(some & others), len(some) + len(others)
        else:
            values = np.concatenate((x, y))
            values.sort()
            shared, both = np.count_nonzero(values[1:] == values[:-1]), len(values)
        return bool(shared >= threshold * (both - shared))


def _numbers(line: str) -> np.ndarray | None:
    """A line's distinct shingles as sorted numbers; none if it is too short or has characters beyond 12 bits."""
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars) - SHINGLE + 1
    if n < 1 or chars.max() >= 1 << 12:
        return None
    values = chars[:n].astype(np.uint64)
    for k in range(1, SHINGLE):
        values <<= np.uint64(12)
        values |= chars[k:n + k]
    values.sort()
    return values[np.r_[True, values[1:] != values[:-1]]]


def new_links(cell: np.ndarray, ids: list[bytes], top: np.ndarray, block: np.ndarray, crossed: np.ndarray, lines: list[str],
              threshold: float, sets: _Sets) -> Iterator[tuple[bytes, bytes]]:
    """Links that connect, with those that ``top`` (a component's hash) stands for, all similar lines of a cell.

    Rows of a cell stand together. Of a crossed cell only lines of different blocks are compared. Sets of x and y
    shingles can be similar only if they differ in (x + y) (1 - threshold) / (1 + threshold) at most, and they differ
    at least where their bitmaps do.
    """
    n = len(cell)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows from here to the end of the cell
    different, of = _distinct(lines)
    maps, count = bitmaps(different)
    group = np.unique(top, return_inverse=True)[1]
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    rows = np.arange(n)
    for step in range(1, int(sizes.max())):
        rows = rows[left[rows] > step]
        a = rows[group[rows] != group[rows + step]]
        a = a[~crossed[a] | (block[a] != block[a + step])]
        for words in (slice(0, FIRST_WORDS), slice(FIRST_WORDS, WORDS)):
            # a bound of the first words is one of all words
            x, y = of[a], of[a + step]
            apart = np.bitwise_count(maps[x, words] ^ maps[y, words]).sum(axis=1, dtype=np.int64)
            if words.start:
                apart += earlier
            near = apart * (1 + threshold) <= (count[x] + count[y]) * (1 - threshold) + 1e-6
            a, earlier = a[near], apart[near]
        linked = False
        for i in a.tolist():
            x, y = root(group[i]), root(group[i + step])
            if x != y and sets.similar(lines[i], lines[i + step], threshold):
                parent[max(x, y)] = min(x, y)
                linked = True
                yield ids[i], ids[i + step]
        if linked:
            while (parent != parent[parent]).any():
                parent = parent[parent]
            group = parent[group]


def buckets_to_compare(rows: DataFrame) -> DataFrame:
    """(band, blocks) of the buckets of ``rows(id, text, top, band)`` that hold different components.

    Of buckets with the same members (told by their number and sums of three hashes) one is compared: it finds all that the others would.
    """
    return _buckets(rows.select(F.xxhash64("id").alias("one"), F.length("text").alias("chars"), "top", "band"))


def _buckets(rows: DataFrame) -> DataFrame:
    """The same of ``rows(one, chars, top, band)``: a hash of the line, and its length. A line may be there several times."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_LINES), F.ceil(F.sum("chars") / CHUNK_CHARS)).cast("int")
    # sums, as a line that is there twice would be lost in a bit_xor
    members = [F.sum(F.xxhash64("one", F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"members_{k}") for k in (2, 3, 4)]
    buckets = rows.groupBy("band").agg(blocks.alias("blocks"), F.count("*").alias("n"), *members,
                                       F.min("top").alias("least"), F.max("top").alias("most")).where("least != most")
    same = buckets.groupBy("n", "members_2", "members_3", "members_4")
    return same.agg(F.min("band").alias("band"), F.max("blocks").alias("blocks")).select("band", "blocks")


def _links(lines: DataFrame, column: str, roots: DataFrame | None, threshold: float) -> DataFrame:
    """(id_a, id_b): links that connect, with ``roots``, all similar lines that share one of the bands in a column.

    A bucket is cut into blocks by hash, and a task compares two of its blocks at a time.
    """
    @tidied
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, open_, size = _Sets(), [], 0

        def links_of(some: pa.Table) -> pa.RecordBatch:
            name = np.stack([some[c].to_numpy().astype(np.int64) for c in ("band", "low", "high")], axis=1)
            cell = np.cumsum(np.r_[0, (name[1:] != name[:-1]).any(axis=1)])
            found = list(new_links(cell, some["id"].to_pylist(), some["top"].to_numpy(), some["block"].to_numpy(),
                                   name[:, 1] != name[:, 2], some["text"].to_pylist(), threshold, sets))
            return pa.RecordBatch.from_arrays([pa.array([link[k] for link in found], pa.binary()) for k in (0, 1)], names=["id_a", "id_b"])

        # rows come sorted: whole cells are compared once there are enough of them
        for batch in batches:
            if not len(batch):
                continue
            open_.append(batch)
            size += len(batch) + batch.nbytes // 256
            if size < BLOCK_LINES:
                continue
            some = pa.Table.from_batches(open_)
            last = np.ones(len(some), bool)
            for c in ("band", "low", "high"):
                values = some[c].to_numpy()
                last &= values == values[-1]
            whole = len(some) - int(last.sum())
            if whole:
                yield links_of(some.slice(0, whole))
            open_ = some.slice(whole).to_batches()
            size = 0
        if open_:
            yield links_of(pa.Table.from_batches(open_))

    one = F.xxhash64("id")
    if roots is None:
        lines = lines.withColumn("top", one)
    else:
        # most lines have no root yet, which a bitmap tells before any text is shuffled
        linked = hash_set(roots.select(one.alias("line"))).column(one)
        known = roots.select("id", F.xxhash64("top").alias("top"))
        lines = lines.where(~linked).withColumn("top", one).unionByName(
            lines.where(linked).join(known, "id", "left").withColumn("top", F.coalesce("top", one)))
    buckets = stored(_buckets(lines.select(one.alias("one"), F.length("text").alias("chars"), "top", F.explode(column).alias("band"))))
    # texts are shuffled once: a bitmap leaves out buckets of one component
    rows = lines.select("id", "top", "text", F.col(column).alias("bands")).mapInArrow(_exploded(hash_set(buckets.select("band"))),
                                                                                     "id binary, top long, text string, band long")
    # a bucket of several blocks has thousands of lines, or millions of characters, so there are few
    rows = rows.join(F.broadcast(buckets.where("blocks > 1")), "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "top", "text", "band", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    cell = ("band", "low", "high")
    rows = rows.repartition(partitions(lines.sparkSession), *cell).sortWithinPartitions(*cell)
    return rows.mapInArrow(cells, "id_a binary, id_b binary").distinct()


def _exploded(wanted: HashSet) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes (id, top, text, band) of rows (id, top, text, bands), of the bands that are wanted only."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = pc.list_flatten(batch["bands"])
            held = pa.array(wanted.holds(band.to_numpy(zero_copy_only=False).view(np.uint64)))
            some = batch.select(["id", "top", "text"]).take(pc.list_parent_indices(batch["bands"]).filter(held))
            yield pa.RecordBatch.from_arrays([*some.columns, band.filter(held)], names=["id", "top", "text", "band"])

    return rows


def _compared(found: DataFrame) -> DataFrame:
    """(id, text, first, bands) of the lines that share a band with a different line, each once (hardly ever twice)."""
    rows = found.where("bands IS NOT NULL")
    key = F.xxhash64("id", "doc_id", "tie", "line")
    owners = hash_set(stored(rows.groupBy("id").agg(F.min(key).alias("key")).select("key")))
    return stored(rows.where(owners.column(key)).select("id", "text", "first", "bands"))


def line_components(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, top) of the lines of ``candidates`` that are similar to another line with a smaller id, or joined to one by a chain of such."""
    return joined(_compared(found), threshold)


def joined(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same of ``lines(id, text, first, bands)``, with the bands in which each is to be compared."""
    def tops(links: DataFrame) -> DataFrame:
        return components(links).withColumnsRenamed({"node": "id", "root": "top"})

    links = stored(_links(lines, "first", None, threshold))
    return tops(links.unionByName(stored(_links(lines, "bands", tops(links), threshold))))


def removals(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tie, lines): the numbers of the lines that go, per document that loses any."""
    found = candidates(documents)
    roots = line_components(found, threshold)
    # a line that is there once and linked to none stays: narrow rows of the others meet
    linked = hash_set(roots.select("id").union(roots.select("top")).select(F.xxhash64("id").alias("line")))
    found = found.select("id", "doc_id", "tie", "line", "again").where(F.col("again") | linked.column(F.xxhash64("id")))
    place = F.struct("doc_id", "tie", "line")
    first = found.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    top = stored(first.join(roots, "id", "left").select("id", "first", "last", F.coalesce("top", "id").alias("top")))
    groups = top.groupBy("top").agg(F.min("first").alias("stays"), F.max("last").alias("last")).where("stays != last").select("top", "stays")
    stays = top.join(groups, "top").select("id", "stays")
    gone = found.select("id", "doc_id", "tie", "line").join(stays, "id").where(place != F.col("stays"))
    return gone.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("lines"))


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of the numbers given."""
    return pd.Series(["\n".join(line for i, line in enumerate(t.split("\n")) if i not in lost)
                      for t, lost in zip(text, map(set, gone))])


def dedup_lines(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every column they have, the removed lines out of ``text``, and in a last column their numbers.

    The last column is ``removed_lines`` (or close to it, if that name is taken): an array, empty for most.
    """
    lost = stored(removals(documents, threshold))
    removed, tie, lost_id, lost_tie = fresh(documents, "removed_lines", "tie", "lost_id", "lost_tie")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("tie"))
    affected = hash_set(lost.select(key.alias("key")))

    rows = documents.withColumn(tie, F.xxhash64("text"))
    maybe = affected.column(F.xxhash64(F.col("doc_id").cast("long"), F.col(tie)))
    lost = lost.select(F.col("doc_id").alias(lost_id), F.col("tie").alias(lost_tie), F.sort_array("lines").alias(removed))
    none = F.array().cast("array<int>")
    whole = rows.where(~maybe).withColumn(removed, none)
    cut = rows.where(maybe).join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(lost_id)) & (F.col(tie) == F.col(lost_tie)), "left")
    cut = cut.withColumn(removed, F.coalesce(removed, none))
    cut = cut.withColumn("text", F.when(F.size(removed) == 0, F.col("text")).otherwise(_without(F.col("text"), F.col(removed))))
    columns = [*documents.columns, removed]
    return whole.select(*columns).unionByName(cut.select(*columns))
