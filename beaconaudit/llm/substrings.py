"""Repeated byte strings, found by merging the suffix orders and transforms of shards.

A suffix order of all bytes costs as much for text that occurs once as for text that repeats. The
shards here are sparse: of the places in a window of ``WIDTH`` bytes, the one whose 40-byte string
has the least hash is its *anchor*, so equal windows have equal anchors at equal places, and an
anchor speaks for a run of windows, about one for every 31 bytes. A shard keeps, for its anchored
suffixes, what a Burrows-Wheeler transform keeps for all: their order by what follows and the bytes
that come before.

Orders of several shards are merged by interleave refinement. At the start anchors of one hash are a
block; a step splits every block by the next eight symbols, and the depth at which a border between
neighbours appears is their common prefix. The same is done to the bytes before. A window that
starts ``o`` bytes before its anchor is repeated where an interval of the order has common
prefixes of at least ``WIDTH - o`` on that side and ``o`` on this side; the earliest stays. No
suffix is ever compared with more than its block, and blocks of one are done.

1. Hashes of anchors are counted over the corpus; those seen twice go into a bitmap of bounded size.
2. Each task finds its anchors again, keeps those in the bitmap, merges its own shard (windows that
   the shard has earlier are settled there, so of any text a shard sends one copy), and sends the others
   with their surroundings to the task of their hash.
3. That task merges the shards.

Hashes only bring rows together; bytes decide. Defined results: a null text is empty; texts shorter
than the width keep everything; rows that repeat an id and its text are one document and get the
same result, rows that repeat an id with other texts are documents ordered by a hash of the text;
null ids come before all others; an empty table gives no rows; only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconaudit.llm.bits import HashSet, hash_set
from beaconaudit.llm.common import partitions
from beaconaudit.operators.store import stored

WIDTH = 100
_GRAM = 40
_SPAN = WIDTH - _GRAM  # largest distance from a window's start to its anchor
#: Bytes of text that are one shard, bytes whose anchors are looked for at once, and rows that are
#: merged at once (whole blocks).
SHARD_BYTES = 16 << 20
SLICE = 1 << 20
MERGE_ROWS = 60_000
_ROW = "hash long, doc_id long, tie long, pos long, lo long, data binary"
_SCHEMA = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("pos", pa.int64()), ("lo", pa.int64()), ("data", pa.binary())])
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``_GRAM`` bytes at every place where so many follow."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD[5]
    h ^= h >> np.uint64(29)
    size, by_size = 1, {}
    while size <= 32:
        by_size[size] = h
        if size < 32:
            h = h[:-size] * _ODD[size.bit_length() - 1] + h[size:]
            h ^= h >> np.uint64(31)
        size *= 2
    h = by_size[32][:-8] * _ODD[0] + by_size[8][32:]
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts one after the other (``ends``: where each ends): hash, text, place, and first and last window start.

    Every window of ``WIDTH`` bytes within a text belongs to exactly one anchor, the leftmost of the least hash.
    """
    nothing = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    if len(data) < WIDTH:
        return nothing
    h = _gram_hashes(data)
    least = _sliding(h, _SPAN + 1, np.minimum)  # by start of the window
    starts = np.concatenate([[0], ends[:-1]])
    for s, e in zip(np.maximum(starts, ends - WIDTH + 1).tolist(), ends.tolist()):
        least[s:e] = 0  # a window there would leave its text
    reach = _sliding(np.concatenate([np.zeros(_SPAN, np.uint64), least, np.zeros(_SPAN, np.uint64)]), _SPAN + 1, np.maximum)
    place = np.flatnonzero((h == reach) & (h != 0))
    text = np.searchsorted(ends, place, side="right")
    while True:
        if not len(place):
            return nothing
        value = h[place]
        last = np.minimum(place, ends[text] - WIDTH)
        same = text[1:] == text[:-1]
        taken = same & (value[1:] < value[:-1])  # the next anchor takes over as soon as a window holds it
        last[:-1] = np.where(taken, np.minimum(last[:-1], place[1:] - _SPAN - 1), last[:-1])
        first = np.maximum(place - _SPAN, starts[text])
        first[1:] = np.where(same, np.maximum(first[1:], last[:-1] + 1), first[1:])
        real = first <= last
        if real.all():
            return value, text, place, first, last
        place, text = place[real], text[real]


def _all_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of texts, in bounded memory: hash, text, and place, first and last window start within the text.

    Long texts are cut into slices by where windows start. An anchor of windows on both sides comes
    once with each slice; slices are those of the text, so they are the same wherever it is met.
    """
    parts, size = [], 0

    def found() -> tuple[np.ndarray, ...]:
        value, part, place, first, last = anchors(np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), np.cumsum([len(p) for _, _, p in parts]))
        lengths = np.array([len(p) for _, _, p in parts])
        shift = np.array([a for _, a, _ in parts], np.int64) - (np.cumsum(lengths) - lengths)
        return value, np.array([t for t, _, _ in parts], np.int64)[part], place + shift[part], first + shift[part], last + shift[part]

    for number, text in enumerate(texts):
        for at in range(0, len(text) - WIDTH + 1, SLICE):
            parts.append((number, at, text[at:at + SLICE + WIDTH - 1]))
            size += len(parts[-1][2])
            if size >= SLICE:
                yield found()
                parts, size = [], 0
    if parts:
        yield found()


def _refine(table: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by block and bytes, and the common prefix of each row with the one before (-1: another block)."""
    n, width = table.shape
    words = np.ascontiguousarray(table).view(">u8").astype(np.uint64)
    order = np.argsort(block, kind="stable")
    border = np.ones(n, bool)
    border[1:] = block[order][1:] != block[order][:-1]
    prefix = np.where(border, -1, width).astype(np.int32)
    for step in range(words.shape[1]):
        # only rows that share their block with another go on
        alone = border & np.append(border[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        rows, number = order[at], np.cumsum(border)[at]
        word = words[rows, step]
        turn = np.lexsort((word, number))
        rows, word, number = rows[turn], word[turn], number[turn]
        order[at] = rows
        new = np.zeros(len(at), bool)
        new[1:] = (number[1:] == number[:-1]) & (word[1:] != word[:-1])
        place = np.flatnonzero(new)
        differ = table[rows[place], 8 * step:8 * step + 8] != table[rows[place - 1], 8 * step:8 * step + 8]
        prefix[at[place]] = 8 * step + differ.argmax(axis=1)
        border[at[place]] = True
    return order, prefix


def merge(block: np.ndarray, anchor: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Which windows of each row an earlier row of its block has too: a row per row, a column per start.

    Rows come in the order of the corpus within their block; ``data`` are the bytes of all windows of
    a row, ``anchor`` the anchor's place in them.
    """
    n = len(data)
    size = np.fromiter(map(len, data), np.int64, n)
    flat = np.frombuffer(b"".join(data) + bytes(2 * WIDTH), np.uint8)
    base = np.cumsum(size) - size
    after_width, before_width = -(-WIDTH // 8) * 8, -(-_SPAN // 8) * 8
    column, place = np.arange(after_width, dtype=np.int32), (base + anchor).astype(np.int32)[:, None]
    after = flat[np.minimum(place + column, len(flat) - 1, dtype=np.int32)]
    after[column[None, :] >= (size - anchor)[:, None]] = 0
    column = np.arange(before_width, dtype=np.int32)
    before = flat[np.maximum(place - 1 - column, 0, dtype=np.int32)]
    before[column[None, :] >= anchor[:, None]] = 0
    after_order, after_prefix = _refine(after, block)
    before_order, before_prefix = _refine(before, block)
    windows = size - WIDTH + 1  # starts 0 .. windows - 1; a start s lies anchor - s before the anchor
    found = np.zeros((n, int(windows.max())), bool)
    after_block, before_block = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(anchor.max()) + 1):
        rows = np.flatnonzero((anchor >= o) & (anchor - o < windows))
        if len(rows) < 2:
            continue
        after_block[after_order] = np.cumsum(after_prefix < WIDTH - o)
        before_block[before_order] = np.cumsum(before_prefix < o)
        key = after_block[rows] * (n + 1) + before_block[rows]
        again = np.ones(len(rows), bool)
        again[np.unique(key, return_index=True)[1]] = False
        found[rows[again], (anchor[rows] - o)[again]] = True
    return found


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of true cells."""
    padded = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - 1


def _resolved(columns: dict[str, np.ndarray], data: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
    """Merges rows sorted by hash and corpus order: (found ranges as columns), rows that go on, and what of them."""
    found = merge(columns["hash"], columns["pos"] - columns["lo"], data)
    row, first, last = _runs(found)
    ranges = [columns["doc_id"][row], columns["tie"][row], columns["lo"][row] + first, columns["lo"][row] + last + WIDTH]
    open_ = np.arange(found.shape[1])[None, :] < np.fromiter(map(len, data), np.int64, len(data))[:, None] - WIDTH + 1
    open_ &= ~found
    return ranges, open_.any(axis=1), open_


_NULL_ID = np.iinfo(np.int64).min


def _union(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Ranges (doc_id, tie, start, end) with those that overlap or touch put together."""
    doc_id, tie, start, end = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, tie, doc_id))
    doc_id, tie, start, end = doc_id[order], tie[order], start[order], end[order]
    other = np.ones(len(start), bool)
    other[1:] = (doc_id[1:] != doc_id[:-1]) | (tie[1:] != tie[:-1])
    document, reach = np.cumsum(other), int(end.max()) + 1
    furthest = np.maximum.accumulate(document * reach + end) - document * reach
    new = other.copy()
    new[1:] |= start[1:] > furthest[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return [doc_id[first], tie[first], start[first], furthest[last]]


def _shard(repeated: HashSet, texts: list[bytes], doc_ids: np.ndarray, ties: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: ranges that it settles (no data), and anchors for the merge."""
    some: list[tuple[np.ndarray, ...]] = []
    pieces: list[bytes] = []
    for value, text, place, first, last in _all_anchors(texts):
        keep = np.flatnonzero(repeated.holds(value))
        some.append(tuple(x[keep] for x in (value.view(np.int64), text, place, first)))
        pieces += [texts[t][s:e] for t, s, e in zip(text[keep].tolist(), first[keep].tolist(), (last[keep] + WIDTH).tolist())]
    if not pieces:
        return
    value, text, place, first = (np.concatenate(x) for x in zip(*some))
    order = np.lexsort((first, place, ties[text], doc_ids[text], value))
    columns = {"hash": value[order], "doc_id": doc_ids[text[order]], "tie": ties[text[order]], "pos": place[order], "lo": first[order]}
    pieces = [pieces[i] for i in order.tolist()]
    columns, pieces = _once(columns, pieces)
    settled: list[list[np.ndarray]] = []
    for begin, end in _blocks(columns["hash"]):
        part = {k: v[begin:end] for k, v in columns.items()}
        ranges, going, open_ = _resolved(part, pieces[begin:end])
        if len(ranges[0]):
            settled.append(ranges)
        rows = np.flatnonzero(going)
        if len(rows):
            left = open_[rows].argmax(axis=1)
            right = open_.shape[1] - 1 - open_[rows][:, ::-1].argmax(axis=1)
            cut = [pieces[begin + r][a:b + WIDTH] for r, a, b in zip(rows.tolist(), left.tolist(), right.tolist())]
            yield pa.RecordBatch.from_arrays([*(pa.array(part[c][rows]) for c in ("hash", "doc_id", "tie", "pos")),
                                              pa.array(part["lo"][rows] + left), pa.array(cut, pa.binary())], schema=_SCHEMA)
    if settled:
        # any task may carry these on
        ranges = _union(settled)
        yield pa.RecordBatch.from_arrays([pa.array(ranges[0] * 31 + ranges[2]), *(pa.array(r) for r in ranges), pa.nulls(len(ranges[0]), pa.binary())], schema=_SCHEMA)


def _once(columns: dict[str, np.ndarray], pieces: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """Sorted rows without those of a repeated document.

    Of two that differ in what their shards have settled, either is enough: the other's shard, or
    its own, has settled the rest.
    """
    new = np.ones(len(pieces), bool)
    keys = [*(columns[c] for c in ("hash", "doc_id", "tie", "pos")), columns["lo"] // SLICE]
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return (columns, pieces) if new.all() else ({k: v[new] for k, v in columns.items()}, [p for p, k in zip(pieces, new.tolist()) if k])


def _blocks(block: np.ndarray, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Cuts sorted rows between blocks into parts of about ``MERGE_ROWS``."""
    rows, begin = rows or MERGE_ROWS, 0
    while begin < len(block):
        end = min(len(block), begin + rows)
        if end < len(block):
            end = int(np.searchsorted(block, block[end - 1], side="right"))
        yield begin, end
        begin = end


def _texts(batch: pa.RecordBatch, shard_bytes: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """A batch in shards of about so many bytes."""
    ids = np.array([_NULL_ID if i is None else i for i in batch["doc_id"].to_pylist()], np.int64)
    ties = batch["tie"].to_numpy(zero_copy_only=False)
    held, size, begin = [], 0, 0
    for at in range(len(batch)):
        held.append(batch["text"][at].as_py() or b"")
        size += len(held[-1])
        if size >= shard_bytes or at == len(batch) - 1:
            yield held, ids[begin:at + 1], ties[begin:at + 1]
            held, size, begin = [], 0, at + 1


def ranges(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, tie, start, end): byte ranges of texts whose windows all start earlier elsewhere; they may overlap."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, _, _ in _texts(batch, shard_bytes):
                found = [np.zeros(0, np.uint64), *(a[0] for a in _all_anchors(texts))]
                value, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times > 1)], names=["hash", "again"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, ids, ties in _texts(batch, shard_bytes):
                yield from _shard(repeated, texts, ids, ties)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tie", "start", "end"]

        def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = {c: rows[c].to_numpy() for c in ("hash", "doc_id", "tie", "pos", "lo")}
            columns, pieces = _once(columns, rows["data"].to_pylist())
            size = np.unique(columns["hash"], return_counts=True)[1]
            shared = np.repeat(size > 1, size)
            if shared.any():
                columns = {c: v[shared] for c, v in columns.items()}
                found, _, _ = _resolved(columns, [p for p, k in zip(pieces, shared.tolist()) if k])
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in found], names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            settled = batch["data"].is_null()
            if settled.true_count:
                rows = batch.filter(settled)
                yield pa.RecordBatch.from_arrays([rows[c] for c in ("doc_id", "tie", "pos", "lo")], names=names)
                batch = batch.filter(batch["data"].is_valid())
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) >= MERGE_ROWS:
                rows = pa.Table.from_batches(held)
                block = rows["hash"].to_numpy()
                last = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if last:
                    yield from close(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield from close(pa.Table.from_batches(held))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    twice = (rows.mapInArrow(hashes, "hash long, again boolean").groupBy("hash")
             .agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("hash"))
    repeated = hash_set(stored(twice))
    sent = rows.mapInArrow(shards, _ROW).repartition(partitions(documents.sparkSession), "hash")
    order = sent.sortWithinPartitions("hash", "doc_id", "tie", "pos", "lo")
    return order.mapInArrow(merged, "doc_id long, tie long, start long, end long")


def remove_repeats(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left)."""
    cover = (ranges(documents, shard_bytes).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("found"))
             .select(F.when(F.col("doc_id") != int(_NULL_ID), F.col("doc_id")).alias("found_id"), F.col("tie").alias("found_tie"), "found"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(cover, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("tie") == F.col("found_tie")), "left").select(
        "doc_id", "text", F.col("found.start").alias("start"), F.col("found.end").alias("end"))
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, start, end in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "start", "end"))):
                kept, removed, spans, at = [], 0, 0, 0
                text, reach = text or b"", -1
                for s, e in sorted(zip(start or [], end or [])):
                    if s > reach:
                        kept.append(text[at:s])
                        spans += 1
                        reach = at = s
                    if e > reach:
                        removed += e - max(reach, s)
                        reach = at = e
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((doc_id, len(text), removed, spans, hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)] if out else [pa.array([], k) for k in kinds.types], schema=kinds)

    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
