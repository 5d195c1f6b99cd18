"""A set of 64-bit hashes as a bitmap of bounded size, for leaving rows out before they are shuffled.

Membership has false positives and no false negatives, so whoever uses it has to decide exactly
afterwards. The bitmap never exceeds ``MOST_BITS``: beyond that it lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: 64 MB, whatever the number of hashes.
MOST_BITS = 1 << 29
#: Bits per hash below that bound: with three of them set, less than one false positive in 10,000.
BITS_EACH = 64
_CHUNK = 1 << 19
#: A hash's other bits stand in the block of its first; what they are is in its high bits.
_BLOCK = np.uint64((1 << 12) - 1)
_SHIFTS = (np.uint64(34), np.uint64(50))


def _places(hashes: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    """The bits of each hash in turn."""
    at = hashes & np.uint64(bits - 1)
    yield at
    for shift in _SHIFTS[:probes - 1]:
        yield at & ~_BLOCK | hashes >> shift & _BLOCK


class HashSet:
    def __init__(self, shared: Broadcast, bits: int, probes: int) -> None:
        self.shared, self.bits, self.probes = shared, bits, probes

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes (uint64) may be in the set."""
        words, held, left = self.shared.value, np.zeros(len(hashes), bool), np.arange(len(hashes))
        for probe in range(1, self.probes + 1):
            *_, at = _places(hashes[left] if probe > 1 else hashes, self.bits, probe)
            left = left[(words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)]
        held[left] = True
        return held

    def column(self, hashes: Column) -> Column:
        """The same for a column (long, not null)."""
        @F.pandas_udf(T.BooleanType())
        def held(values: pd.Series) -> pd.Series:
            return pd.Series(self.holds(values.to_numpy().view(np.uint64)))

        return held(hashes)


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once: of many values ``np.unique`` makes a hash table, which takes a hundred times as long."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]][:len(values)]]


def seen_twice(hashes: DataFrame, tasks: int) -> DataFrame:
    """The values that a table's only column (long) has in two rows or more.

    Made for rows that writers have reduced to two per value already: most values are single, so
    combining them before the shuffle would cost more than it saves.
    """
    (name,) = hashes.columns

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros(0, np.int64), *(batch.column(0).to_numpy(zero_copy_only=False) for batch in batches)]
        values = np.concatenate(parts)
        values.sort()
        values = distinct(values[1:][values[1:] == values[:-1]])
        for first in range(0, len(values), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(values[first:first + (1 << 20)])], names=[name])

    return hashes.repartition(tasks, name).mapInArrow(twice, f"{name} long")


def twice_at_most(parts: list[np.ndarray]) -> np.ndarray:
    """The values of arrays (uint64) as signed numbers, each once, those that occur again twice."""
    value, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
    return np.concatenate([value, value[times > 1]]).view(np.int64)


#: Parts per task that packed values are dealt to, so that tasks get about the same number of values.
_PARTS_EACH = 8


#: The low bits of a tagged value say whose it is.
_TAG = np.uint64((1 << 16) - 1)


def tagged(value: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Hashes (uint64) whose low bits are those of a tag."""
    return value & ~_TAG | tag & _TAG


def untagged(value: np.ndarray) -> np.ndarray:
    """What hashes are called without regard to their tags: hashes again."""
    h = (value >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def packed(value: np.ndarray, tasks: int, tags: bool = False) -> pa.RecordBatch:
    """Signed numbers (well mixed) as a row per part of them, for ``packed_twice``: rows cost more than what is in them.

    Parts of tagged numbers are below zero.
    """
    parts = tasks * _PARTS_EACH
    part = ((value.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    value, ends = value[order], np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(ends))
    data = [value[ends[i]:ends[i + 1]].tobytes() for i in some.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(~some if tags else some, pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])


#: Values that a task holds before it hands them on, which bounds its memory.
_VALUES = 1 << 21


def packed_in_turn(chunks: Iterator[list[np.ndarray]], tasks: int) -> Iterator[pa.RecordBatch]:
    """Arrays (uint64) of many chunks for ``packed_twice``, a bounded number of values at a time."""
    parts, size = [], 0
    for chunk in chunks:
        parts += chunk
        size += sum(map(len, chunk))
        if size >= _VALUES:
            yield packed(twice_at_most(parts), tasks)
            parts, size = [], 0
    # a value that the task has twice is sent twice: more does not matter
    yield packed(twice_at_most(parts), tasks)


def packed_with_tags(chunks: Iterator[tuple[list[np.ndarray], np.ndarray]], tasks: int) -> Iterator[pa.RecordBatch]:
    """The same for chunks of arrays and, beside them, an array of tagged values."""
    parts, more, size = [], [np.zeros(0, np.uint64)], 0

    def batches() -> Iterator[pa.RecordBatch]:
        yield packed(twice_at_most(parts), tasks)
        yield packed(distinct(np.concatenate(more)).view(np.int64), tasks, tags=True)

    for chunk, with_tags in chunks:
        parts += chunk
        more.append(with_tags)
        size += sum(map(len, chunk)) + len(with_tags)
        if size >= _VALUES:
            yield from batches()
            parts, more, size = [], [np.zeros(0, np.uint64)], 0
    yield from batches()


def packed_twice(parts: DataFrame, name: str, tasks: int) -> DataFrame:
    """The values that rows (part, data) of ``packed`` hold in two rows, or twice in one.

    Tagged values are those that are there with two different tags, and are given as ``untagged`` calls them.
    """
    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a part at a time: rows come sorted
        part, data = None, []
        for batch in batches:
            for one, some in zip(*(batch[c].to_pylist() for c in ("part", "data"))):
                if one != part and data:
                    yield held_twice(data, part < 0)
                    data = []
                part = one
                data.append(some)
        if data:
            yield held_twice(data, part < 0)

    def held_twice(data: list[bytes], tags: bool) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(data), np.uint64).copy()
        values.sort()
        if tags:
            values = values[np.r_[True, values[1:] != values[:-1]]]
            again = values[1:][values[1:] >> np.uint64(16) == values[:-1] >> np.uint64(16)]
            values = untagged(again[np.r_[True, again[1:] >> np.uint64(16) != again[:-1] >> np.uint64(16)][:len(again)]])
        else:
            values = distinct(values[1:][values[1:] == values[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=[name])

    return parts.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(twice, f"{name} long")


def hash_set(hashes: DataFrame) -> HashSet:
    """The set of a table's only column (long, well mixed)."""
    spark, (name,) = hashes.sparkSession, hashes.columns
    count = hashes.count()
    bits = max(_CHUNK, min(MOST_BITS, 1 << (BITS_EACH * max(1, count) - 1).bit_length()))
    # in a set that is full to its bound, more bits a hash would let more through
    probes = max(1, min(1 + len(_SHIFTS), int(0.7 * bits / max(1, count) + 0.5)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.concatenate([*_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits, probes)])
            at.sort()
            chunk = (at // np.uint64(_CHUNK)).astype(np.int64)
            for one in distinct(chunk).tolist():
                first, last = np.searchsorted(chunk, [one, one + 1])
                held = chunks.setdefault(one, np.zeros(_CHUNK, bool))
                held[(at[first:last] % np.uint64(_CHUNK)).astype(np.int64)] = True
        for one, held in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()])], names=["chunk", "data"])

    # all hashes of a chunk meet in one task, so the driver receives each chunk once
    chunk = F.floor(F.col(name).bitwiseAND(F.lit(bits - 1)) / _CHUNK)
    parts = hashes.repartition(max(1, min(bits // _CHUNK, 64)), chunk).mapInArrow(fill, "chunk long, data binary")
    words = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # one job: together they are the bitmap, whose size is bounded
        words[row["chunk"] * (_CHUNK // 8):(row["chunk"] + 1) * (_CHUNK // 8)] = np.frombuffer(row["data"], np.uint8)
    return HashSet(spark.sparkContext.broadcast(words), bits, probes)
