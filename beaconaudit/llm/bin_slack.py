"""Packing of documents into sequences by minimum bin slack.

A document's ids are cut into whole sequences and a rest. Windows are filled one after the other from the
multiset of lengths that remain: the longest goes in first, then a subset-sum program over a bitset (bit s: some
multiset has the sum s) finds the sum closest to the room that is left, and walking back through its steps gives how often each
length is taken. If a slack is left, nothing that remains fits into it, so the longest piece is cut
there and what is over goes back among the remaining lengths. The end of the corpus, shorter than a sequence,
goes into windows of powers of two, which are not padded. So nothing is padded, and only slacks cost cuts.

The plan works on counts by length. A filling is used as often as its lengths last, so the plan
depends on the sequence length and not on the corpus. It gives intervals of ranks: the pieces of a length
are numbered in two levels (length and hash bucket, then sums of buckets), so a length that a third of all pieces
have is no large group. Texts are encoded once. Ids of the rests are stored, and read again only for the pieces that are cut.

Defined results: a null text is empty and has the end id alone; repeated rows are packed as often as
they come; null ids are ids like others; an empty table gives no rows; only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from beaconaudit.llm.common import partitions
from beaconaudit.llm.tokens import VOCABULARY, encoder
from beaconaudit.operators.store import stored

SEQUENCE = 4096
END_ID = 2
#: Cut pieces that are sent to all executors, some 100 bytes each; more are joined by a shuffle.
_FEW_CUTS = 20_000
_RANK_BITS = 38

#: A row of a plan: length, first rank, number of ranks; where in the piece the part begins, its length; first sequence, place there.
PLAN = ("length", "rank", "n", "from", "size", "sequence", "offset")


def closest(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """How often to take each length (longest first in ``lengths``), for the greatest sum within the room."""
    reach, full, steps = 1, 1 << room, []
    mask = (full << 1) - 1
    for length, count in zip(lengths, counts):
        left, times = min(count, room // length), 1
        while left:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, times = left - take, times * 2
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + take
            total -= length * take
    return taken


class _Remaining:
    """Pieces that remain by length, as intervals of ranks: (length of the piece, rank, n, where the rest of it begins)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = {length: int(n) for length, n in enumerate(counts.tolist()) if n and length}
        self.kinds = {length: deque([(length, 0, n, 0)]) for length, n in self.left.items()}

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        found, kinds = [], self.kinds[length]
        self.left[length] -= n
        while n:
            piece, rank, held, begin = kinds.popleft()
            some = min(n, held)
            found.append((piece, rank, some, begin))
            if held > some:
                kinds.appendleft((piece, rank + some, held - some, begin))
            n -= some
        if not self.left[length]:
            del self.left[length], self.kinds[length]
        return found

    def put(self, length: int, kind: tuple[int, int, int, int]) -> None:
        self.left[length] = self.left.get(length, 0) + kind[2]
        self.kinds.setdefault(length, deque()).append(kind)


def plan(counts: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, int]:
    """Rows as ``PLAN`` says for ``counts[length]`` pieces, by length, place in the piece and rank; and the number of sequences."""
    remaining, rows, sequences = _Remaining(counts), [], 0
    tokens = int((counts.astype(object) * np.arange(len(counts))).sum())
    while tokens:
        room = sequence if tokens >= sequence else 1 << tokens.bit_length() - 1
        lengths = sorted((x for x in remaining.left if x <= room), reverse=True)
        taken: dict[int, int] = {}
        if lengths:
            first = lengths[0]
            rest = room - first
            own = remaining.left[first] - 1
            fits = [x for x in lengths if x <= rest and (x != first or own)]
            taken = closest(fits, [own if x == first else remaining.left[x] for x in fits], rest)
            taken[first] = taken.get(first, 0) + 1
        slack = room - sum(length * k for length, k in taken.items())
        times = min((remaining.left[length] // k for length, k in taken.items()), default=tokens // room)
        cut = 0
        if slack:
            cut = max(x for x, n in remaining.left.items() if n > taken.get(x, 0))
            times = min(times, remaining.left[cut] // (taken.get(cut, 0) + 1))
        offset = 0
        for length, k in sorted(taken.items(), reverse=True):
            for _ in range(k):
                at = sequences
                for piece, rank, n, begin in remaining.take(length, times):
                    rows.append((piece, rank, n, begin, length, at, offset))
                    at += n
                offset += length
        if slack:
            at, back = sequences, []
            for piece, rank, n, begin in remaining.take(cut, times):
                rows.append((piece, rank, n, begin, slack, at, offset))
                back.append((piece, rank, n, begin + slack))
                at += n
            for kind in back:
                remaining.put(cut - slack, kind)
        sequences += times
        tokens -= times * room
    table = np.array(rows, np.int64).reshape(-1, len(PLAN))
    return table[np.lexsort((table[:, 1], table[:, 3], table[:, 0]))], sequences


def pieces(documents: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids): whole sequences of every document and its rest; ids of rests only."""
    kind = documents.select("doc_id").schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for row, ids in enumerate(codec.encode(batch["text"])):
                ids[-1] = END_ID  # the encoder ends a document with an id of its own
                raw = ids.astype("<u4").tobytes()
                for start in range(0, len(ids), sequence):
                    length = min(sequence, len(ids) - start)
                    values = (row, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), len(ids),
                              raw[4 * start:4 * (start + length)] if length < sequence else None)
                    for column, value in zip(columns, values):
                        column.append(value)
            of, *rest = columns
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in rest[:4]), pa.array(rest[4], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with their rank among the pieces of their length."""
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid"))
    return rows.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def pack(documents: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset in the sequence."""
    spark = documents.sparkSession
    rows = pieces(documents, sequence, vocabulary).withColumn("uid", F.monotonically_increasing_id())
    buckets = max(256, 4 * partitions(spark))
    rows = stored(rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int")))
    counts = stored(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = np.zeros(sequence + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # one row per length at most
        histogram[length] = n
    layout, _ = plan(histogram, sequence)
    key = (layout[:, 0] * (sequence + 1) + layout[:, 3] << _RANK_BITS) + layout[:, 1]
    kind = dict(rows.dtypes)["doc_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of every piece; one that is cut has no digest yet."""
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            of, begin = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            while len(of):
                at = np.searchsorted(key, (length[of] * (sequence + 1) + begin << _RANK_BITS) + rank[of], side="right") - 1
                found = layout[at]
                size = found[:, 4]
                some = batch.take(pa.array(of))
                whole = pa.array(size == length[of])
                yield pa.RecordBatch.from_arrays(
                    [some["uid"], some["doc_id"], pa.array(some["start"].to_numpy() + begin), pa.array(size),
                     pc.if_else(whole, some["ids_crc32"], None), some["doc_tokens"],
                     pa.array(found[:, 5] + rank[of] - found[:, 1]), pa.array(found[:, 6]), pa.array(begin)],
                    names=["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "begin"])
                more = begin + size < length[of]
                of, begin = of[more], (begin + size)[more]

    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = _ranked(rows.drop("ids"), counts).select("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        place, f"uid long, {out}, begin long")
    names = [c.split(" ")[0] for c in out.split(", ")]
    n_cut = int(layout[(layout[:, 3] == 0) & (layout[:, 4] < layout[:, 0]), 2].sum())
    if not n_cut:
        return placed.select(*names)
    placed = stored(placed)
    cut = placed.where("ids_crc32 IS NULL")
    cut = rows.where("ids IS NOT NULL").select("uid", "ids").join(F.broadcast(cut) if n_cut <= _FEW_CUTS else cut, "uid")
    part = F.substring(F.col("ids"), (F.col("begin") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    cut = cut.withColumn("ids_crc32", F.crc32(part))
    return placed.where("ids_crc32 IS NOT NULL").select(*names).unionByName(cut.select(*names))
