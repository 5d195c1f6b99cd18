"""Best-fit packing of documents into sequences by a configuration linear program.

A configuration says how many pieces of each length class share a sequence. The program asks for the
least total of configurations that covers the histogram of lengths. It has too many columns to
write down, so multiplicative weights solve it: every class has a price, a knapsack by dynamic
programming finds the configuration of the greatest price, a share of all sequences is given to
it, and the classes it covers become cheaper. Rounding takes whole numbers of the configurations,
fills each with the longest pieces there are of its classes and then with the best fitting of any,
and packs what is left by best fit alone. All of it works on counts by length: a pattern
(lengths in a sequence) is used as often as the counts allow, every pattern but one per
configuration uses a length up, so the plan's size and cost depend on the sequence length, not on
the corpus.

The plan gives every length intervals of ranks: the r-th piece of a length goes to that sequence at
that place. Pieces are ranked in two levels (length and hash bucket, then sums of buckets), so a
length that a third of all pieces have is no large group. Text is read once and never shuffled.

Defined results: a null text is empty and has the end id alone; repeated rows are packed as often as
they come; null ids are ids like others; an empty table gives no rows; only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from beaconaudit.llm.common import tidied
from beaconaudit.llm.tokens import VOCABULARY, encoder
from beaconaudit.operators.store import stored

SEQUENCE = 4096
#: Lengths are priced in this many classes of equal width.
CLASSES = 256
#: Steps of the multiplicative weights, and how far one step moves the prices.
ROUNDS = 1500
RATE = 0.25
_BUCKETS = 256
#: Parts in which the uses of a pattern are dealt out where pieces have an order.
_PARTS = 64

#: A row of a plan: length, first rank, number of ranks, first sequence, place in the sequence.
PLAN = ("length", "rank", "n", "sequence", "offset")


def knapsack(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often each class is taken, at most ``most`` times, for the greatest price within the capacity."""
    value, steps = np.zeros(capacity + 1), []
    for i in np.flatnonzero(prices > 0).tolist():
        left, times = min(int(most[i]), capacity // int(sizes[i])), 1
        while left:
            take = min(times, left)
            size = take * int(sizes[i])
            better = value[:-size] + take * prices[i]
            chosen = better > value[size:]
            value[size:][chosen] = better[chosen]
            steps.append((i, take, size, chosen))
            left, times = left - take, times * 2
    taken, room = np.zeros(len(sizes), np.int64), int(value.argmax())
    for i, take, size, chosen in reversed(steps):
        if room >= size and chosen[room - size]:
            taken[i] += take
            room -= size
    return taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and their amounts, which use no class up beyond its demand.

    The first third of the steps only finds the prices. What the others give to a configuration is
    shared out: it is scaled down by the largest overcover among its classes.
    """
    total = float((sizes * demand).sum()) / capacity
    rounds = max(1, min(rounds, int(total)))
    step = total / rounds
    most = np.maximum(1, np.ceil(2 * demand / max(total, 1.0))).astype(np.int64)
    weight = np.ones(len(sizes))
    found: dict[bytes, tuple[np.ndarray, float]] = {}
    for at in range(rounds + rounds // 2):
        # the price of a piece; its size keeps full configurations ahead of others
        taken = knapsack(sizes, weight * sizes, most, capacity)
        if at >= rounds // 2:
            key = taken.tobytes()
            found[key] = (taken, found.get(key, (taken, 0.0))[1] + step)
        weight *= np.exp(np.clip(-RATE * (taken * total / demand - 1), -4, 4))
        weight = np.clip(weight / np.exp(np.log(weight).mean()), 1e-3, 1e3)
    cover = np.maximum(1.0, sum(taken * amount for taken, amount in found.values()) / demand)
    return [(taken, amount / cover[taken > 0].max()) for taken, amount in found.values()]


class _Counts:
    """Pieces left by length, with the longest not above a bound found in about constant time."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.tolist()
        self._down = list(range(len(self.left)))

    def longest(self, bound: int) -> int:
        """0 if there is none."""
        at = bound
        while at and not self.left[at]:
            self._down[at] = min(self._down[at], at - 1)
            at = self._down[at]
        while bound > at:  # shorten the way for the next time
            self._down[bound], bound = at, self._down[bound]
        return at


def plan(counts: np.ndarray, sequence: int = SEQUENCE, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Rows as ``PLAN`` says for ``counts[length]`` pieces, sorted by length and rank; and the number of sequences."""
    unit = -(-sequence // classes)
    of_class = np.bincount(-(-np.arange(sequence + 1) // unit), counts, -(-sequence // unit) + 1)
    sizes = np.flatnonzero(of_class[1:]) + 1
    solved = configurations(sizes, of_class[sizes], -(-sequence // unit), rounds) if len(sizes) else []
    left, used, rows, sequences = _Counts(counts.astype(np.int64)), [0] * (sequence + 1), [], 0

    def use(wanted: list[int], times: int) -> int:
        """Packs one pattern, ``times`` at most; ``wanted`` bounds its lengths, longest first; the last takes what fits best."""
        nonlocal sequences
        room, pattern, taken = sequence, [], {}
        for bound in [*wanted[:-1], *([sequence] * sequence)]:
            bound = min(bound, room)
            length = left.longest(bound)
            while length and left.left[length] <= taken.get(length, 0):
                length = left.longest(length - 1)
            if length:
                pattern.append(length)
                taken[length] = taken.get(length, 0) + 1
                room -= length
            elif bound == room:
                break
        if not pattern:
            return 0
        times = min(times, *(left.left[length] // k for length, k in taken.items()))
        offset = 0
        for length in pattern:
            rows.append((length, used[length], times, sequences, offset))
            used[length] += times
            left.left[length] -= times
            offset += length
        sequences += times
        return times

    for taken, amount in sorted(solved, key=lambda c: -c[1]):
        wanted = [int(s) * unit for s, k in zip(sizes[::-1], taken[::-1]) for _ in range(k)]
        whole = int(amount)
        while whole:
            done = use(wanted, whole)
            if not done:
                break
            whole -= done
    while left.longest(sequence):
        use([], int(counts.sum()))
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequences


def spread(layout: np.ndarray) -> np.ndarray:
    """The plan with every pattern's uses dealt out evenly over the sequences, so that early ranks of all lengths meet."""
    by = layout[np.lexsort((layout[:, 4], layout[:, 3]))]
    if not len(by):
        return by
    pattern = np.cumsum(np.r_[0, by[1:, 3] != by[:-1, 3]])
    shift, rows = pattern * 37 % _PARTS, []
    for part in range(_PARTS):
        n = (by[:, 2] * (part + 1) + shift) // _PARTS - (by[:, 2] * part + shift) // _PARTS
        rows.append(np.column_stack([by[:, 0], np.full(len(by), part), pattern, n, by[:, 4]])[n > 0])
    length, part, pattern, n, offset = np.concatenate(rows).T
    new = np.r_[True, (part[1:] != part[:-1]) | (pattern[1:] != pattern[:-1])]
    first = (np.cumsum(n[new]) - n[new])[np.cumsum(new) - 1]
    order = np.argsort(length, kind="stable")
    length, n, first, offset = length[order], n[order], first[order], offset[order]
    before = np.cumsum(n) - n
    rank = before - before[np.searchsorted(length, length)]
    return np.column_stack([length, rank, n, first, offset])


def pieces(documents: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, order: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, cut where they exceed a sequence; and ``order``, if named."""
    kind = documents.select("doc_id").schema["doc_id"].dataType.simpleString()

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(codec.encode(batch["text"])):
                raw = ids.astype("<u4").tobytes()
                for number, first in enumerate(range(0, len(ids), sequence)):
                    of.append(row)
                    piece.append(number)
                    start.append(first)
                    length.append(min(sequence, len(ids) - first))
                    crc.append(zlib.crc32(raw[4 * first:4 * (first + sequence)]))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *(batch[c].take(pa.array(of, pa.int64())) for c in more)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", *(["position"] if more else [])])

    more = [order] if order else []
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", position long" if more else "")
    return documents.select("doc_id", "text", *more).mapInArrow(cut, schema)


def pack(documents: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, order: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence.

    With ``order``, a column of positions from 0, pieces of a length are placed by position, and early ones go to early sequences.
    """
    rows = pieces(documents, sequence, vocabulary, order)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(_BUCKETS))
    if order:
        total = (documents.agg(F.max(order)).first()[0] or 0) + 1
        bucket = F.floor(F.col("position") * _BUCKETS / F.lit(total))
    rows = stored(rows.withColumn("bucket", bucket.cast("int")))
    counts = stored(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = np.zeros(sequence + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # one row per length at most
        histogram[length] = n
    layout, _ = plan(histogram, sequence, rounds=rounds)
    if order:
        layout = spread(layout)
    first_of = np.searchsorted(layout[:, 0], np.arange(sequence + 2))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*(["position"] if order else []), "doc_id", "piece", "ids_crc32"))
    ranked = (rows.withColumn("inside", inside).join(before, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(batch), np.int64)
            for one in np.unique(length).tolist():
                mine, first, last = length == one, first_of[one], first_of[one + 1]
                at[mine] = first + np.searchsorted(layout[first:last, 1], rank[mine], side="right") - 1
            found = layout[at]
            yield pa.RecordBatch.from_arrays([
                *(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(rows.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
