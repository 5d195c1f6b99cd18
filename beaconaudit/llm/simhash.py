"""SimHash near-duplicates, every pair within the radius found by meeting in the middle.

A fingerprint emits all variants within half the radius of it. Two fingerprints within the radius
have a variant in common, and fingerprints that share a variant are within the radius, so a bucket
(all fingerprints of one variant) is a clique: linking its members to its smallest says the same as
all its pairs. Copies are one fingerprint before anything is emitted, so a bucket holds at most one
fingerprint per variant of its own, 65 for radius 2, whatever the corpus repeats.

Defined results: a null text or one without words has fingerprint zero, and zero is linked like any
other; repeated rows are copies; a null id never names a component (null if it has no other); an
empty table gives no rows; only doc_id and text are read, so other columns cannot clash. Texts are
hashed in pieces, so memory does not grow with the number of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconaudit.llm.common import fresh
from beaconaudit.llm.components import components
from beaconaudit.operators.store import stored

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
_PIECE = 50_000


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number."""
    words = text.lower().split()  # of bytes: A-Z alone become lower case, and the six blanks split
    if not words:
        return 0
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for first in range(0, n, _PIECE):
        some = words[first:min(n, first + _PIECE) + k - 1]
        lengths = list(map(len, some))
        ends = list(accumulate(lengths, lambda end, length: end + 1 + length))
        starts = [e - length for e, length in zip(ends, lengths)]
        joined = b" ".join(some)
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1:])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, tie, fp) of every row; tie is a hash that tells texts under one id apart."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array(fps, pa.int64())], names=["doc_id", "tie", "fp"])

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(compute, f"doc_id {kind}, tie long, fp long")


def _masks(bits: int) -> list[int]:
    """All 64-bit patterns with at most so many ones, as signed numbers."""
    patterns = [sum(1 << p for p in places) for k in range(bits + 1) for places in combinations(range(64), k)]
    return [x - (1 << 64) if x >> 63 else x for x in patterns]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that join exactly those within the radius, or a chain of such."""
    if radius % 2:
        raise ValueError("the balls of two fingerprints meet in the middle of an even radius only")
    variant = F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m)) for m in _masks(radius // 2)))).alias("variant")
    emitted = fps.select("fp", variant)
    smallest = F.min("fp").over(Window.partitionBy("variant"))
    return (emitted.select("fp", smallest.alias("a")).where((F.col("a") != F.col("fp")))
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius)
            .select("a", F.col("fp").alias("b")).distinct())


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, tie, fp and component_id, the smallest id among all documents it is linked to."""
    rows = stored(fingerprints(documents))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), radius)).withColumnsRenamed({"node": "fp", "root": "top"})
    top = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("top", "fp").alias("top"))
    names = top.groupBy("top").agg(F.min("first").alias("component_id"))
    named = top.join(names, "top").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "tie", "fp", "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents whose id names their component, as they are, and those without an id.

    Of rows that repeat an id and its text one stays; other texts under one id are other documents.
    """
    tie, gone_id, gone_tie = fresh(documents, "tie", "gone_id", "gone_tie")
    gone = near_duplicates(documents).where("doc_id != component_id").select(F.col("doc_id").alias(gone_id), F.col("tie").alias(gone_tie)).distinct()
    rows = documents.withColumn(tie, F.xxhash64("text"))
    left = rows.join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.col(tie) == F.col(gone_tie)), "left_anti")
    return left.dropDuplicates(["doc_id", tie]).select(*documents.columns)


def hex16(fp: str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
