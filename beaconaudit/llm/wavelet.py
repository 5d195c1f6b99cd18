"""Token ids in files that answer questions: one wavelet matrix per shard.

A shard holds the ids of consecutive documents. Plane by plane, from the highest bit down, it keeps
that bit of every id and reorders the ids stably by it, zeros first. With the number of ones
before any place (counts per 512 bits in the file, ``popcount`` for the rest) the planes give any
token, the number of occurrences of an id before any place, and the place of its k-th occurrence,
without decoding the shard. Planes and document table are compressed each for itself in one file.

``write`` orders documents by id over all shards (nulls first; equal ids by their text), so the ids
of all files one after the other are the corpus. Defined results: a null text is empty and holds
the end id alone; repeated rows are stored as often as they come; an empty table writes no file;
only doc_id and text are read, so other columns cannot clash. A shard is closed once it has
``SHARD_TOKENS``, so memory is bounded by that and the longest text.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from beaconaudit.llm.common import partitions
from beaconaudit.llm.files import write_file
from beaconaudit.llm.tokens import VOCABULARY, encoder
from beaconaudit.operators.store import new_folder, stored

SHARD_TOKENS = 2_000_000
MAGIC = b"WVMX\x01\x00\x00\x00"
SUFFIX = ".wvmx"
_BLOCK = 512


class WaveletMatrix:
    """``planes``: per level, highest bit first, the packed bits (little end first), padded to whole blocks."""

    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.n, self.planes, self.counts = n, planes, counts
        #: ones before each block, and zeros of the whole level
        self.zeros = [n - int(c[-1]) for c in counts]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, counts = [], []
        for level in range(levels - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << level)) != 0
            packed = np.packbits(ones, bitorder="little")
            plane = np.zeros(-(-len(ids) // _BLOCK) * (_BLOCK // 8), np.uint8)
            plane[:len(packed)] = packed
            planes.append(plane)
            counts.append(cls._counts(plane))
            ids = np.concatenate([np.compress(~ones, ids), np.compress(ones, ids)])
        return cls(len(ids), planes, counts)

    @staticmethod
    def _counts(plane: np.ndarray) -> np.ndarray:
        per_block = np.bitwise_count(plane.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)

    def _ones(self, level: int, at: int) -> int:
        """Ones before a place of a level."""
        block, rest = divmod(at, _BLOCK)
        total = int(self.counts[level][block])
        if rest:
            bits = self.planes[level][block * (_BLOCK // 8):][:-(-rest // 8)].copy()
            if rest % 8:
                bits[-1] &= (1 << rest % 8) - 1
            total += int(np.bitwise_count(bits).sum())
        return total

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        found = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[at >> 3]) >> (at & 7) & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            found = found << 1 | bit
        return found

    def _range(self, symbol: int, at: int) -> tuple[int, int]:
        """Where the symbol's occurrences begin below the last level, and where those before ``at`` end."""
        if symbol >> len(self.planes):
            return 0, 0
        begin, end = 0, at
        for level in range(len(self.planes)):
            b, e = self._ones(level, begin), self._ones(level, end)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                begin, end = self.zeros[level] + b, self.zeros[level] + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def rank(self, symbol: int, at: int) -> int:
        """Occurrences of an id before a place."""
        begin, end = self._range(symbol, at)
        return end - begin

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a level."""
        counts = self.counts[level].astype(np.int64)
        before = counts if bit else np.minimum(np.arange(len(counts)) * _BLOCK, self.n) - counts
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (_BLOCK // 8):][:_BLOCK // 8], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id."""
        begin, end = self._range(symbol, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        at = begin + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] * bit)
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids in their order: the levels undone from the last to the first."""
        ids = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for up, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[len(self.planes) - 1 - up]
            earlier = np.empty_like(ids)
            np.place(earlier, ~ones, ids[:zeros])
            np.place(earlier, ones, ids[zeros:] | ids.dtype.type(1 << up))
            ids = earlier
        return ids


class Shard:
    """A file's contents: the matrix, and each document's id and length."""

    def __init__(self, matrix: WaveletMatrix, doc_ids: list[int | None], lengths: np.ndarray, place: dict) -> None:
        self.matrix, self.doc_ids, self.lengths, self.place = matrix, doc_ids, lengths, place

    def to_bytes(self) -> bytes:
        packer = zstandard.ZstdCompressor(level=1)
        sections = [json.dumps(self.doc_ids).encode(), self.lengths.astype("<u8").tobytes()]
        sections += [p.tobytes() for p in self.matrix.planes] + [c.astype("<u4").tobytes() for c in self.matrix.counts]
        packed = [packer.compress(s) for s in sections]
        header = json.dumps(self.place | {"n": self.matrix.n, "levels": len(self.matrix.planes), "sizes": [len(p) for p in packed]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<I", data, 8)
        header, at, sections = json.loads(data[12:12 + size]), 12 + size, []
        unpacker = zstandard.ZstdDecompressor()
        for length in header["sizes"]:
            sections.append(unpacker.decompress(data[at:at + length]))
            at += length
        levels = header["levels"]
        planes = [np.frombuffer(s, np.uint8) for s in sections[2:2 + levels]]
        counts = [np.frombuffer(s, "<u4") for s in sections[2 + levels:]]
        return cls(WaveletMatrix(header["n"], planes, counts), json.loads(sections[0]), np.frombuffer(sections[1], "<u8"), header)


def write(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the corpus into ``folder``; returns the list of files: part, shard, name, n_docs, n_tokens.

    A task's shards have names of their own and the same contents in any attempt.
    """
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = encoder(vocabulary), TaskContext.get().partitionId()
        ids, docs, held, number, start = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            name = f"{part:07d}-{number:07d}{SUFFIX}"
            lengths = np.array([len(x) for x in ids], np.uint64)
            shard = Shard(WaveletMatrix.build(np.concatenate(ids), codec.levels), docs, lengths,
                          {"part": part, "shard": number, "start": start})
            write_file(f"{folder}/{name}", [shard.to_bytes()])
            return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "name": name, "n_docs": len(docs), "n_tokens": held}])

        for batch in batches:
            step = max(1, min(len(batch), 512))
            for first in range(0, len(batch), step):
                rows = batch.slice(first, step)
                for doc_id, tokens in zip(rows["doc_id"].to_pylist(), codec.encode(rows["text"])):
                    ids.append(tokens)
                    docs.append(doc_id)
                    held += len(tokens)
                    if held >= shard_tokens:
                        yield close()
                        ids, docs, held, number, start = [], [], 0, number + 1, start + held
        if docs:
            yield close()

    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = (rows.repartitionByRange(partitions(documents.sparkSession), "doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text"))
    return stored(ordered.mapInArrow(shards, "part long, shard long, name string, n_docs long, n_tokens long"))


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files decide everything but where each part of the corpus begins, which the list of files
    gives: one sum per part, of which there are as many as there were write tasks.
    """
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = Shard.from_bytes(batch["content"][i].as_py())
                ids = shard.matrix.decode().astype("<u4")
                ends = np.cumsum(shard.lengths.astype(np.int64))
                starts = ends - shard.lengths.astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), shard.place["part"])), pa.array(shard.doc_ids, pa.int64()),
                    pa.array(starts + shard.place["start"]), pa.array(ends - starts),
                    pa.array([zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ], names=["part", "doc_id", "inside", "n_tokens", "ids_crc32"])

    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", f"[0-9]*{SUFFIX}").load(folder).select("content")
    rows = blobs.mapInArrow(documents, "part long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return (rows.join(F.broadcast(bases), "part")  # at most one row per write task
            .select("doc_id", (F.col("inside") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(documents: DataFrame) -> DataFrame:
    """Writes the documents to files and describes them from the files alone."""
    folder = new_folder(documents.sparkSession)
    return read(documents.sparkSession, folder, write(documents, folder))
