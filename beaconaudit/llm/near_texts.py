"""Near copies of whole texts: SimHash balls over five-word shingles, then Jaccard similarity of the texts.

The method of ``simhash``, with parameters of its own for a stage that removes near copies.

A text is written as a string of one character per word (a hash of the word, in lower case for A-Z), so its five-word
shingles are the string's five-character shingles and texts are compared as lines are in ``fuzzy_lines``. Every text has
``TABLES`` independent fingerprints of 32 bits over its distinct shingles. A fingerprint emits all variants within half
the radius; texts within the radius in one table share a variant. Variants are counted over the corpus, and only texts
with a variant seen twice go on. Variants of 32 bits meet by chance, too: of a small bucket only texts go on whose fingerprints of all
tables together are near another's, and only their encoded texts are made and shuffled. In a bucket all pairs that are not connected
already are compared, and linked if their shingles' Jaccard similarity reaches the threshold: fingerprints only find candidates.

A pair at similarity 0.8, 0.85, 0.9 or 0.95 is within the radius in a table or more with probability 0.78, 0.93, 0.99, 0.999.

Defined results: texts without words (null, empty) are copies of each other; a text under five words is one shingle, so
only equal ones are similar; rows that repeat an id and its text are one document, of which one stays; rows with a null
id are removed as such repeats only; an empty table gives no rows; other columns are passed on, whatever they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from beaconaudit.llm.bits import distinct, hash_set, packed_in_turn, packed_twice
from beaconaudit.llm.common import fresh, partitions, tidied
from beaconaudit.llm.fuzzy_lines import joined
from beaconaudit.operators.store import stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Fingerprints of 32 bits per text.
TABLES = 12
#: Differing bits of two fingerprints in a bucket; even, as both sides emit half of it.
RADIUS = 2
#: Tables whose buckets are looked at first; what they connect is not compared again in the others.
FIRST_TABLES = 1
#: Bits of all fingerprints of a text in which similar texts differ at most: at similarity 0.8 they differ in 60 or so (deviation 7),
#: unrelated ones in 192 (deviation 10).
MOST_APART = 32 * TABLES // 3
#: Rows of the largest bucket whose texts are told apart by all their fingerprints, and rows looked at together.
SMALL_BUCKET = 64
BUCKET_ROWS = 50_000
#: Characters of texts handled at once.
CHUNK_CHARS = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: The first of the code points that words are hashed to; from there on all are valid characters.
_FIRST_CODE = 0x10000
_CODES = 0x100000
_VARIANTS = np.array([0, *(1 << p for p in range(32))], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def encoded(text: str) -> str:
    """A text as one character per word."""
    hashed = xxhash.xxh64_intdigest
    return "".join([chr(_FIRST_CODE + hashed(word) % _CODES) for word in text.encode("utf-8", "surrogatepass").lower().split()])


def fingerprints(code: str) -> np.ndarray:
    """The fingerprints (uint64, 32 bits used) of an encoded text, one per table."""
    chars = np.frombuffer(code.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(1, len(chars) - SHINGLE_WORDS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE_WORDS, len(chars))):
        h = _mixed(h + chars[k:k + n])
    h = distinct(h)
    out = []
    for wide in range(TABLES // 2):
        bits = np.unpackbits(_mixed(h + np.uint64(wide + 1)).view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h)).view(np.uint32))
    return np.concatenate(out).astype(np.uint64)


def sketches_of(codes: list[str]) -> np.ndarray:
    """The fingerprints of every text (row)."""
    return np.array([fingerprints(code) for code in codes], np.uint64).reshape(len(codes), TABLES)


def _variants_of(sketches: np.ndarray) -> np.ndarray:
    table = np.arange(TABLES, dtype=np.uint64).reshape(1, TABLES, 1) << np.uint64(32)
    return _mixed((sketches[:, :, None] ^ _VARIANTS) | table).reshape(len(sketches), TABLES * len(_VARIANTS))


def variants(codes: list[str]) -> np.ndarray:
    """Hashes (uint64) of all variants of every text, table after table."""
    return _variants_of(sketches_of(codes))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[int], list[str], list[int]]]:
    """Ids, ties, distinct encoded texts and every row's place in them, for bounded numbers of whole texts."""
    def rows() -> Iterator[tuple[int | None, int, str]]:
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("doc_id", "tie", "text")))

    docs, ties, place, of, size = [], [], {}, [], 0
    for doc_id, tie, text in rows():
        code = encoded(text or "")
        docs.append(doc_id)
        ties.append(tie)
        of.append(place.setdefault(code, len(place)))
        size += len(text or "") + 500
        if size >= CHUNK_CHARS:
            yield docs, ties, list(place), of
            docs, ties, place, of, size = [], [], {}, [], 0
    if docs:
        yield docs, ties, list(place), of


def candidates(documents: DataFrame) -> DataFrame:
    """A narrow row per document that shares a variant: doc_id, tie, id.

    The first of its text in a chunk has a key of its id and tie, all its fingerprints (``sketch``), the variants that are
    shared (``bands``), table after table, and how many of them are of the first tables (``n_first``).
    """
    @tidied
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[list[np.ndarray]]:
            for _, _, codes, of in _chunks(batches):
                value = variants(codes)
                yield [value.ravel(), value[np.bincount(of) > 1].ravel()]

        yield from packed_in_turn(values(), tasks)

    @tidied
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("id", pa.binary()), ("sketch", pa.binary()),
                            ("n_first", pa.int32()), ("bands", pa.list_(pa.int64()))])
        for docs, ties, codes, of in _chunks(batches):
            sketches = sketches_of(codes)
            value = _variants_of(sketches)
            held = repeated.holds(value.ravel()).reshape(value.shape)
            out, seen = [], set()
            for r in np.flatnonzero(held.any(axis=1)[of]).tolist():
                i, more = of[r], (None,) * 3
                if i not in seen:
                    more = (sketches[i].astype(np.uint32).tobytes(), int(held[i][:FIRST_TABLES * len(_VARIANTS)].sum()), value[i][held[i]].view(np.int64))
                seen.add(i)
                out.append((docs[r], ties[r], xxhash.xxh3_128_digest(codes[i].encode()), *more))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)

    rows = _rows(documents)
    tasks = partitions(documents.sparkSession)
    repeated = hash_set(stored(packed_twice(rows.mapInArrow(hashes, "part long, data binary"), "variant", tasks)))
    return stored(rows.mapInArrow(shared, "doc_id long, tie long, id binary, sketch binary, n_first int, bands array<long>"))


def partnered(variant: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Which of the rows, sorted by variant, are not ruled out: another text (``ids``) of the bucket has fingerprints near enough.

    Buckets of more than ``SMALL_BUCKET`` rows are not looked at: chance makes small ones.
    """
    n = len(variant)
    starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows from here to the end of the bucket
    large = np.repeat(sizes > SMALL_BUCKET, sizes)
    keep, rows = large.copy(), np.flatnonzero(~large)
    for step in range(1, min(SMALL_BUCKET, n)):
        rows = rows[left[rows] > step]
        if not len(rows):
            break
        apart = np.bitwise_count(sketch[rows] ^ sketch[rows + step]).sum(axis=1, dtype=np.int64)
        near = rows[(apart <= MOST_APART) & (ids[rows] != ids[rows + step]).any(axis=1)]
        keep[near] = keep[near + step] = True
    return keep


def compared(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(id, text, first, bands) of the texts of ``candidates`` that share a variant with a text whose fingerprints are near in all tables together.

    Most texts share variants by chance only, ever more so in a larger corpus, so narrow rows decide which encoded texts are needed.
    """
    @tidied
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_buckets(some: pa.Table) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(some["id"].to_pylist()), np.uint64).reshape(-1, 2)
            sketch = np.frombuffer(b"".join(some["sketch"].to_pylist()), np.uint64).reshape(len(some), -1)
            kept = some.filter(pa.array(partnered(some["band"].to_numpy(), ids, sketch)))
            return pa.RecordBatch.from_arrays([kept[c].combine_chunks() for c in ("id", "key", "band", "early")], names=["id", "key", "band", "early"])

        # rows come sorted: whole buckets are looked at once there are enough rows
        open_, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            open_.append(batch)
            size += len(batch)
            if size < BUCKET_ROWS:
                continue
            some = pa.Table.from_batches(open_)
            band = some["band"].to_numpy()
            whole = int(np.searchsorted(band, band[-1]))
            if whole:
                yield of_buckets(some.slice(0, whole))
            open_, size = some.slice(whole).to_batches(), 0
        if open_:
            yield of_buckets(pa.Table.from_batches(open_))

    @tidied
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, some, _ in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(code.encode()) for code in some], pa.binary()),
                                              pa.array(some, pa.string())], names=["id", "text"])

    key = F.xxhash64("doc_id", "tie")
    each = found.where("bands IS NOT NULL").select("id", key.alias("key"), "sketch", "n_first", F.posexplode("bands").alias("at", "band"))
    each = each.select("band", "id", "key", "sketch", (F.col("at") < F.col("n_first")).alias("early"))
    each = each.repartition(partitions(documents.sparkSession), "band").sortWithinPartitions("band")
    pairs = each.mapInArrow(near, "id binary, key long, band long, early boolean")
    live = stored(pairs.groupBy("id").agg(F.min("key").alias("key"), F.collect_set(F.when(F.col("early"), F.col("band"))).alias("first"),
                                          F.collect_set("band").alias("bands")))
    wanted = hash_set(live.select("key"))
    texts = _rows(documents).where(wanted.column(key)).mapInArrow(codes, "id binary, text string")
    texts = texts.groupBy("id").agg(F.first("text").alias("text"))
    return stored(live.join(texts, "id").select("id", "text", "first", "bands"))


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")


def named(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tie, n, component_id) of the documents with a copy or near copy, and perhaps some others.

    n is how many rows repeat the id and text; component_id the smallest id of the component, null if it has none.
    """
    found = candidates(documents)
    roots = joined(compared(documents, found), threshold)
    rows = found.groupBy("doc_id", "tie", "id").agg(F.count("*").alias("n"))
    ids = rows.groupBy("id").agg(F.min("doc_id").alias("first"))
    top = stored(ids.join(roots, "id", "left").select("id", "first", F.coalesce("top", "id").alias("top")))
    least = top.groupBy("top").agg(F.min("first").alias("component_id"))
    return rows.join(top.join(least, "top").select("id", "component_id"), "id").select("doc_id", "tie", "n", "component_id")


def keep_first(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that are near copies, by a chain of links, of one with a smaller id."""
    tie, gone_id, gone_tie = fresh(documents, "tie", "gone_id", "gone_tie")
    doc_id = F.col("doc_id").cast("long")
    touched = stored(named(documents, threshold).where("n > 1 OR doc_id != component_id"))
    affected = hash_set(touched.select(F.xxhash64("doc_id", "tie").alias("key")))
    gone = touched.where("doc_id != component_id").select(F.col("doc_id").alias(gone_id), F.col("tie").alias(gone_tie)).distinct()
    # most documents are not touched, which a bitmap tells before any text is shuffled
    rows = documents.withColumn(tie, F.xxhash64("text"))
    maybe = affected.column(F.xxhash64(doc_id, F.col(tie)))
    left = rows.where(maybe).join(gone, (doc_id == F.col(gone_id)) & (F.col(tie) == F.col(gone_tie)), "left_anti")
    left = left.dropDuplicates(["doc_id", tie])
    return rows.where(~maybe).select(*documents.columns).unionByName(left.select(*documents.columns))
