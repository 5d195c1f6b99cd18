"""Findings kept for lookups: laid out by project, with an index of what their texts hold.

``shelve`` writes findings in directories: a shelf per hash of the project's name, and within it parts that are
ranges of project, file and line, so a project that holds most findings fills many parts, and small
projects share a shelf. A directory holds one part, or, where there would be very many, several parts that follow one another.
Beside each finding lies the text it is searched by, and next to them all postings: which three characters in a row
occur in the search text of which part, sorted by them.

``of_project`` reads one shelf. ``search`` reads the postings of its term's trigrams, then only the parts that have
all of them, and there tests the text itself. The rarer the term, the fewer files it reads; terms
under three characters have no trigram and are looked for everywhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from beaconaudit.operators import report
from beaconaudit.operators.store import new_folder, stored
from beaconaudit.sources.projects import count_findings

#: Findings in a part, about.
PART_ROWS = 50_000
#: Most shelves; fewer where there are fewer parts.
SHELVES = 4096
#: Most directories with one part each; beyond, parts share directories of about ``FILE_ROWS`` findings.
MOST_FILES = 512
FILE_ROWS = 50_000
#: Postings in one file, about.
POSTING_ROWS = 2_000_000
#: Parts that are named in a search's plan; a term that more parts hold is looked for in all of them.
MOST_NAMED = 10_000
_GRAM = 3
_POSTINGS = "gram string, shelf int, part long"
_PARTS = 1 << 40
#: Parts are numbered from here on in each directory.
_IN_FILE = 20
_PLACED = ("shelf", "file", "part", "shown")
#: A code point has so many bits.
_BITS = 21


@dataclass
class Shelved:
    """Findings as they lie, with their shelf, directory, part and search text, and the postings (gram, shelf, part)."""

    findings: DataFrame
    postings: DataFrame
    shelves: int

    @property
    def columns(self) -> list[str]:
        return [c for c in self.findings.columns if c not in _PLACED]


def shelf_of(project: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(shelves)).cast("int")


def _keys(texts: pa.Array) -> np.ndarray:
    """The distinct trigrams of some texts, each as one number; none reaches from one text into the next."""
    texts = texts.drop_null()
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < _GRAM:
        return np.zeros(0, np.uint64)
    keys = (points[:-2] << np.uint64(2 * _BITS)) | (points[1:-1] << np.uint64(_BITS)) | points[2:]
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    inside = np.ones(len(points), bool)
    for back in range(1, _GRAM):
        inside[ends[ends >= back] - back] = False
    return np.unique(keys[inside[:len(keys)]])


def _strings(keys: np.ndarray) -> pa.Array:
    """Trigrams as strings."""
    mask = np.uint64((1 << _BITS) - 1)
    points = np.stack([keys >> np.uint64(2 * _BITS), (keys >> np.uint64(_BITS)) & mask, keys & mask], axis=1).astype("<u4")
    size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(size.sum(axis=1))]).astype(np.int32)
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(keys), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, shelf, part) of rows (shelf, part, shown); rows of a part come one after the other."""
    def told(place: tuple[int, int], found: list[np.ndarray]) -> pa.RecordBatch:
        grams = _strings(np.unique(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(grams), place[0], np.int32)), pa.array(np.full(len(grams), place[1], np.int64))],
                                          names=["gram", "shelf", "part"])

    here, found = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        shelf, part = (batch[c].to_numpy(zero_copy_only=False) for c in ("shelf", "part"))
        cuts = np.flatnonzero((np.diff(shelf) != 0) | (np.diff(part) != 0)) + 1
        for first, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            place = int(shelf[first]), int(part[first])
            if found and place != here:
                yield told(here, found)
                found = []
            here = place
            found.append(_keys(batch["shown"].slice(first, end - first)))
    if found:
        yield told(here, found)


def shelve(findings: DataFrame, folder: str | None = None, part_rows: int = PART_ROWS) -> Shelved:
    """Writes ``findings`` and their postings below ``folder`` (a new one in the shared folder unless named)."""
    spark = findings.sparkSession
    folder = folder or new_folder(spark)
    findings = stored(findings)  # counted, sampled for ranges and written
    count = findings.count()
    parts = max(1, -(-count // part_rows))
    shelves = min(SHELVES, 1 << (parts - 1).bit_length())
    files = min(parts, max(MOST_FILES, -(-count // FILE_ROWS)))
    order = ("shelf", "project_name", "file_path", "line_number")
    laid = findings.withColumn("shelf", shelf_of(F.col("project_name"), shelves)).repartitionByRange(files, *order).sortWithinPartitions(*order)
    # rows are numbered as they lie, from 2 ** 33 times their partition on
    row = F.monotonically_increasing_id()
    laid = laid.withColumns({"file": F.shiftright(row, 33), "__row": row.bitwiseAND(F.lit((1 << 33) - 1)), "shown": report.shown_text(findings)})
    laid = laid.withColumn("part", F.shiftleft("file", _IN_FILE) + F.floor(F.col("__row") / part_rows).cast("long")).drop("__row")
    laid.write.partitionBy("shelf", "file").parquet(f"{folder}/findings")
    written = _laid(spark, folder, findings.schema)
    # a part that two tasks read is posted by both: whoever counts its grams counts them once
    grams = stored(written.select("shelf", "part", "shown").mapInArrow(_postings, _POSTINGS))
    files = max(1, -(-grams.count() // POSTING_ROWS))
    grams.repartitionByRange(files, "gram", "shelf", "part").sortWithinPartitions("gram", "shelf", "part").write.parquet(f"{folder}/postings")
    about = spark.range(1).select(F.lit(shelves).alias("shelves"), F.lit(findings.schema.json()).alias("schema"))
    about.write.parquet(f"{folder}/about")
    return _read(spark, folder, shelves, findings.schema)


def _laid(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    placed = StructType([*schema.fields, StructField("shown", StringType()), StructField("part", LongType()),
                         StructField("shelf", IntegerType()), StructField("file", LongType())])
    return spark.read.schema(placed).parquet(f"{folder}/findings")


def _read(spark: SparkSession, folder: str, shelves: int, schema: StructType) -> Shelved:
    return Shelved(_laid(spark, folder, schema), spark.read.schema(_POSTINGS).parquet(f"{folder}/postings"), shelves)


def open_shelves(spark: SparkSession, folder: str) -> Shelved:
    """What ``shelve`` wrote to ``folder``."""
    shelves, schema = spark.read.parquet(f"{folder}/about").select("shelves", "schema").first()
    return _read(spark, folder, shelves, StructType.fromJson(json.loads(schema)))


def of_project(shelved: Shelved, name: str) -> DataFrame:
    """A project's findings; the shelf is known before the plan runs, so only its directories are read."""
    on_shelf = F.col("shelf") == shelf_of(F.lit(name), shelved.shelves)
    return shelved.findings.where(on_shelf & (F.col("project_name") == name)).select(*shelved.columns)


def filter_project(shelved: Shelved, projects: DataFrame, name: str | None):
    """Findings and projects of one name, recounted, as ``report.filter_project``."""
    if not name:
        return shelved.findings.select(*shelved.columns), projects
    kept = of_project(shelved, name)
    return kept, count_findings(projects.where(F.col("name") == name), kept)


def grams_of(term: str) -> list[str]:
    low = term.lower()
    return sorted({low[i:i + _GRAM] for i in range(len(low) - _GRAM + 1)})


def parts_with(shelved: Shelved, term: str) -> DataFrame:
    """(shelf, part) of the parts in which all of the term's trigrams occur; the term needs three characters."""
    grams = grams_of(term)
    hits = shelved.postings.where(F.col("gram").isin(grams)).groupBy("shelf", "part").agg(F.count_distinct("gram").alias("n"))
    return hits.where(F.col("n") == len(grams)).select("shelf", "part")


def candidates(shelved: Shelved, term: str = "", project: str = "") -> DataFrame:
    """Findings of the parts that may hold the term, with their place and search text."""
    rows = shelved.findings
    if project:
        rows = rows.where(F.col("shelf") == shelf_of(F.lit(project), shelved.shelves))
    if len(term) >= _GRAM:
        named = parts_with(shelved, term)
        if project:
            named = named.where(F.col("shelf") == shelf_of(F.lit(project), shelved.shelves))
        found = named.limit(MOST_NAMED + 1).collect()  # of parts, not of findings
        if len(found) <= MOST_NAMED:
            rows = rows.where((F.col("shelf") * F.lit(_PARTS) + F.col("file")).isin(sorted({r["shelf"] * _PARTS + (r["part"] >> _IN_FILE) for r in found})))
            rows = rows.where((F.col("shelf") * F.lit(_PARTS) + F.col("part")).isin([r["shelf"] * _PARTS + r["part"] for r in found]))
    return rows


def search(shelved: Shelved, term: str = "", project: str = "", category: str = "", operation: str = "") -> DataFrame:
    """The rows ``report.search`` gives, from the parts that may hold them."""
    rows = candidates(shelved, term, project)
    return report.search(rows, term, project, category, operation, shown=F.col("shown")).select(*shelved.columns)
