"""Files to scan: reading, routing by extension, and the filters before detection."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from beaconaudit.functions.globs import ignored
from beaconaudit.functions.text import has_any
from beaconaudit.operators.store import stored
from beaconaudit.rules import FILE_KEYWORDS, LIVE, Rulebook
from beaconaudit.sources import charsets

LISTING = "root string, path string, is_dir boolean, size bigint"
# Bytes of file content one Arrow batch may carry before it is handed on.
READ_BATCH_BYTES = 32 << 20
# Bytes of files one reading task opens, and entries one listing task names, about.
TASK_BYTES = 256 << 20
TASK_ENTRIES = 20_000
# An Arrow cell holds less than this; larger files count as unreadable.
MOST_BYTES = 2**31 - 1


def extension_of(path: Column) -> Column:
    """Last suffix of the file name; '' for none and for names that are nothing but a suffix."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def language_of(path: Column, rulebook: Rulebook = LIVE) -> Column:
    ext = extension_of(path)
    if rulebook.fold_extension:
        ext = F.lower(ext)
    out = None
    for language in rulebook.languages:
        test = ext.isin(*language.extensions)
        out = F.when(test, language.name) if out is None else out.when(test, language.name)
    return out


def route(files: DataFrame, rulebook: Rulebook = LIVE) -> DataFrame:
    """Keeps files some language handles and names it. Runs on the path column alone."""
    return files.withColumn("language", language_of(F.col("path"), rulebook)).where(F.col("language").isNotNull())


def legacy_eligible(path: Column, extensions) -> Column:
    """Older file test: the extension as it is written decides."""
    return extension_of(path).isin(*extensions)


def normalise_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def decoded(files: DataFrame, charset: str | None = None) -> DataFrame:
    """``files`` with ``content`` as a scan reads it: bytes are decoded (``charsets``), and line ends are line feeds.

    ``charset``: a column of ``charsets.with_charset``, where there is one.
    The text comes out of a generator: filters on it stay above and read it, where Spark would otherwise make it
    once for each of them, and all over below a shuffle.
    """
    if dict(files.dtypes)["content"] == "binary":
        files = charsets.decoded(files, charset=charset)
    text = normalise_newlines(F.col("content"))
    return files.select(*(F.explode(F.array(text)).alias(c) if c == "content" else F.col(c) for c in files.columns))


def keyword_filter(files: DataFrame) -> DataFrame:
    """Drops files that mention nothing of the SDKs, before any line is looked at.

    The lower-cased text is bound once for all keywords.
    """
    return files.where(f"exists(array(lower(content)), low -> {has_any('low', FILE_KEYWORDS)})")


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root``; null if it is not below it."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path)))


def not_ignored(rel: Column, globs) -> Column:
    """False for paths any glob covers, and for paths outside the project (null)."""
    covered = ignored(rel, globs)
    return rel.isNotNull() if covered is None else rel.isNotNull() & ~covered


def ignore_filter(files: DataFrame, globs, root: str = "project_path") -> DataFrame:
    return files.where(not_ignored(relative_path(F.col("path"), F.col(root)), globs))


def surely_ignored(globs) -> Column:
    """True where a glob covers ``path`` whether its project is ``root`` or the directory below it.

    It needs no project, so it can stand before anything is read or joined.
    """
    rel = relative_path(F.col("path"), F.col("root"))
    below = F.when(rel.contains("/"), F.regexp_replace(rel, "^[^/]*/", ""))
    return ~(not_ignored(rel, globs) | F.coalesce(not_ignored(below, globs), F.lit(False)))


def eligible(files: DataFrame, globs=(), rulebook: Rulebook = LIVE) -> DataFrame:
    """Files a scan counts: routed to a language and not ignored, whatever they hold."""
    return ignore_filter(route(files, rulebook), globs)


# ------------------------------------------------------------------ directories

def _children(root: str, path: str) -> list[tuple]:
    """Entries of a directory; linked directories are named but not entered."""
    rows = []
    try:
        with os.scandir(path) as entries:
            for e in entries:
                try:
                    is_dir = e.is_dir()
                    rows.append((root, e.path, is_dir, 0 if is_dir else e.stat().st_size, not is_dir or e.is_symlink()))
                except OSError:
                    rows.append((root, e.path, False, 0, True))
    except OSError:
        pass
    return rows


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces unvisited directories by their entries, and goes on with those until the task has named its share."""
    names = ["root", "path", "is_dir", "size", "visited"]
    types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.bool_()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        stack, named, rows = [tuple(r[n] for n in names) for r in batch.to_pylist()], 0, []
        while stack:
            root, path, is_dir, size, visited = entry = stack.pop()
            if visited or named >= TASK_ENTRIES:
                rows.append(entry)
            elif os.path.isdir(path):
                rows.append((root, path, True, 0, True))
                below = _children(root, path)
                named += len(below)
                stack.extend(below)
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def list_tree(spark: SparkSession, roots) -> DataFrame:
    """``root, path, is_dir, size`` of everything below ``roots`` on a mounted file system.

    Spark's file sources leave out names starting with ``_`` or ``.``; this does not.
    A task walks until it has named its share of entries and hands on the directories it
    has not entered; those are spread over tasks anew, until none is left. So neither a deep
    nor a wide tree stays with one task. Missing roots list nothing.
    """
    known = [(r.rstrip("/") or "/", r.rstrip("/") or "/", True, 0, False) for r in roots]
    found = spark.createDataFrame(known, LISTING + ", visited boolean")
    done = []
    while True:
        open_ = found.where("NOT visited")
        if open_.isEmpty():
            break
        found = stored(open_.repartition("path").mapInArrow(_expand, LISTING + ", visited boolean"))
        done.append(found.where("visited"))
    out = spark.createDataFrame([], LISTING)
    for level in done:
        out = out.unionByName(level.drop("visited"))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["root", "path", "content"], [pa.string(), pa.string(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        rows, size = [], 0
        for root, path in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist()):
            try:
                with open(path, "rb") as f:
                    data = f.read(MOST_BYTES + 1)
                data = data if len(data) <= MOST_BYTES else None
            except OSError:
                data = None
            if rows and size + len(data or b"") > READ_BATCH_BYTES:
                yield batch_of(rows)
                rows, size = [], 0
            rows.append((root, path, data))
            size += len(data or b"")
        if rows:
            yield batch_of(rows)


def dealt_by_bytes(listed: DataFrame, task_bytes: int) -> tuple[DataFrame, int]:
    """``listed`` with the ``task`` that opens a file, and the number of tasks: files stand in one row of bytes, cut every ``task_bytes``.

    A file belongs to the task in whose stretch it begins, so no task opens more than its stretch and one file.
    The row is ordered by buckets of a hash, and bytes are added up in two levels, so nothing is summed in one task but one
    row per bucket.
    """
    buckets = 4 * int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.col("size") + F.lit(4096)  # opening a file costs something, too
    rows = listed.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    sums = rows.groupBy("bucket").agg(F.sum(weight).alias("bytes"))
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    before = sums.select("bucket", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("path", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(before, "bucket")
    task = F.floor((F.col("before") + F.col("at")) / task_bytes).cast("int")
    return placed.select(*listed.columns, task.alias("task")), max(1, int(-(-total // task_bytes)))


def read_listed(listed: DataFrame) -> DataFrame:
    """``root, path, content`` of files listed with their ``size``, as bytes; content is null where it cannot be read.

    The number of tasks follows from the listed bytes: a task opens about ``TASK_BYTES``, and
    a failed one reads no more than that again.
    """
    dealt, tasks = dealt_by_bytes(listed.select("root", "path", "size"), TASK_BYTES)
    return dealt.repartitionById(tasks, "task").select("root", "path").mapInArrow(_read, "root string, path string, content binary")


def read_directory(spark: SparkSession, root: str, suffixes=None) -> DataFrame:
    """Files below ``root`` on any file system Spark reads. Skips names starting with ``_`` or ``.``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    return reader.load(root).select("path", "content")
