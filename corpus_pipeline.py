"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return
the columns of ``documents``; the last returns the pieces of the packed sequences.

Defined results, for all stages: columns beside doc_id, text, source and n_chars are kept as they are, whatever they
are named; an empty table gives an empty one; rows that repeat an id are documents of their own. A null or empty text
fails the quality rules; the other stages keep it as it is, and packing gives it its end id alone. Documents with a
null id are never removed as near copies; a document without a source is of a source of its own.

A stage's rows are to be written before the next stage is called: the tables it made on its way are removed then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from beaconaudit.llm import fuzzy_lines, mixing, near_texts, packing, quality
from beaconaudit.llm.common import fresh, table
from beaconaudit.operators.store import forget, made, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Paths of the tables that the stage called last made on its way.
_helpers: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """The stage, which first removes the tables of the stage before it, unless its own input still reads them."""
    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _helpers:
            read = {file.rsplit("/", 2)[-2] for file in docs.inputFiles()}
            if not any(path.rsplit("/", 1)[-1] in read for path in _helpers):
                forget(spark, _helpers)
                _helpers.clear()
        before = set(made())
        found = stage(spark, docs, sf_dir)
        _helpers.extend(path for path in made() if path not in before)
        return found

    return tidied


@_tidy
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail, and those of hosts that fail, go."""
    return quality.keep_good(docs)


@_tidy
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of similar lines the earliest stays; ``n_chars`` follows the text."""
    found = fuzzy_lines.dedup_lines(docs).select(*docs.columns)
    return found.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else found


@_tidy
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: of each component of copies and near copies (five words, similarity 0.8) the document with the smallest id stays."""
    return near_texts.keep_first(docs)


@_tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: all documents, in the order of the mix."""
    return mixing.in_mixed_order(docs)


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' token ids packed into sequences, in the order of the mix: that of files and their rows."""
    (position,) = fresh(docs, "position")
    row = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        rows = docs.select("doc_id", "text", *row)
    except AnalysisException:  # not a table of files
        rows = stored(docs).select("doc_id", "text", *row)
    files = rows.groupBy("file").agg((F.max("row") + 1).alias("n"))
    # by the number in a file's name, which is not padded beyond five digits
    number = F.regexp_extract("file", "part-([0-9]+)", 1).try_cast("long")
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(files), "file").select("doc_id", "text", (F.col("base") + F.col("row")).alias(position))
    return packing.pack(rows, order=position)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Similar lines, fingerprints and the program's rounding are beyond SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
