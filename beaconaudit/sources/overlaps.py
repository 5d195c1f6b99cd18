"""Files that are listed under several scan roots: read and searched once, reported under every root.

Which files those are is found on narrow rows (root, path, digest of the content). Of the roots that hold a
file the shortest one, the outermost, is its reader; the file's rows under the others are left out before detection,
and findings go back to all its roots by a join of findings. A root that lies within another is left out as a
whole, by its name, so contents are joined to a few names and not to paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beaconaudit.operators.joins import attach
from beaconaudit.operators.store import stored


def overlap(paths: DataFrame) -> bool:
    """Whether ``paths(root, path)`` names a path more than once."""
    return not paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def shared_files(rows: DataFrame) -> DataFrame:
    """(path, digest, root, roots) of files in several of ``rows(root, path, digest)``.

    ``root`` is the reader's; ``roots`` has (length, root, n) of all, n being how often the row is given. Its size is
    bounded by the roots that lie within each other.
    """
    each = rows.groupBy("path", "digest", "root").agg(F.count("*").alias("n"))
    roots = F.array_sort(F.collect_list(F.struct(F.length("root").alias("length"), "root", "n")))
    groups = each.groupBy("path", "digest").agg(roots.alias("roots"), F.sum("n").alias("total"))
    return groups.where("total > 1").select("path", "digest", F.get("roots", F.lit(0))["root"].alias("root"), "roots")


def read_once(files: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``files(root, path, ...)`` without what another root reads; ``rows`` are its narrow rows, ``shared`` what is in several."""
    others = shared.select("path", F.col("root").alias("reader"), F.explode("roots").alias("r")).where("r.root != reader")
    others = others.select(F.col("r.root").alias("root"), "path", F.col("r.n").alias("n"))
    all_of = rows.groupBy("root").agg(F.count("*").alias("n"))
    whole = stored(others.groupBy("root").agg(F.sum("n").alias("n")).join(all_of, ["root", "n"]).select("root"))
    single = stored(attach(others.select("root", "path").distinct(), whole.withColumn("whole", F.lit(True)), "root", ("path",))
                    .where("whole IS NULL").select("root", "path"))
    left = files.join(whole, "root", "left_anti")  # one row per root, and Spark knows its size
    return left if single.isEmpty() else left.join(single, ["root", "path"], "left_anti")


def to_all_roots(found: DataFrame, shared: DataFrame) -> DataFrame:
    """Findings of ``found(root, path, digest, line_number, ...)`` under every root that holds their file, as often as it is given."""
    if not shared.where(F.get("roots", F.lit(0))["n"] > 1).isEmpty():
        found = found.dropDuplicates(["root", "path", "digest", "line_number"])  # a line has one finding
    placed = attach(found, shared, ("root", "path", "digest"), spread_by=("line_number",))
    own = F.array(F.col("root"))
    every = F.coalesce(F.flatten(F.transform("roots", lambda r: F.array_repeat(r["root"], r["n"].cast("int")))), own)
    return placed.select(*(F.explode(every).alias("root") if c == "root" else F.col(c) for c in found.columns if c != "digest"))


def digest_of(content: Column) -> Column:
    return F.md5(content.cast("binary"))
