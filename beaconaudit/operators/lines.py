"""Lines of a file: splitting, context and snippets. All of it stays inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beaconaudit.functions.columns import strip

CONTEXT = 3


def line_array(content: Column) -> Column:
    """Every line, the empty one after a final line feed included."""
    return F.split(content, "\n", -1)


def context_of(lines: Column, number: Column, context: int = CONTEXT) -> Column:
    """Lines ``number - context`` to ``number + context``, cut at the file's edges."""
    first = F.greatest(number - context, F.lit(1))
    last = F.least(number + context, F.size(lines))
    return F.slice(lines, first, last - first + 1)


def snippet(line: Column) -> Column:
    return strip(line)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line with its 1-based number."""
    rest = [c for c in files.columns if c != "content"]
    rows = files.select(*rest, F.posexplode(line_array(F.col("content"))).alias("pos", "line"))
    return rows.select(*rest, (F.col("pos") + 1).alias("line_number"), "line")
