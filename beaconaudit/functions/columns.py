"""Text helpers as Columns, for the few places that take a Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from beaconaudit.functions.text import BLANKS


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def not_blank(col: Column) -> Column:
    return F.when(col != "", col)
