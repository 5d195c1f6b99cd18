"""One way of joining facts to rows that holds when one key owns most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from beaconaudit.operators.store import stored

SALTS = 32


def attach(rows: DataFrame, facts: DataFrame, on: str | tuple[str, ...], spread_by: tuple[str, ...], how: str = "left") -> DataFrame:
    """Joins ``facts`` to ``rows`` on columns both have, in a way that no key is too large for.

    Each fact is copied ``SALTS`` times and the rows of a key are spread over the copies by
    the columns ``spread_by``, which should tell rows apart: a file's path alone would keep
    a hot file together. Where the facts turn out small, Spark broadcasts them by itself.
    """
    keys = [on] if isinstance(on, str) else list(on)
    salted_rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    salted_facts = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_rows.join(salted_facts, [*keys, "__salt"], how).drop("__salt")


def heavy_keys(rows: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """(*keys, salts) of the keys that hold more than a task's share of ``rows``, with the tasks' worth of rows they hold.

    Rows are counted by key with partial sums. Shares add up to one, so there are at most ``tasks`` such keys.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    share = F.greatest(F.col("__total") / tasks, F.lit(1.0))
    held = counts.join(F.broadcast(total), F.col("__n") <= F.col("__total"))  # one row, which all keys meet
    return held.where(F.col("__n") > share).select(*keys, F.ceil(F.col("__n") / share).cast("int").alias("salts"))


def attach_measured(rows: DataFrame, facts: DataFrame, on: str | tuple[str, ...], spread_by: tuple[str, ...], how: str = "left",
                    many: bool = False) -> DataFrame:
    """``attach`` for rows that are stored: only keys that are heavy there are salted, in proportion.

    The facts of other keys are not copied, and a key with a third of the rows fills a third of all tasks, however many those
    are. ``rows`` are read twice, so they should be a table. Facts that are ``many``, as many as the rows, are never broadcast:
    Spark goes by the size of their packed files, and a file of 10 MB may be 1 GB of rows in the driver.
    """
    keys = [on] if isinstance(on, str) else list(on)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = stored(heavy_keys(rows, keys, tasks))  # at most one row per task
    salted_rows = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "__salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread_by), F.col("salts")).cast("int"))).drop("salts")
    salted_facts = facts.join(F.broadcast(heavy), keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    if many:
        salted_facts = salted_facts.hint("merge")
    return salted_rows.join(salted_facts, [*keys, "__salt"], how).drop("__salt")
