"""Connected components of a table of links, by union-find in tasks and between them.

In a round every task runs union-find over its own links and keeps one link per node, to the
smallest node it found connected. So a node has at most one row per task from then on, however
many links it had, and no group of rows is large. Rows of the same node then agree on the smallest
of its roots; roots that had to give way are the links of the next round, with the nodes that other
rows use as roots. The other nodes are leaves and wait for their root's final answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from beaconaudit.llm.common import partitions
from beaconaudit.operators.store import stored

#: With no more links than this one task ends the work: a constant, whatever the size of the input.
LAST_LINKS = 20_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for first in range(0, len(nodes), 50_000):
        some = nodes[first:first + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([root(x) for x in some], kind)], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two columns of one type) that is not its component's smallest.

    ``root`` is the smallest node reachable. Nulls and links of a node to itself say nothing and are left out.
    """
    a, b = links.columns
    kind = links.dtypes[0][1]
    schema = f"node {kind}, root {kind}"
    links = links.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    links = stored(links)
    leaves: list[DataFrame] = []
    while links.limit(LAST_LINKS + 1).count() > LAST_LINKS:
        # by both ends: the links of one node, however many, are the work of all tasks
        forest = links.repartition(partitions(links.sparkSession), "a", "b").mapInArrow(_local_forest, schema)
        rows = stored(forest.withColumn("least", F.min("root").over(Window.partitionBy("node"))))
        inner = rows.select(F.col("root").alias("node")).distinct().withColumn("inner", F.lit(True))
        own = rows.groupBy("node").agg(F.min("least").alias("least")).join(inner, "node", "left")
        own = stored(own)
        leaves.append(own.where("inner IS NULL").select("node", "least"))
        links = stored(rows.where("root != least").select(F.col("least").alias("a"), F.col("root").alias("b"))
                       .union(own.where("inner").select(F.col("least").alias("a"), F.col("node").alias("b"))).distinct())
    found = links.coalesce(1).mapInArrow(_local_forest, schema).where("node != root")
    for leaf in reversed(leaves):
        found = stored(found)
        above = found.select(F.col("node").alias("least"), F.col("root").alias("top"))
        found = found.unionByName(leaf.join(above, "least", "left").select("node", F.coalesce("top", "least").alias("root")))
    return stored(found)
