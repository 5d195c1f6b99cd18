"""A trie of conversations' prefixes, built as a distributed burst trie.

A turn is named by 128 bits of the SHA-256 of its role and text, a conversation is the string of its
turns' names. Conversations that are equal turn by turn become one record with a count, so a
conversation that a third of all rows repeat is one record, too. Records lie in containers under
trie heads, at first all under the root. A container with more than ``CONTAINER`` records bursts: the
prefix that all of its records share becomes a path of trie nodes, and the records go on in containers by
the turn id that follows it. What is left are containers that fit a task; there each is sorted and swept
once into its nodes. A container's head hands its sums to the head it burst from, burst by burst up to the root.

The digest of the conversations that end at a node is a SHA-256 over all of them in order. Ids are
put together in chunks by range first, so only one short row per chunk reaches the hashing task.

Defined results: turns are in order of their number, nulls first, and turns of one number in order of
their names (SHA-256 of role and text); null roles and texts are empty; rows without a conv_id belong to
no conversation; repeated rows are turns as often as they come; an empty table has no nodes, not even the
root. Only conv_id, turn, role and text are read, so other columns cannot clash. A conversation's turn names
stand in one row, 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconaudit.llm.common import partitions
from beaconaudit.operators.joins import attach
from beaconaudit.operators.store import stored

#: Records that a container may hold; one with more bursts.
CONTAINER = 4096
#: Conversation ids in a chunk that is hashed in one go.
CHUNK = 4096
_NAME = 16
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = tuple(c.split(" ")[0] for c in _NODE.split(", "))
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, turns): every conversation's turns in order, as (turn, name in hex, bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _NAME))
    turns = rows.where("conv_id IS NOT NULL").select(
        *(F.col(k) for k in keys), F.struct(F.col("turn").cast("long").alias("turn"), name.alias("name"),
                                            F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return turns.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, longest: int = 9) -> DataFrame:
    """(conv_id, names, sizes): conversation c with the first h turns of conversation c - c % family before its own after the h-th.

    h is the unsigned CRC-32 of c in decimal, modulo ``longest``. The names of turns stand one after the other.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("base", base)
    # one shuffle: by family, which the grouping by conversation and the window below both keep
    own = turns_of(rows.repartition(partitions(rows.sparkSession), "base"), "base", "conv_id")
    of_base = F.max(F.when(F.col("conv_id") == F.col("base"), F.col("turns"))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    own = own.withColumn("of_base", F.coalesce(of_base, F.array().cast(own.schema["turns"].dataType))).withColumn("h", h)
    every = F.concat(F.slice("of_base", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return sequences(own.select("conv_id", every.alias("turns")))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, names, sizes) of (conv_id, turns)."""
    names = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), ""))
    return conversations.select("conv_id", names.alias("names"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (names, conv_id) to (names, first, ids): decimal ids joined by commas, CHUNK at most."""
    at, first, ids = None, 0, []

    def chunk():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])],
                                          names=["names", "first", "ids"])

    for batch in batches:
        for key, conv in zip(batch["names"].to_pylist(), batch["conv_id"].to_pylist()):
            if key != at or len(ids) == CHUNK:
                if ids:
                    yield chunk()
                at, first, ids = key, conv, []
            ids.append(str(conv))
    if ids:
        yield chunk()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to (names, ends): the SHA-256 of each key's ids."""
    at, running, keys, found = None, None, [], []
    for batch in batches:
        for key, ids in zip(batch["names"].to_pylist(), batch["ids"].to_pylist()):
            if key != at:
                if running:
                    keys.append(at)
                    found.append(running.hexdigest())
                at, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if len(keys) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found)], names=["names", "ends"])
            keys, found = [], []
    if running:
        keys.append(at)
        found.append(running.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["names", "ends"])


def records(conversations: DataFrame) -> DataFrame:
    """(names, sizes, conv, n, ends): one row per distinct sequence, with its smallest conversation, their number and their digest."""
    rows = conversations.withColumn("id", F.unhex(F.sha2("names", 256)))
    rows = stored(rows)
    groups = rows.groupBy("id").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("names").alias("names"),
                                    F.first("sizes").alias("sizes"))
    groups = stored(groups)
    width = partitions(rows.sparkSession)
    several = attach(rows.select("id", "conv_id"), groups.where("n > 1").select("id"), "id", ("conv_id",), "inner")
    several = several.select(F.col("id").alias("names"), "conv_id")
    chunks = several.repartitionByRange(width, "names", "conv_id").sortWithinPartitions("names", "conv_id").mapInArrow(
        _chunks, "names binary, first long, ids string")
    digests = chunks.repartition(width, "names").sortWithinPartitions("names", "first").mapInArrow(_digests, "names binary, ends string")
    one = F.sha2(F.col("conv").cast("string"), 256)
    joined = groups.join(digests.withColumnRenamed("names", "id"), "id", "left")  # both sides have an id once
    return joined.select("names", "sizes", "conv", "n", F.coalesce("ends", one).alias("ends"))


def _shared(low: bytes, high: bytes) -> int:
    """Turns that two strings of turn names begin with alike."""
    return len(os.path.commonprefix([low, high])) // _NAME


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to every burst container how many turns all its records share."""
    for batch in batches:
        low, high = (batch[c].to_pylist() for c in ("least", "high"))
        shared = pa.array([_shared(a, b) for a, b in zip(low, high)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, shared], names=[*batch.schema.names, "shared"])


def burst(rows: DataFrame, limit: int = CONTAINER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Containers of at most ``limit`` records, and the heads that burst, level by level.

    A container's rows have its head (a digest of the prefix), the head's depth, and head and smallest conversation of
    the container that burst into it (null for the root).
    """
    rows = rows.select(F.unhex(F.lit("")).alias("head"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("up"),
                       F.lit(None).cast("long").alias("up_conv"), "*")
    settled, heads = [], []
    while True:
        rows = stored(rows)
        large = stored(rows.groupBy("head").agg(F.count("*").alias("held")).where(F.col("held") > limit).select("head"))
        if large.isEmpty():
            return [*settled, rows], heads
        marked = attach(rows, large.withColumn("bursts", F.lit(True)), "head", ("names",))
        settled.append(marked.where("bursts IS NULL").drop("bursts"))
        bursting = marked.where("bursts").drop("bursts")
        found = bursting.groupBy("head").agg(
            F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("up_conv").alias("up_conv"), F.min("conv").alias("conv"),
            F.sum("n").alias("n"), F.min(F.struct("names", "sizes", "ends")).alias("low"), F.max("names").alias("high"))
        found = found.select("head", "depth", "up", "up_conv", "conv", "n", F.col("low.names").alias("least"), F.col("low.sizes").alias("sizes"),
                             F.col("low.ends").alias("ends"), "high")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
        level = stored(found.mapInArrow(_paths, f"{kinds}, shared long"))
        heads.append(level)
        facts = level.select("head", "shared", F.col("conv").alias("head_conv"))
        inside = attach(bursting, facts, "head", ("names",), "inner").where(F.octet_length("names") > _NAME * F.col("shared"))
        prefix = F.substring("names", F.lit(1), (_NAME * (F.col("shared") + 1)).cast("int"))
        rows = inside.select(F.unhex(F.sha2(prefix, 256)).alias("head"), (F.col("shared") + 1).alias("depth"), F.col("head").alias("up"),
                             F.col("head_conv").alias("up_conv"), "names", "sizes", "conv", "n", "ends")


class _Container:
    """Sweeps the sorted records of one container into nodes."""

    def __init__(self, depth: int, up: bytes | None, up_conv: int | None) -> None:
        self.depth, self.up, self.up_conv = depth, up, up_conv
        self.names: bytes | None = None
        # open nodes from the head down: [depth, smallest member, members, leaves, saved, bytes, digest of ends, finished children]
        self.open: list[list] = []
        self.done: list[tuple] = []

    def _close(self) -> None:
        depth, conv, n, leaves, saved, size, ends, children = self.open.pop()
        leaves, saved = leaves if children else 1, saved + (n - 1) * size
        self.done += [(c, depth + 1, conv, *rest, None) for c, *rest in children]
        node = (conv, n, len(children), leaves, saved, ends)
        if not self.open:
            self.done.append((conv, depth, self.up_conv, *node[1:], self.up))
            return
        above = self.open[-1]
        above[1], above[2] = min(above[1], conv), above[2] + n
        above[3], above[4] = above[3] + leaves, above[4] + saved
        above[7].append(node)

    def add(self, names: bytes, sizes: list[int], conv: int, n: int, ends: str) -> None:
        keep = self.depth if self.names is None else max(self.depth, _shared(self.names, names))
        while self.open and self.open[-1][0] > keep:
            self._close()
        last = len(names) // _NAME
        for depth in range(keep + 1 if self.open else self.depth, last + 1):
            self.open.append([depth, conv, 0, 0, 0, sizes[depth - 1] if depth else 0, NO_ENDS, []])
        # records are distinct and sorted, so none ends at a node that was open before
        end = self.open[-1]
        end[1], end[2], end[6] = min(end[1], conv), end[2] + n, ends
        self.names = names

    def finish(self) -> list[tuple]:
        while self.open:
            self._close()
        return self.done


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted containers to nodes; a container's head says from which head it burst."""
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]

    def table(nodes: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nodes), kinds)], names=[*NODE_COLUMNS, "up"])

    at, container, nodes = None, None, []
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("head", "depth", "up", "up_conv", "names", "sizes", "conv", "n", "ends"))
        for head, depth, up, up_conv, *record in zip(*columns):
            if container is None or head != at:
                if container:
                    nodes += container.finish()
                at, container = head, _Container(depth, up, up_conv)
                if len(nodes) > 20_000:
                    yield table(nodes)
                    nodes = []
            container.add(*record)
    if container:
        nodes += container.finish()
    if nodes:
        yield table(nodes)


def _head_nodes(level: DataFrame, sums: DataFrame) -> DataFrame:
    """Nodes of the paths that containers burst along, given what hangs below each path's end."""
    joined = level.join(sums, F.col("head") == F.col("below"))  # a head has one row on both sides, and something below it
    each = joined.withColumn("at", F.explode(F.sequence("depth", "shared")))
    last, top = F.col("at") == F.col("shared"), F.col("at") == F.col("depth")
    first = F.greatest(F.col("at"), F.lit(1)).cast("int")
    path = F.slice("sizes", first, (F.col("shared") - first + 1).cast("int"))
    saved = F.col("below_saved") + (F.col("n") - 1) * F.aggregate(path, F.lit(0).cast("long"), lambda s, x: s + x)
    ends = F.when(last & (F.octet_length("least") == _NAME * F.col("shared")), F.col("ends")).otherwise(NO_ENDS)
    return each.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(top, F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("below_leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), ends.alias("ends_sha256"), F.when(top, F.col("up")).alias("up"))


def _below(tops: DataFrame) -> DataFrame:
    return tops.where("up IS NOT NULL").groupBy(F.col("up").alias("below")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))


def build(conversations: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """Every node of the trie over (conv_id, names, sizes), as ``NODE_COLUMNS``.

    conv_id is the smallest member; saved_tokens sums, over the node's subtree, the bytes of each node's turn times
    its members but one: what a cache of shared prefixes need not read again.
    """
    containers, heads = burst(records(conversations), limit)
    rows = containers[0]
    for more in containers[1:]:
        rows = rows.unionByName(more)
    width = partitions(conversations.sparkSession)
    swept = stored(rows.repartition(width, "head").sortWithinPartitions("head", "names").mapInArrow(_sweep, f"{_NODE}, up binary"))
    parts, sums = [swept], _below(swept) if heads else None
    for level in reversed(heads):
        # heads are at most one in ``limit`` of the records; a level's sums are whole once all levels below it are
        nodes = stored(_head_nodes(level, sums))
        parts.append(nodes)
        sums = _below(swept.select("up", "n_leaves", "saved_tokens").unionByName(nodes.select("up", "n_leaves", "saved_tokens"))) if level is not heads[0] else None
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.select(*NODE_COLUMNS)


#: CRC-32 of decimal text, by its rule, then all prefixes by digest; sums go from every node to its ancestors.
ORACLE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i, d, b FROM (
    SELECT conv_id, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS d,
           CAST(strlen(coalesce(text, '')) AS BIGINT) AS b FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
        xor(list_reduce(range(8 * length(CAST(conv_id AS VARCHAR))), lambda s, x:
          xor((CASE WHEN x % 8 = 0 THEN xor(s, CAST(ascii(substr(CAST(conv_id AS VARCHAR), x // 8 + 1, 1)) AS BIGINT)) ELSE s END) >> 1,
              3988292384 * ((CASE WHEN x % 8 = 0 THEN xor(s, CAST(ascii(substr(CAST(conv_id AS VARCHAR), x // 8 + 1, 1)) AS BIGINT)) ELSE s END) & 1)),
          CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, d, b FROM c JOIN t ON t.conv_id = c.base WHERE i <= h AND c.base <> c.conv_id
      UNION ALL SELECT c.conv_id, i, d, b FROM c JOIN t ON t.conv_id = c.conv_id WHERE i > h OR c.base = c.conv_id),
s AS (SELECT conv_id, list(d ORDER BY i) AS ds, list(b ORDER BY i) AS bs FROM r GROUP BY conv_id),
m AS (SELECT conv_id, coalesce(ds, []) AS ds, coalesce(bs, []) AS bs FROM (SELECT conv_id FROM c) LEFT JOIN s USING (conv_id)),
p AS (SELECT conv_id, depth, len(ds) AS n, md5(array_to_string(ds[1:depth], '')) AS node,
             CASE WHEN depth > 0 THEN md5(array_to_string(ds[1:depth - 1], '')) END AS up, CASE WHEN depth > 0 THEN bs[depth] ELSE 0 END AS b
      FROM (SELECT conv_id, ds, bs, unnest(range(len(ds) + 1)) AS depth FROM m)),
g AS (SELECT node, depth, up, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b,
             sha256(coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM p GROUP BY node, depth, up),
k AS (SELECT g.*, (SELECT count(*) FROM g AS x WHERE x.up = g.node AND x.depth = g.depth + 1) AS n_children FROM g),
a AS (SELECT above.node, above.depth, CAST(sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
             CAST(sum((k.n_convs - 1) * k.b) AS BIGINT) AS saved_tokens
      FROM k JOIN p AS above ON above.conv_id = k.conv_id AND above.depth <= k.depth GROUP BY above.node, above.depth)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, k.n_convs, k.n_children, a.n_leaves, a.saved_tokens, k.ends_sha256
FROM k JOIN a ON a.node = k.node AND a.depth = k.depth LEFT JOIN g AS o ON o.node = k.up AND o.depth = k.depth - 1
"""
