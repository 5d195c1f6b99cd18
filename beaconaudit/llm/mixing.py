"""Mixing sources to target weights by Pfair scheduling, in SQL functions only.

A source's documents, in an order that a hash gives, are cut into blocks. Source s has a
whole-number share c of a cycle of Q slots, so its weight is c / Q. Its block k is released at slot
floor(k Q / c) and due at ceil((k + 1) Q / c); in each slot the released block that is due
first is taken. After any number of slots every source has had its weight of them to within less
than one block. Windows repeat with the cycle, so one cycle is scheduled (a fold over its slots, one
row of data) and every block finds its slot by arithmetic. When a source has run out, its slots
stay empty and the others go on in their proportions; every document gets a position.

Ranks are counted in two levels (source and hash bucket, then the sums of buckets), so a source that
holds a third of all rows is no large group. The cycle's cost grows with Q times the number of
sources: sources are a mixture's components, some thousands at most, not single web hosts.

Defined results: documents without a source are a source of their own; a null id counts as an id of
its own; rows that repeat an id are mixed one by one in any order; an empty table gives no rows;
only doc_id and source are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconaudit.llm.common import fresh, let, partitions
from beaconaudit.operators.store import stored

#: Documents in a block.
BLOCK = 8
#: Slots of a cycle that the default shares divide among the sources.
CYCLE = 200
#: Slots whose documents are numbered in one group.
_GROUP = 4096


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def square_root_shares(sizes: DataFrame) -> DataFrame:
    """(key, c) of (key, n): weights in proportion to the square root of a source's size, at least one slot."""
    total = sizes.agg(F.sum(F.sqrt("n")).alias("total")).withColumn("all", F.lit(1))
    share = F.greatest(F.lit(1), F.round(F.lit(CYCLE) * F.sqrt("n") / F.col("total")).cast("int"))
    return sizes.withColumn("all", F.lit(1)).join(F.broadcast(total), "all").select("key", share.alias("c"))  # one row


def schedule(shares: DataFrame) -> DataFrame:
    """(key, c, q, slots): the slots of each source's blocks within a cycle of q slots, earliest deadline first."""
    table = shares.agg(F.sort_array(F.collect_list(F.struct("key", "c"))).alias("s"), F.sum("c").cast("int").alias("q"))
    q = F.col("q")

    def step(state: Column, t: Column) -> Column:
        def due(x: Column, i: Column) -> Column:
            k = F.get(state["done"], i)
            released = (k < x["c"]) & (F.floor(k * q / x["c"]) <= t)
            return F.when(released, F.struct(F.ceil((k + 1) * q / x["c"]).alias("due"), i.alias("i")))

        taken = F.array_min(F.filter(F.transform("s", due), lambda x: x.isNotNull()))["i"]
        return let(taken, lambda i: F.struct(
            F.transform(state["done"], lambda k, j: k + F.when(j == i, 1).otherwise(0)).alias("done"),
            F.concat(state["taken"], F.array(i)).alias("taken")))

    start = F.struct(F.transform("s", lambda x: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("taken"))
    folded = table.where("q > 0").withColumn("taken", F.aggregate(F.sequence(F.lit(0), q - 1), start, step, lambda state: state["taken"]))
    one = folded.select("q", "taken", F.posexplode("s").alias("i", "x"))
    slots = F.filter(F.transform("taken", lambda i, t: F.when(i == F.col("i"), t)), lambda t: t.isNotNull())
    return one.select(F.col("x.key").alias("key"), F.col("x.c").alias("c"), "q", slots.alias("slots"))


def mix(documents: DataFrame, shares: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, source, slot of its block, and its position in the mixed corpus, from 0.

    ``shares`` gives whole numbers of slots by source (1 where it names none); without it they
    follow the square root of the sources' sizes.
    """
    rows = documents.select("doc_id", "source", _key(F.col("source")).alias("key"),
                            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    rows = rows.withColumn("bucket", F.substring("h", 1, 3))
    counts = stored(rows.groupBy("key", "bucket").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    sizes = counts.groupBy("key").agg(F.sum("n").alias("n"))
    if shares is None:
        chosen = square_root_shares(sizes)
    else:
        given = F.create_map(*(x for k, v in shares.items() for x in (F.lit(f"={k}"), F.lit(int(v))))) if shares else None
        chosen = sizes.select("key", (F.coalesce(F.element_at(given, F.col("key")), F.lit(1)) if shares else F.lit(1)).alias("c"))
    plan = stored(schedule(chosen))
    inside = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("h", "doc_id"))
    ranked = (rows.withColumn("inside", inside).join(before, ["key", "bucket"])
              .withColumn("rank", F.col("before") + F.col("inside") - 1))
    k = F.floor(F.col("rank") / block)
    placed = ranked.join(plan, "key").select(
        "doc_id", "source", (F.floor(k / F.col("c")) * F.col("q") + F.get("slots", (k % F.col("c")).cast("int"))).alias("slot"),
        (F.col("rank") % block).alias("place"))
    placed = stored(placed.withColumn("group", F.floor(F.col("slot") / _GROUP)))
    groups = placed.groupBy("group").agg(F.count("*").alias("n"))
    done = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row per some ten thousand documents
    groups = groups.select("group", F.coalesce(F.sum("n").over(done), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("slot", "place", "doc_id"))
    return (placed.withColumn("in_group", place).join(groups, "group")
            .select("doc_id", "source", "slot", (F.col("base") + F.col("in_group") - 1).alias("position")))


def in_mixed_order(documents: DataFrame, shares: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """All documents as they are, in the order of the mix over the partitions and files they are written to.

    Rows that repeat an id stand together, at the first position of the id.
    """
    position, name = fresh(documents, "position", "mixed_id")
    places = mix(documents, shares, block).groupBy("doc_id").agg(F.min("position").alias(position)).withColumnRenamed("doc_id", name)
    # places have a row per document: they are merged with the texts at every size, never broadcast
    mixed = documents.join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col(name)))
    return (mixed.repartitionByRange(partitions(documents.sparkSession), position).sortWithinPartitions(position, "doc_id")
            .select(*documents.columns))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT key, count(*) AS n FROM d GROUP BY key),
c AS (SELECT key, greatest(1, CAST(round(200 * sqrt(n) / (SELECT sum(sqrt(n)) FROM n)) AS INT)) AS c FROM n),
s AS (SELECT list(c ORDER BY key) AS cs, list(key ORDER BY key) AS ks, CAST(sum(c) AS INT) AS q FROM c),
edf(t, done, pick) AS (
  SELECT 0, list_transform(cs, lambda x: 0), 0 FROM s
  UNION ALL
  SELECT t + 1, list_transform(done, lambda k, j: k + CASE WHEN j = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, done, CAST(list_min(list_filter(list_transform(done, lambda k, i:
             CASE WHEN k < cs[i] AND (k * q) // cs[i] <= t THEN (((k + 1) * q + cs[i] - 1) // cs[i]) * 1000000 + i END),
             lambda x: x IS NOT NULL)) % 1000000 AS INT) AS p
    FROM edf, s WHERE t < q)),
slots AS (SELECT ks[pick] AS key, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS idx FROM edf, s WHERE t > 0),
r AS (SELECT d.doc_id, d.source, d.key, row_number() OVER (PARTITION BY d.key ORDER BY h, doc_id) - 1 AS rank FROM d),
b AS (SELECT doc_id, source, r.key, rank % 8 AS place, rank // 8 AS k, c FROM r JOIN c ON c.key = r.key),
p AS (SELECT doc_id, source, place, CAST((k // c) * (SELECT q FROM s) + slots.slot AS BIGINT) AS slot
      FROM b JOIN slots ON slots.key = b.key AND slots.idx = k % c)
SELECT doc_id, source, slot, row_number() OVER (ORDER BY slot, place, doc_id) - 1 AS position FROM p
"""
