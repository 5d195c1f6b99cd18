"""Embedding near-duplicates by comparing tiles of vectors, leading principal dimensions first.

Vectors of a label are rotated so that the dimensions come in the order of their weight in the whole
table (principal axes about zero, which leave every cosine as it is), and cut into tiles of
neighbours. Two tiles are compared if the boxes around their leading dimensions come near enough.
In a comparison the products of the first dimensions are added up for all pairs at once; what the
other dimensions can still add is at most the product of the two suffix norms, and a pair stops as
soon as that cannot reach the threshold. Pairs that reach the end are decided by their cosine in
double precision over the vectors as given.

Equal vectors of a label are one vector with a weight, and a comparison returns a count per vector
and a spanning forest of its links, so no number of copies or near copies makes rows of pairs.

Defined results: vectors that are null, zero or hold a null or non-finite component, vectors
without label or id, link with nothing; vectors of different length do not link; rows that repeat an
id with other vectors share that id's component, and each has its own vector's links; kept is false
for a null id; an empty table gives no rows; only vec_id, embedding and label are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from beaconaudit.llm.common import partitions
from beaconaudit.llm.components import components
from beaconaudit.operators.store import stored

THRESHOLD = 0.98
#: Vectors in a tile: a comparison holds a matrix of its square.
TILE = 1024
#: Dimensions that make the box around a tile, and that all pairs of two tiles are tried on first.
LEADING = 8
#: Longer vectors keep their own axes (any axes give the right pairs).
MOST_ROTATED = 1024
_SALTS = 8
_SLACK = 1e-9  # of sums in another order


def _clean(embedding: Column) -> Column:
    """The vector in double precision, null if it cannot link."""
    wide = embedding.cast("array<double>")
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0)
    return F.when(sound, wide)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Axes of all vectors of a length, heaviest first: every task adds up its products, 16 tasks add those."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if len(batch):
                unit = _unit(_matrix(batch["v"], dims))
                total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(m) for batch in batches for m in batch["m"].to_pylist()), np.zeros(dims * dims))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    parts = vectors.where(F.size("v") == dims).select("v").mapInArrow(moments, "m binary")
    sums = parts.repartition(16).mapInArrow(added, "m binary").collect()
    moment = sum(np.frombuffer(r["m"]) for r in sums).reshape(dims, dims)
    return np.linalg.eigh(moment)[1][:, ::-1]


def _tiles(vectors: DataFrame, axes: np.ndarray | None, threshold: float, tile: int) -> DataFrame:
    """One row per tile: id, label, dims, the box lo and hi, and the vectors themselves."""
    cell = max(1e-3, float(np.sqrt(max(0.0, 2 - 2 * threshold))))

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch["v"].offsets))
            for dims in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == dims))
                raw = _matrix(rows["v"], dims)
                unit = _unit(raw)
                if axes is not None and len(axes) == dims:
                    unit = unit @ axes
                # by a power of two: digits and cosines stay, and squares stay in the range of doubles
                raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])
                lead = np.pad(unit, ((0, 0), (0, 3)))[:, :3]
                data = np.concatenate([raw, unit], axis=1)
                yield pa.RecordBatch.from_arrays([
                    rows["label"], pa.array(np.full(len(rows), dims, np.int32)), rows["rep"], rows["copies"],
                    pa.array([row.tobytes() for row in data], pa.binary()),
                    *(pa.array(np.floor(lead[:, k] / cell).astype(np.int32)) for k in (0, 1)), pa.array(lead[:, 2])],
                    names=["label", "dims", "rep", "copies", "data", "c0", "c1", "c2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, key, held = TaskContext.get().partitionId(), 0, None, []

        def close() -> pa.RecordBatch:
            dims = key[1]
            data = np.frombuffer(b"".join(d for _, _, d in held)).reshape(-1, 2 * dims)
            lead = data[:, dims:dims + LEADING]
            return pa.RecordBatch.from_pylist([{
                "tile": part << 32 | number, "label": str(key[0]), "dims": dims, "lo": lead.min(axis=0).tolist(), "hi": lead.max(axis=0).tolist(),
                "reps": np.array([r for r, _, _ in held], np.int64).tobytes(), "copies": np.array([c for _, c, _ in held], np.int64).tobytes(),
                "data": data.tobytes()}], schema=schema)

        schema = pa.schema([("tile", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("lo", pa.list_(pa.float64())),
                            ("hi", pa.list_(pa.float64())), ("reps", pa.binary()), ("copies", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            for label, dims, rep, copies, data in zip(*(batch[c].to_pylist() for c in ("label", "dims", "rep", "copies", "data"))):
                if held and (key != (label, dims) or len(held) >= tile):
                    yield close()
                    number, held = number + 1, []
                key = (label, dims)
                held.append((rep, copies, data))
        if held:
            yield close()

    kind = dict(vectors.dtypes)["label"]
    order = ["label", "dims", "c0", "c1", "c2", "rep"]
    spread = stored(vectors.mapInArrow(rotated, f"label {kind}, dims int, rep long, copies long, data binary, c0 int, c1 int, c2 double"))
    ordered = spread.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return stored(ordered.mapInArrow(cut, "tile long, label string, dims int, lo array<double>, hi array<double>, reps binary, copies binary, data binary"))


def _compare(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of ``a``, rows of ``b``) whose cosine reaches the threshold; each pair once if both are one tile."""
    dims = a.shape[1] // 2
    x, y = a[:, dims:], b[:, dims:]
    rest_x, rest_y = (np.sqrt(np.cumsum((z * z)[:, ::-1], axis=1))[:, ::-1] for z in (x, y))  # norms of what is left
    done = min(LEADING, dims)
    partial = x[:, :done] @ y[:, :done].T
    bound = partial + (np.outer(rest_x[:, done], rest_y[:, done]) if done < dims else 0.0)
    near = bound >= threshold - _SLACK
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    found_i, found_j = [], []
    for first in range(0, len(i), 1 << 17):
        p, q = i[first:first + (1 << 17)], j[first:first + (1 << 17)]
        sums, at = partial[p, q], done
        while at < dims and len(p):
            end = min(dims, 2 * at)
            sums = sums + np.einsum("ij,ij->i", x[p, at:end], y[q, at:end])
            left = rest_x[p, end] * rest_y[q, end] if end < dims else 0.0
            go = sums + left >= threshold - _SLACK
            p, q, sums, at = p[go], q[go], sums[go], end
        raw_x, raw_y = a[p, :dims], b[q, :dims]
        norm = np.sqrt(np.einsum("ij,ij->i", raw_x, raw_x)) * np.sqrt(np.einsum("ij,ij->i", raw_y, raw_y))
        go = np.einsum("ij,ij->i", raw_x, raw_y) / norm >= threshold
        found_i.append(p[go])
        found_j.append(q[go])
    return np.concatenate(found_i or [i]), np.concatenate(found_j or [j])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place linked to each of ``n`` places: labels sink along the links and halve their paths."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label != (up := label[label])).any():
            label = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (label, v, rep, copies): (rep, n) links of each to others, and (a, b) a forest of them."""
    lengths = vectors.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    axes = principal_axes(vectors, lengths["dims"]) if lengths and lengths["dims"] <= MOST_ROTATED else None
    tiles = _tiles(vectors, axes, threshold, tile)

    def side(name: str, salt: Column) -> DataFrame:
        return tiles.select("label", "dims", salt.alias("salt"), *(F.col(c).alias(f"{c}_{name}") for c in ("tile", "lo", "hi")))

    gaps = F.zip_with(F.zip_with("lo_a", "hi_b", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0))),
                      F.zip_with("lo_b", "hi_a", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0))), lambda g, h: (g + h) * (g + h))
    near = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g) <= 2 - 2 * threshold + _SLACK
    pairs = stored(side("a", F.pmod(F.xxhash64("tile"), F.lit(_SALTS)))
                   .join(side("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))), ["label", "dims", "salt"])
                   .where((F.col("tile_a") <= F.col("tile_b")) & near).select("tile_a", "tile_b"))

    def contents(name: str) -> DataFrame:
        return tiles.select(*(F.col(c).alias(f"{c}_{name}") for c in ("tile", "reps", "copies", "data")), *(["dims"] if name == "a" else []))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                cell = {c: batch[c][row].as_py() for c in batch.schema.names}
                a, b = (np.frombuffer(cell[f"data_{s}"]).reshape(-1, 2 * cell["dims"]) for s in "ab")
                reps, copies = ([np.frombuffer(cell[f"{c}_{s}"], np.int64) for s in "ab"] for c in ("reps", "copies"))
                same = cell["tile_a"] == cell["tile_b"]
                i, j = _compare(a, b, same, threshold)
                if not len(i):
                    continue
                # places of both tiles in one row; a tile compared with itself is there once
                j = j if same else j + len(a)
                ids = reps[0] if same else np.concatenate(reps)
                weight = copies[0] if same else np.concatenate(copies)
                n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
                label = _forest(i, j, len(ids))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at].astype(np.int64)), pa.array(ids[label[at]])], names=["rep", "n", "root"])

    compared = stored(pairs.join(contents("a"), "tile_a").join(contents("b"), "tile_b")
                      .mapInArrow(compare, "rep long, n long, root long"))
    return (compared.groupBy("rep").agg(F.sum("n").alias("n")),
            compared.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    rows = stored(embeddings.select("vec_id", "label", _clean(F.col("embedding")).alias("v")))
    able = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    vectors = stored(able.groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies")))
    counts, forest = links(vectors, threshold, tile)
    roots = components(forest).withColumnsRenamed({"node": "rep", "root": "top"})
    facts = (vectors.join(counts, "rep", "left").join(roots, "rep", "left")
             .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("top", "rep").alias("component_id")))
    found = able.join(facts, ["label", "v"], "left").select("vec_id", "n_links", "component_id")
    other = rows.where("vec_id IS NULL OR label IS NULL OR v IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return found.unionByName(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
reach AS (WITH RECURSIVE r(x, y) AS (SELECT a, b FROM p UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a) SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN reach ON reach.x = vec_id
"""
