import math
import random

import numpy as np
import pytest

from beaconaudit.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, dims string, tile string, n string, top string"


def plain(rows, threshold=0.98):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    link = np.zeros((n, n), bool)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if sound(a) and sound(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                link[i, j] = link[j, i] = x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold
    names = list(range(n))
    for _ in range(n):
        for i in range(n):
            names[i] = min([names[i], *(names[j] for j in np.flatnonzero(link[i]))])
    ids = [r[0] for r in rows]
    component = [min((ids[j] for j in range(n) if names[j] == names[i] and ids[j] is not None), default=None) for i in range(n)]
    return sorted(str((ids[i], int(link[i].sum()), component[i], ids[i] is not None and ids[i] == component[i])) for i in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * 5) for r in rows], SCHEMA).repartition(4)


def ours(found):
    return sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in found.collect())


@pytest.mark.parametrize("tile", [3, 16, 1024])
def test_against_all_pairs(spark, tile):
    """Chains of neighbours, copies, scaled copies, hot labels, pairs close to the threshold."""
    rng = np.random.default_rng(tile)
    rows = []
    for _ in range(30):
        v = rng.normal(size=12)
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), v.tolist(), int(rng.integers(0, 2) * rng.integers(0, 3))))
            if rng.random() < 0.7:
                v = v + rng.normal(size=12) * 0.18 * np.linalg.norm(v) / math.sqrt(12)
            else:
                v = v * 2
    assert ours(embeddings.near_duplicates(frame(spark, rows), tile=tile)) == plain(rows)


def test_edges(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    rows = [(1, v, 0), (2, v, 0), (3, w, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0),
            (9, [1.0, float("nan"), 3.0], 0), (10, [1.0, float("inf"), 3.0], 0), (None, v, 0), (11, [1.0, 2.0], 0), (12, [], 0), (13, [-1.0, -2.0, -3.0], 0),
            (14, [1.0], 0), (15, [2.0], 0), (16, [1e30, 2e30, 3e30], 0)]
    assert ours(embeddings.near_duplicates(frame(spark, rows))) == plain(rows)
    assert embeddings.near_duplicates(frame(spark, rows).where("1 = 0")).count() == 0
    assert embeddings.near_duplicates(frame(spark, rows).where("vec_id IS NULL")).count() == 1


def test_repeated_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)]
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame(spark, rows)).collect())
    assert found == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_the_leading_axes_carry_most():
    rng = random.Random(1)
    raw = np.array([[rng.gauss(0, 3 / (k + 1)) for k in range(16)] for _ in range(200)])
    unit = embeddings._unit(raw[:, ::-1].copy())
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    turned = unit @ axes
    assert (turned[:, :4] ** 2).sum() > (unit[:, :4] ** 2).sum() * 3


def test_lengths_beyond_the_range_of_squares(spark):
    """Vectors of 1e-170, 1e-310 and 1e200 link like those of 1; the smallest doubles have no digits left to do so."""
    base, turned, other = np.array([1.0, 2.0, 3.0]), np.array([1.0, 2.0, 3.3]), np.array([3.0, -1.0, 0.5])
    rows = [(10 * k + n, (v * scale).tolist(), 0) for k, scale in enumerate((1.0, 1e-170, 1e-305, 1e200)) for n, v in enumerate((base, turned, other))]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {
        10 * k + n: (3, 2) if n == 2 else (7, 0) for k in range(4) for n in range(3)}
    tiny = spark.createDataFrame([(1, [5e-324, 0.0], 0), (2, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    assert [r["n_links"] for r in embeddings.near_duplicates(tiny).collect()] == [1, 1]
