import itertools
import random
import zlib

import numpy as np
import pytest

from beaconaudit.llm import packing
from beaconaudit.llm.tokens import END_ID, encoder
from tests.llm.conftest import edge_rows


def test_knapsack_against_all_choices():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(1, 4)
        sizes = np.array(sorted(rng.sample(range(1, 9), n)))
        prices = np.array([rng.random() * 5 for _ in range(n)])
        most = np.array([rng.randint(1, 4) for _ in range(n)])
        capacity = rng.randint(1, 14)
        taken = packing.knapsack(sizes, prices, most, capacity)
        assert (taken * sizes).sum() <= capacity and (taken <= most).all()
        best = max(sum(k * p for k, p in zip(c, prices)) for c in itertools.product(*(range(m + 1) for m in most))
                   if sum(k * s for k, s in zip(c, sizes)) <= capacity)
        assert (taken * prices).sum() == pytest.approx(best)


def histogram(lengths, sequence):
    return np.bincount(lengths, minlength=sequence + 1)


@pytest.mark.parametrize("sequence", [8, 64, 512])
def test_plans_are_gapless_and_close_to_the_bound(sequence):
    rng = np.random.default_rng(sequence)
    lengths = np.minimum(sequence, rng.geometric(4 / sequence, 4000))
    rows, total = packing.plan(histogram(lengths, sequence), sequence, classes=min(sequence, 64), rounds=300)
    filled = {}
    seen = {}
    for length, rank, n, first, offset in rows.tolist():
        assert rank == seen.get(length, 0)
        seen[length] = rank + n
        for s in range(first, first + n):
            filled.setdefault(s, []).append((offset, length))
    assert seen == {length: n for length, n in enumerate(histogram(lengths, sequence).tolist()) if n}
    assert sorted(filled) == list(range(total))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence
    assert total <= np.ceil(lengths.sum() / sequence) * 1.01 + 2


def test_a_plan_does_not_grow_with_the_counts():
    counts = histogram(np.random.default_rng(1).integers(1, 513, 3000), 512)
    small, n = packing.plan(counts, 512, rounds=200)
    large, m = packing.plan(counts * 1_000_000, 512, rounds=200)
    assert len(large) < 20 * len(small) and m <= (counts * np.arange(513)).sum() * 1_000_000 / 512 * 1.01


def test_odd_histograms():
    for lengths in ([], [5], [512] * 9, [300] * 40, [257] * 3 + [256] * 5, [1] * 2000):
        counts = histogram(np.array(lengths, int), 512)
        rows, total = packing.plan(counts, 512, rounds=50)
        assert sum(r[2] for r in rows.tolist()) == len(lengths)
        assert total >= -(-sum(lengths) // 512)
    assert packing.plan(histogram([300] * 40, 512), 512)[1] == 40


@pytest.mark.parametrize("sequence", [64, 4096])
def test_edges(edge, no_documents, sequence):
    found = packing.pack(edge, sequence, rounds=100).collect()
    expected = []
    for doc_id, text, _ in edge_rows():
        ids = np.array([*encoder().library.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        expected += [str((doc_id, k, s, len(ids[s:s + sequence]), zlib.crc32(ids[s:s + sequence].tobytes()))) for k, s in enumerate(range(0, len(ids), sequence))]
    assert sorted(str(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in found) == sorted(expected)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= sequence
    assert packing.pack(no_documents, sequence, rounds=10).count() == 0
