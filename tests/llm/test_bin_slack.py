import itertools
import random
import zlib

import numpy as np
import pytest

from beaconaudit.llm import bin_slack
from beaconaudit.llm.tokens import encoder
from tests.llm.conftest import edge_rows


def test_closest_against_all_choices():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 15), rng.randint(1, 5)), reverse=True)
        counts = [rng.randint(1, 4) for _ in lengths]
        room = rng.randint(0, 40)
        taken = bin_slack.closest(lengths, counts, room)
        assert all(0 < k <= counts[lengths.index(x)] for x, k in taken.items())
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(k * x for k, x in zip(c, lengths))) <= room)
        assert sum(k * x for x, k in taken.items()) == best


def check_plan(counts, sequence):
    rows, total = bin_slack.plan(counts, sequence)
    parts, filled = {}, {}
    for length, rank, n, begin, size, first, offset in rows.tolist():
        for i in range(n):
            parts.setdefault((length, rank + i), []).append((begin, size))
            filled.setdefault(first + i, []).append((offset, size))
    assert sorted(parts) == [(length, r) for length, n in enumerate(counts.tolist()) for r in range(n) if length]
    for (length, _), some in parts.items():
        at = 0
        for begin, size in sorted(some):
            assert begin == at and size > 0
            at += size
        assert at == length
    assert sorted(filled) == list(range(total))
    ends = []
    for places in filled.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        ends.append(at)
    tokens = int((counts * np.arange(len(counts))).sum())
    assert sorted(ends, reverse=True) == [sequence] * (tokens // sequence) + [1 << b for b in range(30, -1, -1) if tokens % sequence >> b & 1]
    return sum(len(p) > 1 for p in parts.values())


@pytest.mark.parametrize("sequence", [8, 64, 100, 512])
def test_plans_are_whole_and_unpadded(sequence):
    rng = np.random.default_rng(sequence)
    lengths = np.minimum(sequence, rng.geometric(4 / sequence, 4000))
    cuts = check_plan(np.bincount(lengths, minlength=sequence + 1), sequence)
    assert cuts <= 20  # sums hit the capacity as long as there is a choice


def test_odd_histograms():
    for lengths in ([], [5], [512] * 9, [300] * 40, [257] * 3 + [256] * 5, [1] * 2000, [511], [300] * 1000 + [299] * 7, [171] * 500):
        check_plan(np.bincount(np.array(lengths, int), minlength=513), 512)


def test_a_plan_does_not_grow_with_the_counts():
    counts = np.bincount(np.random.default_rng(1).integers(1, 513, 3000), minlength=513)
    small, n = bin_slack.plan(counts, 512)
    large, m = bin_slack.plan(counts * 1_000_003, 512)
    assert len(large) < 10 * len(small) and m >= 1_000_000 * (n - 9)
    one, _ = bin_slack.plan(np.bincount([300], minlength=4097) * 10**9, 4096)
    assert len(one) < 5000


@pytest.mark.parametrize("sequence, few", [(64, 20_000), (64, 0), (4096, 20_000)])
def test_edges(edge, sequence, few, monkeypatch):
    monkeypatch.setattr(bin_slack, "_FEW_CUTS", few)
    found = bin_slack.pack(edge, sequence).collect()
    rows = [(r[0], [*encoder().library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in edge_rows()]
    expected = {}
    for doc_id, ids in rows:
        expected.setdefault((str(doc_id), len(ids)), []).append(np.array(ids, "<u4"))
    covered, places = {}, {}
    for r in found:
        ids = expected[str(r["doc_id"]), r["doc_tokens"]][0]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(part.tobytes())
        covered.setdefault((str(r["doc_id"]), r["doc_tokens"]), np.zeros(len(ids), int))[r["start"]:r["start"] + r["length"]] += 1
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: len(v) for k, v in expected.items()} == {k: int(v[0]) for k, v in covered.items() if (v == v[0]).all()}
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at == sequence or at < sequence and at & (at - 1) == 0
    assert sum(len(ids) for _, ids in rows) // sequence == sum(sum(n for _, n in p) == sequence for p in places.values())


def test_no_documents(no_documents):
    assert bin_slack.pack(no_documents).count() == 0
