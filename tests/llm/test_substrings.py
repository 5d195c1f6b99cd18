import hashlib
import random

import numpy as np
import pytest

from beaconaudit.llm import substrings
from tests.llm.conftest import edge_rows


def plain(rows):
    """Per (id, text): the mask of removed bytes; rows in the order of the corpus."""
    seen, out = set(), {}
    for doc_id, _, data in rows:
        mask = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            window = data[s:s + 100]
            if window in seen:
                mask[s:s + 100] = True
            seen.add(window)
        out[doc_id, data] = mask
    return out


def digest(data, mask):
    spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
    return len(data), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~mask].tobytes()).hexdigest()


def compare(spark, frame, shard_bytes):
    rows = frame.select("doc_id", substrings.F.xxhash64("text").alias("tie"), "text").distinct().collect()
    ordered = sorted(((r["doc_id"], r["tie"], (r["text"] or "").encode()) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    masks = plain(ordered)
    found = substrings.remove_repeats(frame, shard_bytes).collect()
    for r in found:
        kept = bytes(r["kept"])
        assert hashlib.sha256(kept).hexdigest() == r["kept_sha256"]
    ours = sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in found)
    texts = frame.select("doc_id", "text").collect()
    assert ours == sorted(str((r["doc_id"], *digest(d := (r["text"] or "").encode(), masks[r["doc_id"], d]))) for r in texts)


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 24])
def test_against_all_windows(spark, shard_bytes):
    """Repeats within and across texts and shards, periodic texts, texts around the width."""
    rng = random.Random(shard_bytes)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 400))) for _ in range(8)]
    pool += ["x" * rng.randint(90, 400), "ab" * rng.randint(50, 200), "abc" * rng.randint(40, 150), "é" * 120]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 50):] for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [(100 + n, "q" * n) for n in (99, 100, 101)]
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shard_bytes)


def test_long_texts_in_slices(spark, monkeypatch):
    """Slices of a few hundred bytes instead of a megabyte: the same result."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(i, passage[rng.randint(0, 300):] + "".join(rng.choice("ab") for _ in range(400)) + passage) for i in range(8)]
    texts = [t.encode() for _, t in rows] + [b"", b"x" * 99, b"y" * 100, b"z" * 101]
    whole = sorted((int(v), int(t), int(p), s) for v, t, p, f, e in zip(*(np.concatenate(x) for x in zip(*substrings._all_anchors(texts)))) for s in range(f, e + 1))
    monkeypatch.setattr(substrings, "SLICE", 250)
    sliced = sorted((int(v), int(t), int(p), s) for v, t, p, f, e in zip(*(np.concatenate(x) for x in zip(*substrings._all_anchors(texts)))) for s in range(f, e + 1))
    assert whole == sliced and len(set(whole)) == len(whole) == sum(max(0, len(t) - 99) for t in texts)


def test_small_merges(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(substrings, "MERGE_ROWS", 3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(40)) + passage + str(i)) for i in range(40)]
    columns = {"hash": np.zeros(5, np.int64)}
    assert list(substrings._blocks(np.array([1, 1, 1, 1, 2, 3, 3]), 3)) == [(0, 4), (4, 7)] and columns
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1 << 24)


def test_edges(spark, edge, no_documents):
    short = edge.where("doc_id IS NULL OR doc_id NOT IN (8, 9)")
    compare(spark, short, 1 << 24)
    assert substrings.remove_repeats(edge).count() == len(edge_rows())
    assert substrings.remove_repeats(no_documents).count() == 0


def test_every_window_has_one_anchor():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 500))) for _ in range(30)] + [b"x" * 400]
    ends = np.cumsum([len(t) for t in texts])
    _, text, place, first, last = substrings.anchors(np.frombuffer(b"".join(texts), np.uint8), ends)
    covered = np.zeros(int(ends[-1]), int)
    for s, e in zip(first, last):
        covered[s:e + 1] += 1
    expected = np.zeros(int(ends[-1]), int)
    for t, e in zip(texts, ends):
        expected[e - len(t):max(e - len(t), e - 99)] = 1
    assert (covered == expected).all()
