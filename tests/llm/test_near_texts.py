import collections
import random

import numpy as np

from beaconaudit.llm import near_texts
from tests.llm.conftest import sentence


def plain(rows, threshold=0.8):
    """The (id, text) rows that stay, every pair of texts compared by their sets of five-word shingles."""
    def shingles(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))

    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= threshold * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [r for i, r in enumerate(rows) if r[0] is None or root(i) == i]


def edited(rng, words, edits):
    """A text with so many words replaced, evenly dealt."""
    words = list(words)
    for k in range(edits):
        words[len(words) * k // edits + rng.randrange(len(words) // edits)] = f"new{rng.randrange(10 ** 9)}"
    return " ".join(words)


def test_near_copies_against_all_pairs(spark):
    """Copies and near copies from 0.8 to 1.0, texts below 0.8, unrelated texts: what stays is what all pairs say, but for few misses near 0.8."""
    rng = random.Random(3)
    rows = []
    for group in range(60):
        words = sentence(rng, 300).split()
        rows += [(group * 10 + k, edited(rng, words, edits)) for k, edits in enumerate((0, 1, 2, 3, 12)) if edits] + [(group * 10, " ".join(words))]
    rows += [(1000 + i, rows[i][1]) for i in range(50)]
    rows += [(2000 + i, f"  {rows[i][1].upper()}") for i in range(20)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = collections.Counter(tuple(r) for r in near_texts.keep_first(frame).collect())
    expected = collections.Counter(plain(rows))
    assert not expected - found  # nothing goes without a partner at 0.8 or more
    assert sum((found - expected).values()) <= 3


def test_recall_by_similarity():
    """Share of pairs of 300-word texts that meet in a bucket: 1, 2, 4 and 6 words replaced."""
    rng = random.Random(8)
    for edits, least in ((1, 0.99), (2, 0.98), (4, 0.85), (6, 0.6)):
        met = 0
        for _ in range(100):
            words = [f"w{rng.randrange(50_000)}" for _ in range(300)]
            a, b = near_texts.variants([near_texts.encoded(" ".join(words)), near_texts.encoded(edited(rng, words, edits))])
            met += bool(set(a.tolist()) & set(b.tolist()))
        assert met / 100 >= least, (edits, met)


def test_edges(spark, edge, no_documents):
    """``edge`` has nulls, repeated rows, very long texts and clashing names."""
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    kept = near_texts.keep_first(edge)
    assert kept.columns == edge.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(map(str, plain(rows)))
    assert near_texts.keep_first(no_documents).count() == 0


def test_chance_meetings_need_no_texts(spark):
    """Unrelated texts share variants of 32 bits by chance; only near ones go on to the comparison of texts."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(15))) for i in range(4000)]
    near = " ".join(f"v{i}" for i in range(60))
    rows += [(5000, near), (5001, near + " tail"), (5002, near + " tail")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_texts.candidates(frame)
    shared = found.where("doc_id < 5000").selectExpr("explode(bands) AS band").groupBy("band").count().where("count > 1").count()
    assert shared > 0
    texts = sorted(r["text"] for r in near_texts.compared(frame, found).collect())
    assert texts == sorted(near_texts.encoded(t) for t in (near, near + " tail"))
    assert {r["doc_id"] for r in near_texts.keep_first(frame).collect()} == {*range(4000), 5000}


def test_rows_of_a_bucket():
    """A row stays if another text of its bucket is near, or if the bucket is large; copies of one text are no partners."""
    sketch = np.array([[0], [1], [2 ** 64 - 1], [0], [0], *([[k] for k in range(near_texts.SMALL_BUCKET + 1)])], np.uint64).repeat(6, axis=1)
    ids = np.array([[1, 1], [2, 1], [3, 1], [4, 1], [4, 1], *([[k, 2] for k in range(near_texts.SMALL_BUCKET + 1)])], np.uint64)
    bucket = np.array([7, 7, 7, 8, 8, *[9] * (near_texts.SMALL_BUCKET + 1)])
    kept = near_texts.partnered(bucket, ids, sketch)
    assert kept.tolist() == [True, True, False, False, False, *[True] * (near_texts.SMALL_BUCKET + 1)]


def test_fingerprints_of_similar_texts_are_near():
    """The bound on the bits of all tables is far from what texts at 0.8 and unrelated texts differ in, few shingles included."""
    rng = random.Random(9)
    for words, edits in ((9, 0), (40, 0), (50, 1), (300, 6)):
        for _ in range(40):
            text = [f"w{rng.randrange(50_000)}" for _ in range(words)]
            other = edited(rng, text, edits) if edits else " ".join([*text, "tail"])
            a, b, c = near_texts.sketches_of([near_texts.encoded(t) for t in (" ".join(text), other, " ".join(text[::-1]))])
            assert np.bitwise_count(a ^ b).sum() < near_texts.MOST_APART < np.bitwise_count(a ^ c).sum()
