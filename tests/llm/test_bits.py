import numpy as np

from beaconaudit.llm import bits


def test_hardly_any_false_positive(spark):
    """Of 200,000 hashes that are not in a set of 50,000 fewer than one in a thousand seems to be; of the set, all."""
    value = np.random.default_rng(4).integers(0, 2 ** 64, 250_000, np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in value[:50_000].view(np.int64)], "hash long")
    some = bits.hash_set(rows)
    assert some.holds(value[:50_000]).all()
    assert some.holds(value[50_000:]).sum() < 200


def test_a_full_set_lets_no_member_go(spark, monkeypatch):
    monkeypatch.setattr(bits, "MOST_BITS", 1 << 19)
    value = np.random.default_rng(5).integers(0, 2 ** 64, 400_000, np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in value[:300_000:3].view(np.int64)], "hash long")
    some = bits.hash_set(rows.union(rows).union(rows))
    assert some.holds(value[:300_000:3]).all()
    assert some.holds(value[300_000:]).mean() < 0.3


def test_tagged_values_count_if_their_tags_differ(spark):
    """Plain values that are there twice, tagged ones that are there with two tags."""
    value = np.random.default_rng(6).integers(0, 2 ** 64, 8, np.uint64)
    plain, named = value[:4], value[4:]
    one, two = np.arange(4, dtype=np.uint64), np.array([0, 1, 7, 8], np.uint64)
    batches = [b for tags in (one, two) for b in bits.packed_with_tags(
        iter([([plain[:2], plain[2:] + tags[2:]], np.concatenate([bits.tagged(named, tags)] * 2))]), 4)]
    rows = spark.createDataFrame([(p, bytes(d)) for b in batches for p, d in zip(b["part"].to_pylist(), b["data"].to_pylist())], "part long, data binary")
    found = {r["hash"] for r in bits.packed_twice(rows, "hash", 4).collect()}
    assert found == {*plain[:2].view(np.int64).tolist(), *bits.untagged(named[2:]).view(np.int64).tolist()}
