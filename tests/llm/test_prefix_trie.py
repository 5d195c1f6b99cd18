import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from beaconaudit.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, names string, head string, depth int, n int, base long, id string"


def plain(rows, family=5, longest=9):
    """All nodes of the trie by prefixes, as sorted tuples."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            turns.setdefault(conv, []).append((turn is not None, turn or 0, name, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % longest
        base = c - c % family
        built[c] = ts if base == c else own.get(base, [])[:h] + ts[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    found = []
    for node, cs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        found.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved,
                      hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def build(spark, rows, limit=prefix_trie.CONTAINER, **options):
    frame = spark.createDataFrame([(*r, "x", "y", 3, 4, 5, "z") for r in rows], SCHEMA).repartition(3)
    found = prefix_trie.build(prefix_trie.rebuilt(frame, **options), limit)
    assert tuple(found.columns) == prefix_trie.NODE_COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


def some_conversations(seed, n=60):
    """Few different turns, so that prefixes are shared; a third of the conversations are one and the same."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 3 == 0:
            turns = [("user", "hot"), ("assistant", "öl"), ("user", "end")]
        else:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ç"])) for _ in range(rng.randint(1, 7))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_against_all_prefixes(spark, limit):
    rows = some_conversations(limit)
    assert build(spark, rows, limit) == plain(rows)


def test_containers_are_bounded(spark):
    rows = spark.createDataFrame([(*r, "x", "y", 3, 4, 5, "z") for r in some_conversations(5, 90)], SCHEMA)
    containers, heads = prefix_trie.burst(prefix_trie.records(prefix_trie.rebuilt(rows, family=1)), 6)
    assert len(heads) > 1
    held = [r["count"] for c in containers for r in c.groupBy("head").count().collect()]
    assert max(held) <= 6 and sum(held) > 20


def test_a_long_shared_prefix_bursts_at_once(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 40 else f"own {c}") for c in range(12) for t in range(42)]
    frame = spark.createDataFrame([(*r, "x", "y", 3, 4, 5, "z") for r in rows], SCHEMA)
    built = prefix_trie.rebuilt(frame, family=1)
    _, heads = prefix_trie.burst(prefix_trie.records(built), 3)
    assert len(heads) == 1
    assert build(spark, rows, 3, family=1) == plain(rows, family=1)


def test_edges(spark):
    rows = [
        (None, 0, "user", "nobody's"), (1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "tie"),
        (2, 5, "user", ""), (5, 0, "user", "q"), (5, 1, "assistant", "x" * 200_000), (6, 0, "user", "q"), (6, 1, "assistant", "x" * 200_000),
        (7, 0, "us", "erq"), (8, 0, "user", "only"), (9, 1, "user", "only"), (2**40, 0, "user", "q"), (0, 0, "user", "first\nline"),
        *[(23, t, "user", f"{t % 2}") for t in range(300)], *[(20, t, "user", f"{t % 2}") for t in range(150)],
    ]
    for limit in (1, 100):
        assert build(spark, rows, limit) == plain(rows)
    assert build(spark, rows[:1]) == []
    assert build(spark, []) == []


def test_long_lists_of_ends(monkeypatch):
    """Ids of one node go to the hash in several chunks, whatever batches and partitions they come in."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(b"a", c) for c in range(3, 45)] + [(b"b", 2**40)] + [(b"c", c) for c in range(95, 1105, 5)]
    chunks = []
    for part in (rows[:20], rows[20:21], [], rows[21:]):  # four partitions of the range
        batches = [pa.RecordBatch.from_pylist([{"names": k, "conv_id": c} for k, c in part[i:i + 9]]) for i in range(0, len(part), 9)]
        chunks += [r for b in prefix_trie._chunks(iter(batches)) for r in b.to_pylist()]
    assert max(c["ids"].count(",") for c in chunks) == 6
    chunks.sort(key=lambda c: (c["names"], c["first"]))
    found = prefix_trie._digests(iter([pa.RecordBatch.from_pylist(chunks[i:i + 5]) for i in range(0, len(chunks), 5)]))
    assert {r["names"]: r["ends"] for b in found for r in b.to_pylist()} == {
        key: hashlib.sha256(",".join(str(c) for k, c in rows if k == key).encode()).hexdigest() for key in (b"a", b"b", b"c")}
