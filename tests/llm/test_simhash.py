import random
import re

import xxhash

from beaconaudit.llm import simhash
from tests.llm.conftest import edge_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component(fps):
    """The smallest id reachable from each row, rows of (id, fingerprint)."""
    names = list(range(len(fps)))
    for _ in fps:
        for i, (_, x) in enumerate(fps):
            for j, (_, y) in enumerate(fps):
                if (x ^ y).bit_count() <= 2:
                    names[i] = names[j] = min(names[i], names[j])
    return [min((fps[j][0] for j in range(len(fps)) if names[j] == n and fps[j][0] is not None), default=None) for n in names]


def test_fingerprints():
    rng = random.Random(3)
    texts = [r[1] for r in edge_rows() if r[0] not in (8, 9)] + ["One", "One TWO", "ÉCOLE École", "a\x0bb\x0cc\x1cd\x85e f"]
    texts += [sentence(rng, rng.randint(1, 40)) for _ in range(20)]
    for text in texts:
        assert simhash.fingerprint((text or "").encode()) % (1 << 64) == plain(text)
    simhash_piece, simhash._PIECE = simhash._PIECE, 7
    try:
        assert all(simhash.fingerprint((t or "").encode()) % (1 << 64) == plain(t) for t in texts)
    finally:
        simhash._PIECE = simhash_piece


def test_links_within_the_radius(spark):
    rng = random.Random(9)
    fps = {0}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = simhash.components(links)
    root = {r["node"]: r["root"] for r in found.collect()}
    ours = [root.get(x, x) for x in signed]
    theirs = component([(x, x % (1 << 64)) for x in signed])
    assert ours == theirs


def test_edges(edge, no_documents):
    found = simhash.near_duplicates(edge).collect()
    expected = [(r[0], plain(r[1])) for r in edge_rows()]
    names = component(expected)
    ours = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in found)
    assert ours == sorted((str(i), fp, str(n)) for (i, fp), n in zip(expected, names))
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    stays = {str((r[0], r[1])) for r, n in zip(edge_rows(), names) if r[0] is None or r[0] == n}
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(stays)
    assert simhash.near_duplicates(no_documents).count() == 0
