import random
from collections import defaultdict

import numpy as np
import pytest

from beaconaudit.llm import fuzzy_lines
from tests.llm.conftest import edge_rows, sentence


def plain(rows):
    """Removed line numbers per (id, text), every pair of lines compared; rows in the order of the corpus."""
    places = [((i, t), n, line) for i, t in rows for n, line in fuzzy_lines.lines_of(t or "")]
    lines = list(dict.fromkeys(line for _, _, line in places))
    parent = {line: line for line in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if 2 * abs(len(a) - len(b)) < max(len(a), len(b)) and fuzzy_lines.similarity(a, b) >= 0.8:
                parent[root(a)] = root(b)
    seen, gone = set(), defaultdict(list)
    for key, n, line in places:
        if root(line) in seen:
            gone[key].append(n)
        seen.add(root(line))
    return gone


def check(frame):
    rows = frame.select("doc_id", fuzzy_lines.F.xxhash64("text").alias("tie"), "text").distinct().collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
    gone = plain([(r["doc_id"], r["text"]) for r in rows])
    found = fuzzy_lines.dedup_lines(frame)
    last = found.columns[-1]
    expected = []
    for r in frame.select("doc_id", "text").collect():
        lost = gone.get((r["doc_id"], r["text"]), [])
        text = r["text"] and "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in lost)
        expected.append(str((r["doc_id"], text, lost)))
    assert sorted(str((r["doc_id"], r["text"], r[last])) for r in found.collect()) == sorted(expected)
    return found


def test_near_lines(spark):
    rng = random.Random(6)
    base = [sentence(rng, rng.randint(6, 30)) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz ") + line[at + rng.randint(0, 1):]
            lines.append(rng.choice([line, line.upper(), f"  {line}", sentence(rng, 5), "short", ""]))
        rows.append((i, "\n".join(lines)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_edges(edge, no_documents):
    found = check(edge.where("doc_id IS NULL OR doc_id NOT IN (8, 9)"))
    assert found.columns == [*edge.columns, "_removed_lines"]
    whole = fuzzy_lines.dedup_lines(edge)
    assert whole.count() == len(edge_rows())
    assert whole.where("doc_id = 9").first()["text"].split("\n")[-1] == "tail"
    assert fuzzy_lines.dedup_lines(no_documents).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(8)
    shared = 0
    for _ in range(300):
        a = sentence(rng, 30)
        b = a[:len(a) - 24] + sentence(rng, 4)
        if fuzzy_lines.similarity(a, b) >= 0.8:
            x, y = fuzzy_lines.bands(fuzzy_lines.signatures([a, b])[0])
            shared += (x == y).any()
        else:
            shared += 1
    assert shared >= 297
    assert len(set(fuzzy_lines.bands(fuzzy_lines.signatures([sentence(rng, 30) for _ in range(200)])[0]).ravel().tolist())) == 200 * fuzzy_lines.BANDS


def test_pairs_at_the_threshold_share_a_band():
    rng = random.Random(21)
    pairs = []
    while len(pairs) < 1000:
        a = sentence(rng, 40)
        b = a[:len(a) - rng.randint(20, 30)] + sentence(rng, 3)
        if 0.8 <= fuzzy_lines.similarity(a, b) < 0.81:
            pairs += [a, b]
    value = fuzzy_lines.bands(fuzzy_lines.signatures(pairs)[0])
    assert fuzzy_lines.BANDS * fuzzy_lines.ROWS <= fuzzy_lines.BINS and 1 - (1 - 0.8 ** fuzzy_lines.ROWS) ** fuzzy_lines.BANDS >= 0.997
    assert (value[::2] == value[1::2]).any(axis=1).mean() >= 0.99


def test_short_lines_have_whole_signatures():
    lines = ["abcde", "aaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab"]
    signature, filled = fuzzy_lines.signatures(lines)
    assert (signature != fuzzy_lines._EMPTY).all()
    # ``filled`` counts the bins that have a value of their own: a shingle fills one of them
    assert filled.tolist() == [1, 1, 2]
    again, _ = fuzzy_lines.signatures(lines[::-1])
    assert (again[::-1] == signature).all()


@pytest.mark.parametrize("block", [1, 512])
def test_lines_beside_an_accidental_smallest(spark, monkeypatch, block):
    """The smallest of a bucket is like no other line; the others are alike, and no other bucket has them."""
    monkeypatch.setattr(fuzzy_lines, "BLOCK_LINES", block, raising=False)
    rng = random.Random(12)
    alike = [base + end for base in (sentence(rng, 20) for _ in range(3)) for end in ("", "x", "yz")]
    least = min(fuzzy_lines._line_id(line) for line in alike)
    odd = next(line for line in iter(lambda: sentence(rng, 20), None) if fuzzy_lines._line_id(line) < least)
    lines = [odd, *alike]
    ids = [fuzzy_lines._line_id(line) for line in lines]
    found = [(n, 0, 0, ids[n], lines[n], [7], [7, 8]) for n in range(len(lines))]
    found = spark.createDataFrame(found, "doc_id long, tie long, line int, id binary, text string, first array<long>, bands array<long>")
    top = {bytes(r["id"]): bytes(r["top"]) for r in fuzzy_lines.line_components(found).collect()}
    assert top == {i: min(family) for family in (ids[1:4], ids[4:7], ids[7:]) for i in family if i != min(family)}


def test_lines_of_any_length(spark):
    """Lines of one character to twenty: a line under five is similar to equal ones only."""
    rng = random.Random(31)
    base = ["}", "ab", "ab\0\0\0", "abcd", "abcde", "yes.", "---", *(sentence(rng, 2)[:rng.randint(5, 14)] for _ in range(20))]
    rows = [(i, "\n".join(rng.choice(base) + rng.choice(["", "", " ", "x"]) for _ in range(5))) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


@pytest.mark.parametrize("blocks", [1, 3])
def test_links_of_a_cell_connect_what_is_similar(blocks):
    """Two cells of variants of one template: links are similar, few, and connect all that is similar (of different blocks)."""
    rng = random.Random(17)
    template = sentence(rng, 12).split()
    lines = []
    for _ in range(120):
        words = list(template)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        lines.append(" ".join(words))
    lines = list(dict.fromkeys(lines))
    ids = [fuzzy_lines._line_id(line) for line in lines]
    cell = np.arange(len(lines)) * 2 // len(lines)
    block = np.arange(len(lines)) % blocks
    links = list(fuzzy_lines.new_links(cell, ids, np.arange(len(lines)), block, np.full(len(lines), blocks > 1), lines, 0.8, fuzzy_lines._Sets()))
    line_of = dict(zip(ids, lines))
    assert all(fuzzy_lines.similarity(line_of[a], line_of[b]) >= 0.8 for a, b in links) and len(links) < len(lines)

    def classes(pairs):
        top = {i: i for i in ids}
        for _ in ids:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    plain_links = [(ids[i], ids[j]) for i in range(len(lines)) for j in range(i) if cell[i] == cell[j] and (blocks == 1 or block[i] != block[j])
                   and fuzzy_lines.similarity(lines[i], lines[j]) >= 0.8]
    assert plain_links and classes(links) == classes(plain_links)


def test_buckets_with_the_same_members_are_compared_once(spark):
    """Bands 1 and 2 hold the same lines, 3 one more, 4 others; 5 is of one component."""
    held = {1: "ab", 2: "ab", 3: "abc", 4: "ac", 5: "de"}
    rows = [(bytes(line, "ascii"), line, {"a": 1, "b": 2, "c": 3}.get(line, 9), band) for band, some in held.items() for line in some]
    found = fuzzy_lines.buckets_to_compare(spark.createDataFrame(rows, "id binary, text string, top long, band long"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (3, 1), (4, 1)]


def test_lines_that_are_only_repeated_need_no_text(spark):
    """Equal lines share all bands; only lines that share one with a different line are compared, and so have their text."""
    rng = random.Random(41)
    copied, alike = [sentence(rng, 12) for _ in range(30)], sentence(rng, 30)
    rows = [(i, "\n".join([*rng.sample(copied, 5), sentence(rng, 12)])) for i in range(60)] + [(100, alike), (101, alike + "x"), (102, alike)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = fuzzy_lines.candidates(frame)
    assert {r["text"] for r in found.where("text IS NOT NULL").collect()} == {alike, alike + "x"}
    assert found.where("again").count() == 302 and found.count() == 303
    check(frame)


def test_a_line_that_is_there_twice_hides_no_bucket(spark):
    """Buckets of a, a, b and of c, c, b have as many members and the same bit_xor, but not the same members."""
    rows = [(bytes(line, "ascii"), line, ord(line), band) for band, some in {1: "aab", 2: "ccb"}.items() for line in some]
    found = fuzzy_lines.buckets_to_compare(spark.createDataFrame(rows, "id binary, text string, top long, band long"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 1)]
