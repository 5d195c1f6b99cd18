import base64
import hashlib
import random

import pytest
import zstandard

from beaconaudit.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, refers_to string, name string"


def rows():
    rng = random.Random(5)
    pages = [(i, f"http://h.example/{i}?q=é x\r\nA: b", "<p>" + " ".join(rng.choice(["one", "two", "drei", "été"]) for _ in range(200))) for i in range(60)]
    pages += [(100 + i, None, "same page") for i in range(20)] + [(200, "u", None), (201, "u", ""), (None, "u", "same page"), (5, "u", "same page")]
    return pages + [(300, "u", "twice"), (300, "u", "twice"), (301, "u", "twice"), (302, "u", "\x00\r\n\r\n" * 50_000)]


def frame(spark, some):
    return spark.createDataFrame([(*r, "?", "?", "?") for r in some], SCHEMA).repartition(4)


def expected(some, least=0):
    first = {}
    for i, _, html in some:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in some:
        data = (html or "").encode()
        other = first.get(html or "") if i is not None and i != first.get(html or "", i) else None
        out.append(str((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if other is None else "revisit", other)))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    found = warc.round_trip(frame(spark, rows()), least).collect()
    assert sorted(str(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in found) == expected(rows(), least)


def test_no_pages(spark):
    assert warc.round_trip(frame(spark, rows()).where("1 = 0")).count() == 0


def test_an_archive_is_read_with_the_dictionary_in_front():
    some = [warc.record(i, f"http://x/{i}", (html or "").encode(), None) for i, (_, _, html) in enumerate(rows())]
    frames = warc.archive(some)
    data = b"".join(frames)
    assert data[:4] == bytes.fromhex("5d2a4d18") and len(frames) == len(some) + 1
    assert list(warc.records(data)) == some
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(frames[1])
    assert sum(map(len, frames)) < sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in some)


@pytest.mark.parametrize("n", [1, 3, 8, 500])
def test_too_little_for_a_dictionary(n):
    """Few records, or all the same: a dictionary of raw content stands in front."""
    some = [warc.record(1, None, b"x", None)] * n
    frames = warc.archive(some)
    assert frames[0][:4] == bytes.fromhex("5d2a4d18") and len(frames) == n + 1
    assert list(warc.records(b"".join(frames))) == some


def test_damage_is_found():
    raw = warc.record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paXload"))


def test_archives_are_closed(spark, monkeypatch):
    from beaconaudit.operators.store import new_folder
    folder = new_folder(spark)
    files = warc.write(frame(spark, rows()), folder, archive_bytes=5000)
    assert files.count() > 8
    assert warc.read(spark, folder).count() == len(rows())
