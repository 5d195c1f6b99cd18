import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from beaconaudit.llm import wavelet
from beaconaudit.llm.tokens import END_ID, Encoder, encoder
from beaconaudit.operators.store import new_folder
from tests.llm.conftest import edge_rows

ODD = ["", " \t ", "İstanbul ſtraße <|endoftext|> x<|startoftext|>y", "don't 've he'll I'd 1234 ab12 x.y,z...", "été café",
       " nb sp", "日本語 テスト", "ÀÉÎ Ñandú!!! ***", "a" * 500, "\x1c\x1d \x85   z", "ΑΣ ΣΑΣ", "ǅ K ﬁ", "\x00 \x01a", "<| |>", "x<|endoftext|>"]


def library_ids(text):
    return [*encoder().library.encode(text or "", add_special_tokens=False).ids, END_ID]


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    texts = ODD + [None] + [r[1] for r in edge_rows()]
    texts += ["".join(rng.choice("abÀé.,! '\n\t<|>12́ ſΣ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    codec = Encoder()
    assert [x.tolist() for x in codec.encode(pa.array(texts, pa.string()))] == [library_ids(t) for t in texts]


def test_small_caches_and_chunks(monkeypatch):
    from beaconaudit.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 20)
    texts = ODD + [r[1] for r in edge_rows()[:8]]
    assert [x.tolist() for x in Encoder().encode(pa.array(texts, pa.string()))] == [library_ids(t) for t in texts]


@pytest.mark.parametrize("n, levels", [(1, 1), (511, 3), (512, 16), (5000, 16), (3000, 20)])
def test_matrix(n, levels):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, min(1 << levels, 300), n).astype(np.uint16 if levels <= 16 else np.uint32)
    matrix = wavelet.Shard.from_bytes(wavelet.Shard(wavelet.WaveletMatrix.build(ids, levels), [1], np.array([n]), {}).to_bytes()).matrix
    assert (matrix.decode() == ids).all()
    for at in rng.integers(0, n, 40).tolist():
        symbol = int(ids[at])
        assert matrix.access(at) == symbol
        assert matrix.rank(symbol, at) == (ids[:at] == symbol).sum()
        assert matrix.select(symbol, matrix.rank(symbol, at)) == at
    symbol = int(ids[0])
    assert matrix.occurrences(symbol) == np.flatnonzero(ids == symbol).tolist()
    assert matrix.count((1 << levels) - 1) == (ids == (1 << levels) - 1).sum() and matrix.count(1 << levels) == 0
    with pytest.raises(IndexError):
        matrix.access(n)
    with pytest.raises(IndexError):
        matrix.select(symbol, matrix.count(symbol))


def check(frame, shard_tokens):
    spark = frame.sparkSession
    folder = new_folder(spark)
    files = wavelet.write(frame, folder, shard_tokens=shard_tokens)
    found = wavelet.read(spark, folder, files).collect()
    rows = [(r["doc_id"], library_ids(r["text"])) for r in frame.select("doc_id", "text").collect()]
    assert sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in found) == sorted(
        str((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))) for i, ids in rows)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    return files


def test_edges(edge, no_documents):
    assert check(edge, 2000).count() > 4
    check(edge, 1 << 20)
    assert wavelet.round_trip(no_documents).count() == 0
