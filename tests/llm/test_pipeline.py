"""The registered queries beside their SQL, and the pipeline's stages beside plain versions."""

import collections
import os
import random

import duckdb
import pytest

import corpus_pipeline
from beaconaudit.llm import ORACLES, QUERIES, quality
from beaconaudit.operators import store
from tests.llm.conftest import edge_rows, sentence
from tests.llm.test_fuzzy_lines import plain as plain_lines
from tests.llm.test_near_texts import plain as plain_copies
from tests.llm.test_quality import plain as plain_rules

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = connection.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = collections.Counter(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    assert collections.Counter(tuple(r) for r in frame.select(*columns).collect()) == theirs


def test_stages_keep_the_columns_of_documents(spark, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_against_plain_versions(spark, edge):
    unique = edge.where("doc_id NOT IN (4, 8, 9, 14)").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in unique.collect()]
    # quality: the base rules, and no host here fails on the whole
    good = corpus_pipeline.good_documents(spark, unique, "")
    hosts = {r["host"]: r["host_failed"] for r in quality.host_verdicts(quality.judge(unique)).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, t, s in rows if not plain_rules(t)[-1] and not hosts.get(s)}
    # lines
    tied = sorted(rows, key=lambda r: r[0])
    gone = plain_lines([(i, t) for i, t, _ in tied])
    texts = {i: t and "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((i, t), [])) for i, t, _ in rows}
    lines = corpus_pipeline.without_repeated_lines(spark, unique, "")
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] is not None)
    # near copies
    kept = corpus_pipeline.without_near_copies(spark, unique, "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in plain_copies([(i, t) for i, t, _ in rows])}
    # mixing and packing lose nothing
    assert corpus_pipeline.mixed(spark, unique, "").count() == len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, unique, "").collect()} == {i for i, _, _ in rows}


def test_leading_sequences_hold_the_shares_of_the_mix(spark):
    rng = random.Random(5)
    sources = ["a"] * 1200 + ["b"] * 200 + ["c"] * 100
    texts = [sentence(rng, rng.randint(60, 120)) for _ in range(12)]
    docs = spark.createDataFrame([(i, rng.choice(texts), s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    rows = corpus_pipeline.packed(spark, corpus_pipeline.mixed(spark, docs, ""), "").collect()
    assert len(rows) == len(sources)
    last = max(r["sequence_id"] for r in rows) * 0.3
    tokens = collections.Counter()
    for r in rows:
        tokens[sources[r["doc_id"]]] += r["length"] * (r["sequence_id"] <= last)
    # square roots: 0.59, 0.24, 0.17; raw shares: 0.80, 0.13, 0.07
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    assert abs(share["a"] - 0.59) < 0.08 and abs(share["b"] - 0.24) < 0.06 and abs(share["c"] - 0.17) < 0.06


def test_stages_on_empty_tables_and_clashing_columns(spark, edge, no_documents):
    """``edge`` has columns named like those the operators use inside, nulls, repeated rows and very long texts."""
    given = collections.Counter(str(r["doc_id"]) for r in edge.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, edge, "")
        assert kept.columns == edge.columns, name
        found = collections.Counter(str(r["doc_id"]) for r in kept.collect())
        assert found and not found - given, name  # no row is made up or doubled
        if name in ("line dedup", "mixing"):
            assert found == given, name
        none = stage(spark, no_documents, "")
        assert none.columns == edge.columns and none.count() == 0, name
    assert corpus_pipeline.packed(spark, no_documents, "").count() == 0
    assert collections.Counter(str(r["doc_id"]) for r in corpus_pipeline.packed(spark, edge, "").where("piece = 0").collect()) == given


def test_files_are_in_order_of_their_numbers(spark, tmp_path):
    """A mix of more than 100,000 files: names of five and of six digits."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    for first, number in ((0, 99998), (100, 99999), (200, 100000), (300, 1000000)):
        pq.write_table(pa.table({"doc_id": list(range(first, first + 100)), "text": ["word " * 500] * 100}), str(tmp_path / f"part-{number:05d}-x.parquet"))
    rows = corpus_pipeline.packed(spark, spark.read.parquet(str(tmp_path)), "").select("doc_id", "sequence_id").collect()
    last = {k: max(r["sequence_id"] for r in rows if r["doc_id"] // 100 == k) for k in range(4)}
    assert len(rows) == 400 and last[0] < last[1] < last[2] < last[3]


def test_tables_of_a_stage_go_when_the_next_is_called(spark, edge, tmp_path):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    lines = corpus_pipeline.without_repeated_lines(spark, docs, "")
    helpers = set(corpus_pipeline._helpers)
    lines.write.parquet(str(tmp_path / "lines"))
    assert helpers and helpers <= set(store.made())
    lazy = corpus_pipeline.without_near_copies(spark, spark.read.parquet(str(tmp_path / "lines")), "")
    assert not helpers & set(store.made())
    # an input that still reads the tables keeps them
    assert corpus_pipeline.mixed(spark, lazy, "").count() == lazy.count()


@here
def test_run(spark):
    """Documents that stay are whole: their pieces cover all their ids once, in sequences without gaps."""
    rows = corpus_pipeline.run(spark, SF).collect()
    total = sum(r["length"] for r in rows)
    assert rows and len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 1
    places, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 4096
    for some in parts.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(some)):
            assert (piece, start) == (k, at)
            at += length
    good = {r["doc_id"] for r in quality.keep_good(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(parts) <= good and len(parts) > len(good) / 2
