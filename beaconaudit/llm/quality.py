"""Quality rules of documents and verdicts on their hosts, in SQL functions only.

Each document is tried by two base rules (too few words, too much of it repeated). The failures
are counted by host, the host's rate is shrunk towards the corpus by a beta prior whose two
parameters come from the hosts themselves, and the verdict on the host goes back to its documents.

Defined results: a null text has no words and fails; a document without a host (null) is judged by
the base rules alone; repeated rows, null ids included, are judged and counted one by one; an empty
table gives no rows. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beaconaudit.llm.common import BLANK_CLASS, NOT_BLANK_CLASS, fresh, let
from beaconaudit.operators.store import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host whose shrunk failure rate is above this is rejected whole.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more.

    Most texts repeat no window: 64-bit hashes that are all distinct prove it. Otherwise the
    windows themselves are sorted, so equal ones are neighbours and no hash decides.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def sorted_windows(unused: Column) -> Column:
        windows = F.transform(starts, lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("at")))
        return let(F.sort_array(windows), lambda s: let(
            F.sort_array(F.transform(
                F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
                         | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))),
                lambda x: x["at"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
                F.lit(0), lambda total, step: total + step)))

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        sorted_windows(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def rules(text: Column) -> Column:
    """A struct of the five counts and ``base_failed`` for a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def counts(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    def words_of(t: Column) -> Column:
        return F.filter(F.split(t, BLANK_CLASS + "+"), lambda w: w != "")

    def lines_of(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_BLANK_CLASS))

    found = let(text, lambda t: let(words_of(t), lambda w: let(lines_of(t), lambda lines: counts(t, w, lines))))
    return let(found, lambda f: f.withField(
        "base_failed",
        (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])))


def host_verdicts(tried: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """One row per host that is not null: host, n_docs, n_failed, host_rate and host_failed.

    The prior is beta(m * k, (1 - m) * k): m is the corpus' failure rate and k follows from the
    spread of the hosts' rates around it (method of moments). Hosts that differ no more than
    chance allows get a large k, hosts that differ wildly a small one.
    """
    hosts = tried.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    # one row whatever the number of hosts; the weighted squares are taken about zero and shifted
    prior = hosts.agg(
        F.count("*").alias("h"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("x"),
        F.sum(F.col("n_docs") * rate * rate).alias("square"), F.sum(1 / F.col("n_docs")).alias("inverse"))
    m = F.col("x") / F.col("n")
    spread = F.when(F.col("h") > 1, F.col("h") * (F.col("square") - F.col("n") * m * m) / ((F.col("h") - 1) * F.col("n")))
    chance = m * (1 - m) * F.col("inverse") / F.col("h")
    k = F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.when(spread > chance, (m * (1 - m) - spread) / (spread - chance))
                                       .otherwise(F.lit(1e6))))
    prior = prior.select(F.lit(1).alias("all"), m.alias("m"), k.alias("k"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return (hosts.withColumn("all", F.lit(1)).join(F.broadcast(prior), "all")  # the prior is a single row
            .select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > MAX_HOST_RATE).alias("host_failed")))


def judge(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, source, the counts, base_failed, host_failed (null without a host) and kept.

    Texts are read once; the counts, small rows, are stored and read by both the hosts' sums and the join.
    """
    found = documents.select("doc_id", "source", rules(F.col("text")).alias("r")).select("doc_id", "source", "r.*")
    found = stored(found)
    hosts = host_verdicts(found).select(F.col("host").alias("source"), "host_failed")
    return (found.join(hosts, "source", "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, as they are: the same verdicts as ``judge``, for any further columns.

    Rows are told apart by nothing but themselves, so the base rules are evaluated again for the
    rows that go on, and hosts that failed, one small row each, are joined away.
    """
    (failed,) = fresh(documents, "base_failed")
    tried = documents.withColumn(failed, rules(F.col("text"))["base_failed"])
    hosts = stored(host_verdicts(tried.select("source", failed), failed=failed).where("host_failed").select(
        F.col("host").alias("failed_host")))
    (name,) = fresh(documents, "failed_host")
    hosts = hosts.withColumnRenamed("failed_host", name)
    return tried.where(~F.col(failed)).join(hosts, F.col("source") == F.col(name), "left_anti").select(*documents.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS nd, sum(CAST(base_failed AS INT)) AS nf FROM g WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT count(*) AS h, sum(nd) AS n, sum(nf) / sum(nd) AS m, sum(nd * (nf / nd) * (nf / nd)) AS sq, sum(1.0 / nd) AS inv FROM h),
q AS (SELECT m, CASE WHEN h > 1 THEN h * (sq - n * m * m) / ((h - 1) * n) END AS spread, m * (1 - m) * inv / h AS chance FROM p),
b AS (SELECT m, greatest(1.0, least(1e6, CASE WHEN spread > chance THEN (m * (1 - m) - spread) / (spread - chance) ELSE 1e6 END)) AS k FROM q),
v AS (SELECT source, (nf + m * k) / (nd + k) > 0.5 AS host_failed FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM g LEFT JOIN v ON v.source = g.source
"""
