"""Spelling variants: words one edit apart, found by dynamic programming over sorted vocabulary.

Words are counted in SQL functions. Two words one edit apart share a beginning and an end around the
edit. Take the shorter one's length m (either's, if equal) and the length of their common prefix: the pair
belongs to exactly one range lo <= prefix < hi of it, and both words then share their first lo and last
m - hi code points. So words are dealt out by (m, lo, hi, beginning, end); at first there are two ranges per
m. A bucket with more than ``BUCKET`` words is halved by its range again. A range of one leaves one code point
free (two in the longer words), so a bucket's size is bounded by the alphabet, whatever the vocabulary.

In a bucket the words are sorted (backwards where they share more of their end). Places where adjacent common
prefixes are shorter than d bound the ranges of words that are alike up to d. A range has one row of the edit matrix
per word that is looked up, three cells around the diagonal, made from the row of the range it lies in. Ranges whose row
has no cell of at most one edit are skipped with all their words. All words of all buckets go through a step together.

Defined results: a null text has no words; a null id counts as empty in the hash that picks occurrences to cut;
repeated rows count as often as they come; an empty table has no words; only doc_id and text are read, so other
columns cannot clash. Ties for the form go to the word that is smaller in code-point order.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from beaconaudit.llm.common import partitions
from beaconaudit.operators.joins import attach, attach_measured
from beaconaudit.operators.store import stored

RUN = "[A-Za-zÀ-ÿ]+"
#: Shortest word, fewest occurrences, and how many times as frequent a form must be.
SHORTEST, FEWEST, TIMES = 6, 5, 5
#: One in so many (document, run) loses a code point.
CUT = 199
#: Words of a bucket; one with more is halved while its range is longer than one.
BUCKET = 20_000
#: Words looked up in one step, and words of buckets that go through it together.
_LOOKUPS, _TOGETHER = 20_000, 60_000
_KEY = ("m", "lo", "hi", "beginning", "end")


def _cut(doc_id: Column, run: Column) -> Column:
    """The run without one code point where its hash with the document's id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % CUT == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(documents: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points with at least ``fewest`` occurrences."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    runs = runs.where(F.length("run") >= shortest).select("doc_id", lower.alias("run"))
    words = runs.select(_cut(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _halves(rows: DataFrame) -> DataFrame:
    """Every row in the two halves of its range of common prefixes, with the ends that go with them."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = rows.withColumn("part", F.explode(F.array(
        F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))))
    lo, hi = F.col("part.lo"), F.col("part.hi")
    last = F.greatest(F.col("m") - hi, F.lit(0))
    return parts.select("word", "n", "m", lo.alias("lo"), hi.alias("hi"), F.substring("word", F.lit(1), lo).alias("beginning"),
                        F.substring(F.col("word"), F.length("word") - last + 1, last).alias("end"))


def buckets(words: DataFrame, shortest: int = SHORTEST, limit: int = BUCKET) -> DataFrame:
    """(word, n, m, lo, hi, beginning, end): every word in the buckets where its pairs are."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.filter(F.array(length - 1, length), lambda m: m >= shortest)).alias("m"))
    rows = stored(_halves(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.col("m") + 1)))
    settled = []
    while True:
        counts = rows.groupBy(*_KEY).agg(F.count("*").alias("held"))
        large = stored(counts.where((F.col("held") > limit) & (F.col("hi") - F.col("lo") > 1)).select(*_KEY))
        if large.isEmpty():
            settled.append(rows)
            break
        marked = attach(rows, large.withColumn("splits", F.lit(True)), _KEY, ("word",))
        settled.append(marked.where("splits IS NULL").drop("splits"))
        rows = stored(_halves(marked.where("splits").drop("splits", "beginning", "end")))
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found


class Sorted:
    """Words of several buckets, sorted, as ranges of words that are alike up to a depth.

    ``bucket`` is a number per word; buckets stand one after the other. ``shared`` is how many code points all words of a
    word's bucket have in common at their start.
    """

    def __init__(self, words: list[str], bucket: np.ndarray, shared: np.ndarray) -> None:
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.bucket, self.shared = bucket, shared
        self.lcp = self._prefixes()

    def _char(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code points of words at places; 0, which is no letter, outside."""
        inside = (at >= 0) & (at < self.length[word])
        found = self.flat[np.where(inside, self.start[word] + at, 0)] if len(self.flat) else np.zeros(len(word), np.uint32)
        return np.where(inside, found, 0)

    def _prefixes(self) -> np.ndarray:
        """Code points that a word has in common with the one before it; -1 at a bucket's first word."""
        lcp = np.full(len(self.length), -1, np.int64)
        alive = np.flatnonzero(self.bucket[1:] == self.bucket[:-1]) + 1
        lcp[alive] = self.shared[alive]
        alive = alive[(self.length[alive] > lcp[alive]) & (self.length[alive - 1] > lcp[alive])]
        while len(alive):
            depth = lcp[alive]
            alive = alive[self._char(alive, depth) == self._char(alive - 1, depth)]
            lcp[alive] += 1
            alive = alive[(self.length[alive] > lcp[alive]) & (self.length[alive - 1] > lcp[alive])]
        return lcp

    def one_edit(self, lookups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (looked-up word, word of its bucket) exactly one edit apart."""
        first = np.searchsorted(self.bucket, self.bucket[lookups], side="left")
        last = np.searchsorted(self.bucket, self.bucket[lookups], side="right")
        # (depth, lookup, range, cells): all that is alike costs nothing, one code point less or more costs one
        waiting = {}
        for depth in np.unique(self.shared[lookups]).tolist():
            mine = self.shared[lookups] == depth
            n = int(mine.sum())
            waiting[depth] = (lookups[mine], first[mine], last[mine], np.tile(np.array([[1, 0, 1]], np.int8), (n, 1)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        depth, state = min(waiting, default=0), None
        while waiting or state is not None:
            if depth in waiting:
                new = waiting.pop(depth)
                state = new if state is None else tuple(np.concatenate(x) for x in zip(state, new))
            if state is None:
                depth = min(waiting)
                continue
            q, begin, end, cells = state
            # a word that ends here is the first of its range
            ended = self.length[begin] == depth
            over = self.length[q] - depth + 1
            hit = ended & (over >= 0) & (over <= 2)
            hit[hit] = cells[hit, over[hit]] == 1
            found.append((q[hit], begin[hit]))
            begin = begin + ended
            alive = begin < end
            q, begin, end, cells = q[alive], begin[alive], end[alive], cells[alive]
            starts = np.flatnonzero(self.lcp <= depth)
            low, high = np.searchsorted(starts, begin), np.searchsorted(starts, end)
            times = high - low
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            of = np.repeat(np.arange(len(q)), times)
            which = low[of] + inner
            begin, end, q = starts[which], np.append(starts, len(self.lcp))[which + 1], q[of]
            old = cells[of].astype(np.int16)
            c = self._char(begin, np.full(len(begin), depth))
            length = self.length[q]
            n0 = np.minimum(old[:, 1] + 1, old[:, 0] + (self._char(q, np.full(len(q), depth - 1)) != c))
            n1 = np.minimum(np.minimum(old[:, 1] + (self._char(q, np.full(len(q), depth)) != c), old[:, 2] + 1), n0 + 1)
            n1[depth + 1 > length] = 3
            n2 = np.minimum(old[:, 2] + (self._char(q, np.full(len(q), depth + 1)) != c), n1 + 1)
            n2[depth + 2 > length] = 3
            n0[depth > length] = 3
            rows = np.minimum(np.stack([n0, n1, n2], axis=1), 3).astype(np.int8)
            near = rows.min(axis=1) <= 1
            depth += 1
            state = (q[near], begin[near], end[near], rows[near])
            if not near.any():
                state = None
        return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (lookups[:0], lookups[:0])


def pairs(groups: list[tuple[int, int, int, list[str]]]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(words, a, b) for buckets (m, lo, hi, words): words[a] and words[b] one edit apart, every pair in both directions."""
    texts: list[str] = []
    bucket, shared, m_of, lo_of, hi_of, back = [], [], [], [], [], []
    for number, (m, lo, hi, words) in enumerate(groups):
        backwards = m - hi > lo
        some = sorted(w[::-1] for w in words) if backwards else sorted(words)
        texts += some
        for values, value in ((bucket, number), (shared, max(lo, m - hi)), (m_of, m), (lo_of, lo), (hi_of, hi), (back, backwards)):
            values += [value] * len(some)
    lists = Sorted(texts, np.array(bucket, np.int64), np.array(shared, np.int64))
    m_of, lo_of, hi_of = (np.array(x, np.int64) for x in (m_of, lo_of, hi_of))
    words = [w[::-1] if b else w for w, b in zip(texts, back)]
    plain = Sorted(words, np.arange(len(words)), np.zeros(len(words), np.int64))
    lookups = np.flatnonzero(lists.length == m_of)  # the shorter word of a pair, or either
    for first in range(0, len(lookups), _LOOKUPS):
        a, b = lists.one_edit(lookups[first:first + _LOOKUPS])
        common = np.zeros(len(a), np.int64)
        alive = np.arange(len(a))
        while len(alive):
            x, y, at = a[alive], b[alive], common[alive]
            alive = alive[(at < plain.length[x]) & (at < plain.length[y]) & (plain._char(x, at) == plain._char(y, at))]
            common[alive] += 1
        mine = (common >= lo_of[a]) & (common < hi_of[a])  # else the pair is another bucket's
        a, b = a[mine], b[mine]
        longer = lists.length[b] > m_of[b]
        yield words, np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their bucket to (word, n_near, best): near words in this bucket, and the most frequent of them."""

    def done(groups: list[tuple], counts: list[int]) -> Iterator[pa.RecordBatch]:
        number = dict(zip((w for g in groups for w in g[3]), counts))  # a word has one count in all of its buckets
        for words, a, b in pairs(groups):
            if not len(a):
                continue
            n = np.fromiter((number[w] for w in words), np.int64, len(words))
            rank = np.empty(len(words), np.int64)
            rank[np.array(sorted(range(len(words)), key=words.__getitem__))] = np.arange(len(words))
            order = np.lexsort((rank[b], -n[b], a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in a[first].tolist()]), pa.array(np.diff(np.r_[first, len(a)])),
                 pa.array(n[b[first]]), pa.array([words[i] for i in b[first].tolist()])], names=["word", "n_near", "best_n", "best"])

    at, groups, counts, held = None, [], [], 0
    for batch in batches:
        columns = (batch[c].to_pylist() for c in (*_KEY, "word", "n"))
        for m, lo, hi, beginning, end, word, n in zip(*columns):
            key = (m, lo, hi, beginning, end)
            if key != at:
                if held >= _TOGETHER:
                    yield from done(groups, counts)
                    groups, counts, held = [], [], 0
                at = key
                groups.append((m, lo, hi, []))
            groups[-1][3].append(word)
            counts.append(n)
            held += 1
    if groups:
        yield from done(groups, counts)


def near_words(words: DataFrame, shortest: int = SHORTEST, limit: int = BUCKET) -> DataFrame:
    """(word, n_near, best_n, best) for every word that has words one edit apart."""
    rows = buckets(words, shortest, limit)
    dealt = rows.repartition(partitions(words.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    found = dealt.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far in every round.

    There are as many facts as rows, in proportion to the vocabulary, so neither may be broadcast.
    """
    links = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        above = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = attach_measured(links, above, "root", ("word",), many=True)
        joined = stored(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return links


def group(words: DataFrame, shortest: int = SHORTEST, times: int = TIMES, limit: int = BUCKET) -> DataFrame:
    """Per word of (word, n): word, form, root, n, n_near, form_n."""
    words = stored(words)
    near = words.join(near_words(words, shortest, limit).hint("merge"), "word", "left")  # a word is one row on both sides
    is_form = F.col("best_n") >= times * F.col("n")
    found = stored(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(is_form, F.col("best_n")).alias("form_n")))
    return (found.join(roots(found.where("form IS NOT NULL")).hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


#: Pairs by the two sides of an edit: equal around one code point, or equal to the longer word without one.
ORACLE = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (SELECT run, n, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS b FROM d),
t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
h AS (SELECT run, n, xor(list_reduce(b, lambda c, v: xor(c >> 8, t.crc[(xor(c, v) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h FROM bytes, t),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
o AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM o AS x JOIN o AS y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
      UNION SELECT o.word, v.word, v.n FROM o JOIN v ON v.word = o.a || o.b
      UNION SELECT v.word, o.word, o.n FROM o JOIN v ON v.word = o.a || o.b),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, (-near_n, near)) AS best FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
      FROM v LEFT JOIN g ON g.word = v.word),
r(word, top) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.top WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.top AS root FROM r JOIN f ON f.word = r.top WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word
"""
