import random

import pytest
from pyspark.sql import functions as F

from beaconaudit.functions import globs
from beaconaudit.sources import corpus


@pytest.mark.parametrize("seed", range(4))
def test_sets_ask_what_the_pattern_asks(spark, seed, monkeypatch):
    rng = random.Random(seed)
    def word(extra=""):
        return "".join(rng.choice("ab." + extra) for _ in range(rng.randint(1, 3)))
    some = ["**", "*", "/", "a/", "a//**", "/a", "*/", "[ab]*", "*.b", "a*", "a/b/**", "a/*", "*a/b", "**/a", "*.a.b", "b**", "a/b/", "a?"]
    some += ["/".join(word("*?") for _ in range(rng.randint(1, 3))) + rng.choice(["", "/**", "/*", "/", "*"]) for _ in range(25)]
    paths = sorted({"/".join(word() for _ in range(rng.randint(1, 4))) for _ in range(200)})
    frame = spark.createDataFrame([(p,) for p in paths], "rel string")
    for chosen in (rng.sample(some, 6), some[3:9], some):
        monkeypatch.setattr(globs, "MANY", 10**9)
        plain = {r["rel"] for r in frame.where(globs.ignored(F.col("rel"), chosen)).collect()}
        monkeypatch.setattr(globs, "MANY", 1)
        assert {r["rel"] for r in frame.where(globs.ignored(F.col("rel"), chosen)).collect()} == plain, chosen


def test_each_glob_alone(spark, monkeypatch):
    monkeypatch.setattr(globs, "MANY", 1)
    paths = ["a", "a/b", "a/b/c.d", "b/a", "b/a/c", "x.c.d", "x.c.d/y", "c.d", "ab", "ab/c", "a/bc", ".d", "q/.d/e"]
    frame = spark.createDataFrame([(p,) for p in paths], "rel string")
    for glob in ("a", "a/", "a/**", "a/*", "a/b", "a/b/**", "*.d", "*.c.d", "a*", "*b", "?", "a/b*", "*/a", "**", "a//*"):
        pattern = globs.ignore_pattern([glob])
        plain = {r["rel"] for r in frame.where(F.col("rel").rlike(pattern)).collect()}
        assert {r["rel"] for r in frame.where(globs.ignored(F.col("rel"), [glob])).collect()} == plain, glob


def test_plain_globs_make_no_pattern():
    sets = globs.glob_sets(["node_modules/**", "*.min.js", "src/gen/**", "src/a.ts", "README.md", "x/*.ts", "build*"])
    assert sets.components == ("README.md", "node_modules") and sets.suffixes == (".min.js",)
    assert sets.prefixes == ("src/gen/",) and sets.paths == ("README.md", "src/a.ts") and sets.patterns == ("build*", "x/*.ts")


def test_paths_outside_are_ignored_with_many_globs(spark):
    files = spark.createDataFrame([("/p", "/p/src/a.ts"), ("/p", "/q/a.ts"), ("/p", "/p/gen5/a.ts")], "project_path string, path string")
    kept = corpus.ignore_filter(files, [f"gen{i}/**" for i in range(500)])
    assert [r["path"] for r in kept.collect()] == ["/p/src/a.ts"]
