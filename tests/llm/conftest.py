import random

import pytest

#: Names that operators use inside; a table may have them as columns of its own.
CLASHING = ("tie", "fp", "key", "h", "rank", "position", "component_id", "base_failed", "removed_lines", "kept", "hash",
            "start", "found", "gone", "failed_host", "bucket", "sequence_id", "all", "mixed_id", "n_words", "page", "digest")


def sentence(rng, words=80):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(words))


def edge_rows():
    """(doc_id, text, source): nulls, empty and very long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(11)
    a, b, c = sentence(rng, 120), sentence(rng, 90), sentence(rng, 70)
    long_text = "\n".join(sentence(rng, 12) for _ in range(1500))
    lines = [sentence(rng, 9) for _ in range(8)]
    return [
        (None, None, None), (None, a, "x"), (1, None, "x"), (2, "", "y"), (3, " \t\n\x0b ", "y"), (4, a, "x"), (4, a, "x"),
        (5, a, "y"), (6, a + " " + b, "x"), (7, b + "\n" + a[:150], None), (8, long_text, "x"), (9, long_text + "\ntail", "z"),
        (10, "\n".join(lines), "z"), (11, "\n".join([lines[0].upper(), lines[1] + "!", c, lines[5]]), "z"),
        (12, "é" * 300 + c, "z"), (13, "é" * 300, "y"), (14, c, "x"), (14, b, "x"), (15, "ab" * 200, "x"), (16, c + "\n" + c, None),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The rows with clashing columns beside them, over several partitions."""
    rows = [(*r, "xx", 0, *["?"] * len(CLASHING)) for r in edge_rows()]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def no_documents(edge):
    return edge.where("1 = 0")
