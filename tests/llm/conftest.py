import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "sa") for b in ("r", "st", "n", "ld", "pe", "zi", "mo")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward() -> list[tuple]:
    """Rows of (doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, repeated rows, other scripts."""
    base = prose(1, 120)
    shared = prose(2, 60)
    rows = [
        (1, base, "en"),
        (2, base, "en"),
        (3, base.replace("kar", "kör", 1), "en"),
        (4, None, "en"),
        (5, "", None),
        (6, " \n\t ", "fr"),
        (7, prose(3, 30) + " " + shared + " " + prose(4, 30), "fr"),
        (8, prose(5, 40) + "\n" + shared, None),
        (9, "aaaa " * 300, "en"),
        (10, "x" * 5000, "en"),
        (11, prose(6, 20000), "fr"),
        (12, "zażółć gęślą jaźń 日本語のテキスト 🙂 é", "pl"),
        (13, "one two", "en"),
        (13, "one two", "en"),
        (None, prose(7, 50), "en"),
        (None, base, None),
        (14, "1234 5678 !!! ???", "en"),
        (15, base + " " + prose(8, 10), "en"),
        (16, "one two", "en"),
    ]
    return [(i, t, lang, f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t, lang in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """The awkward rows with more columns, whose names are those of results and of inner columns."""
    from pyspark.sql import functions as F

    names = ["score", "held_out", "lang_pred", "node", "file", "chunk", "row", "n_tokens", "ids", "rank", "label", "y", "x", "tag"]
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
