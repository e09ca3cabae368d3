import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, k int, key string, id long, tag int, runs string, size string, words string, b string, x string, score string, u string, block string"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); further columns carry names that operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 1, "k", 1, 1, "r", "s", "w", "b", "x", "s", "u", "b") for r in rows], DOCS)


def prose(rnd, n, words=None):
    words = words or ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta", "iota", "tau"]
    return " ".join(rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(n))


def hard_rows():
    """Nulls everywhere, empties, one-word and very long texts, copies, repeated rows, ties."""
    rnd = random.Random(5)
    a, b = prose(rnd, 80), prose(rnd, 60)
    shared = prose(rnd, 30)
    long = prose(rnd, 30_000)
    return [
        (1, a, "en", "s1"),
        (2, a, "en", "s1"),
        (3, a + " tail", "en", None),
        (4, None, "en", "s2"),
        (5, "", "de", "s2"),
        (6, " \t\n\x0b\x0c\r ", None, "s2"),
        (7, "word", "de", "s3"),
        (8, "two words", "de", "s3"),
        (9, long, "en", "s3"),
        (10, f"{b} {shared}", "en", "s1"),
        (11, f"{shared} {prose(rnd, 40)}", "en", "s1"),
        (11, f"{shared} {prose(rnd, 40)}", "en", "s1"),
        (12, b, "en", "s1"),
        (12, b, "en", "s1"),
        (None, a, "en", "s1"),
        (None, None, None, None),
        (13, "na na " * 200, "en", "s2"),
        (14, "naïve Ünïcode 中文   x 😀 " * 20, "en", "s2"),
    ]


@pytest.fixture(scope="module")
def hard(spark):
    return documents(spark, hard_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, []).limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (9, 1, 0), (10, 1, 1), (12, 0, 1), (13, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
