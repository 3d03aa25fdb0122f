import random

import pytest

WORDS = "stone river cloud paper green seven window harbour table music candle orange silver winter garden mirror".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows():
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows, near and exact copies."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    near = base.split()
    near[30] = "changed"
    long = sentence(rng, 30_000)
    return [
        (1, base, "a"), (2, base.upper(), "a"), (3, " ".join(near), "b"), (4, base, None), (4, base, None),
        (5, None, "b"), (6, "", "b"), (7, " \t\n\x0b ", "c"), (None, "Alone with no id", "c"), (None, base, "a"), (None, None, None),
        (8, "One two", "c"), (9, "one TWO", "c"), (10, long, "a"), (11, long + " tail", "b"), (12, "Été ÀÉ naïve ß", "c"),
        (13, "x" * 50_000, "c"), (14, sentence(rng, 5), "c"), (15, sentence(rng, 4), "b"),
    ] + [(100 + i, sentence(rng, 5 + 7 * i), rng.choice("abc")) for i in range(25)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names operators use inside."""
    rows = [(d, t, s, "en", 0, 7, "z", 1.5, True) for d, t, s in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size long, key string, n double, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
