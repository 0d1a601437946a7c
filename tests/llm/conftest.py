"""Small documents of made-up words, and an odd table that every operator must take."""

import random

import pytest

LETTERS = {"en": "thndeaoris", "de": "schberuöin", "fr": "éauxletmoi"}


def words(rng, lang="en", n=60):
    a = LETTERS[lang]
    return ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def sentence(rng, lang="en", n=60):
    return " ".join(words(rng, lang, n))


@pytest.fixture
def rng():
    return random.Random(5)


#: (doc_id, text, lang, source): nulls in every column, empty, blank, very long and repeated texts, ties.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t", None, "b"), (None, "the red cat sat on the red mat", "en", None), (4, "x", "en", "a"), (4, "x", "en", "a"),
    (5, "12345 !!! 678", "en", "b"), (6, "the red cat sat on the red mat", "en", "a"), (7, "Ünïcode 漢字 \U0001f600 text", "de", "c"), (8, "word " * 30_000, "en", "c"), (9, "a" * 100_000, "en", "c"),
    (10, "the red cat sat on the red mat", "fr", "a"), (11, "\u0000 nul �", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["score", "row", "block", "own_key", "own_id", "nth", "tox_score", "lang_bits", "n_tokens", "epoch", "draw", "bucket", "label", "held_out", "text_key", "p", "cell"]
    return odd.withColumns({n: F.lit(n) for n in names})
