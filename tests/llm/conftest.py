import os
import sys
import random

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, spans int, value int, word int, " \
         "quality string, toxic string, held_out int, component_id string, kept string, host string, item_id string"


def words(n, seed=0, letters="abcdefgh"):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    texts = [
        (1, "One small text, with password = \"abcdef0123456789abcd\".", "en", "a"),
        (1, "One small text, with password = \"abcdef0123456789abcd\".", "en", "a"),
        (2, None, None, None),
        (3, "", "en", None),
        (None, "no number here", None, "a"),
        (4, "x" * 120_000, "en", "a"),
        (5, words(30_000), "de", "b"),
        (6, " \n\t \x0b ", "de", "b"),
        (7, "é ñ 日本 \x1c ́ ß  double  spaces\r\nand more", "fr", "b"),
        (8, "###!!", "fr", "b"),
        (9, "One small text, with password = \"abcdef0123456789abcd\".", "en", "a"),
    ]
    return [(d, t, lang, s, None, "clash", "clash", 1, 2, 3, "clash", "clash", 4, "clash", "clash", "clash", "clash") for d, t, lang, s in texts]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 10)] + [(1, 1, 0), (None, 1, 1), (2, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
