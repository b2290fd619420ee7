import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rep string, text_key string, row_key string, n_shingles string"


def prose(rng, words):
    syll = ["ka", "lo", "mi", "tre", "son", "ver", "dal", "pi", "qua", "est"]
    return " ".join("".join(rng.choices(syll, k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(3)
    a, b, shared = prose(rng, 120), prose(rng, 200), prose(rng, 90)
    texts = [
        (1, a), (2, a), (3, a + " zz"), (4, "ka " + a), (5, b), (6, b.upper()), (7, None), (8, ""), (9, " \n\t "), (10, "one two"), (11, "One  two"), (12, "x" * 5000), (13, "ab" * 3000),
        (14, prose(rng, 50) + " " + shared + " " + prose(rng, 60)), (15, prose(rng, 40) + " " + shared), (16, prose(rng, 20000)), (None, a), (None, None), (17, "dup"), (17, "dup"), (18, "é" * 700), (19, "日本 テスト▁ ☃"),
        (20, prose(rng, 30)), (20, prose(rng, 31)),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None, None if t is None else len(t), "s", "r", "k", "w", "n") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
