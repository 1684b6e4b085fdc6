import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard_id string, id long, a string, block int, node string, key string, h string, n long, toxic int, part string, __h long, __bits int, __id long, __row long, __sharded string, range int, group string, links long"


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{int(r.paretovariate(0.9)) % vocabulary}" for _ in range(n)]


def clashing(rows):
    """(doc_id, text, lang, source) rows with columns whose names the operators might use themselves."""
    return [(i, t, la, s, None if t is None else len(t), 0.5, "x", 7, "a", 1, "n", "k", "h", 3, 1, "p", 1, 2, 3, 4, "s", 5, "g", 6) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, one id with two texts."""
    long = " ".join(words(99, 60_000, 5000))
    rows = [
        (None, "a text whose id is missing altogether here", "en", "s1"), (1, None, "en", "s1"), (2, "", "en", None), (3, "  \n\t ", None, "s2"),
        (4, long, "en", "s1"), (5, " ".join(words(1, 80)), "en", "s1"), (5, " ".join(words(1, 80)), "en", "s1"), (6, "word", "de", "s2"),
        (7, " ".join(words(2, 60)), None, None), (7, " ".join(words(3, 60)), "fr", "s3"), (8, "ß É ñ 漢字 🙂", "xx", "s1"), (None, None, None, None),
    ]
    return spark.createDataFrame(clashing(rows), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
