import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, score string, c0 string, _id string, _sha string"
WORDS = [f"w{i}" for i in range(60)]


def passage(start, n):
    return " ".join(WORDS[(start + 7 * i) % 60] + str((start + i) % 11) for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  two"), (6, passage(3, 60)), (7, passage(3, 60)), (7, passage(3, 60)),
        (8, "x " + passage(3, 60) + " y"), (9, passage(5, 30) + "\n" + passage(9, 40)), (None, passage(5, 30) + "\n" + passage(9, 40)),
        (10, " ".join(passage(i, 50) for i in range(300))), (11, "same " * 80), (None, None), (12, "12345 !!! ???"), (13, "ÄÖÜ straße 東京 " * 9),
    ]
    rows = [(i, t, None if i == 4 else "en", None if i == 5 else "s", None, "f", "s", "c", "i", "h") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
