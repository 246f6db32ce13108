import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node long, mark int, v int"
LONG = " ".join(f"word{i % 977}x" for i in range(20000))


def rows(texts, source="s"):
    """Documents with the columns of the table and extra ones whose names clash with inner ones."""
    return [(i, t, "en", source, len(t) if t else None, "clash", 7, 8, 9) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, source="s"):
        return spark.createDataFrame(rows(texts, source), SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty, blank, repeated, very long and null-id rows."""
    return make([(5, None), (3, ""), (4, " \n\t "), (9, LONG), (8, LONG), (8, LONG), (None, "no id here at all, but some words"), (7, "é"), (6, "12 345")])


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
