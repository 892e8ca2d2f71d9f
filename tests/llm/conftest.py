import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, bucket string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, tiny and very long texts, repeated rows, and columns with clashing names."""
    words = "the quick brown fox jumps over a lazy dog while seven wise owls watch from the old oak tree by the river".split()
    long = " ".join(words[i % 21] + str(i % 97) for i in range(30_000))
    texts = [None, "", "   \n\t ", "a", "Two words", " ".join(words), " ".join(words), " ".join(words[:-1] + ["bridge"]), long, "é" * 5, "<s>▁x</s>", "unbroken" * 4000, "1234 5678"]
    rows = [(i, t, "en" if i % 2 else None, None, None, 1.0, 2, "b", "k") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id at all here", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(13)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
