import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double, rid bigint"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names the code uses."""
    long_text = " ".join(f"word{i % 700}" for i in range(20_000))
    plain = "the quick brown fox jumps over the lazy dog and then it sleeps all day long"
    texts = [(1, plain), (1, plain), (2, plain), (3, None), (None, plain), (None, None), (4, ""), (5, " \n\t "), (6, long_text),
             (7, "one two"), (8, "One two"), (9, "a\nb\na\n\nb"), (10, plain + " again"), (11, "é漢字😀 \x00 x"), (7, "another text")]
    rows = [(i, t, "en" if i else None, None, None if t is None else len(t), "k", 0.5, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
