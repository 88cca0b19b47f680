import pytest

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
BASE = "It was a bright cold day in April and the clocks were striking thirteen while Winston Smith slipped quickly through the glass doors of the mansions"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, tie string, fp string, host string, score string, blob string, `group` string"


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with the operators' own names."""
    texts = [(1, BASE, "s1"), (2, BASE, "s1"), (3, BASE.replace("bright", "dull"), "s2"), (4, None, "s2"), (5, "", None), (6, " \n\t ", "s1"), (None, "no id " + BASE, None), (7, LONG, "s3"), (8, "x", "s3"), (1, BASE, "s1"), (None, None, None), (9, "one\ntwo\nthree", "é"), (9, "other text under the same id", "é")]
    rows = [(i, t, None, s, None if t is None else len(t), 7, "t", "f", None, "z", "b", "g") for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
