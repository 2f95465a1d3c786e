import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names operators use themselves."""
    long = " ".join(f"word{i % 997} tail{i % 13}" for i in range(40_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "the cat\nsat on the mat", "en", None), (3, "the cat\nsat on the mat", "en", None),
        (None, "an orphan line", None, "b"), (4, long, "en", "a"), (5, "\n\n \t\n", None, "a"), (6, "日本語 ñandú 😀 Ünïcode", "es", "c"),
    ]
    clash = [(*r[:4], 0, "x", 1, 2.0, "keep") for r in rows]
    schema = f"{DOCS}, spans string, ids int, score double, _t string"
    return spark.createDataFrame(clash, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
