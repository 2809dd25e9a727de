import pytest

LONG = "word other Third 4 " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, and further columns with names that operators use inside."""
    rows = [(1, "", "a"), (2, None, None), (None, "lost text here with five words", "a"), (3, LONG, "b"), (4, "plain one two three four", "a"), (4, "plain one two three four", "a"), (4, "plain one two three four", "a"), (5, "   \n\t ", "b"), (6, "ünïcödé ✓ 日本語 text", "b")]
    df = spark.createDataFrame([(i, t, s, "en", 1) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long")
    clash = ("key", "score", "cell", "fp", "row_no", "component", "text_hash", "position", "slot", "n", "_n", "row_hash", "placements")
    for name in clash:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
