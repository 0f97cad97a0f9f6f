import pytest

from geomarket.llm.tables import documents


@pytest.fixture(scope="session")
def small_docs(spark, small_dir):
    return documents(spark, small_dir).select("doc_id", "text")


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"word{k % 977} and more text, number {k}" for k in range(20_000))
    rows = [(1, "", "en"), (2, None, None), (None, "no id at all " * 30, "en"), (3, long, "de"), (4, " \n\t ", "en"),
            (5, "twice the same row " * 20, "fr"), (5, "twice the same row " * 20, "fr"), (6, "é梦Ω𝄞 ünï", None)]
    schema = "doc_id long, text string, lang string"
    return spark.createDataFrame(rows, schema).selectExpr(
        "*", "lang as source", "length(text) as n_chars", "1 as key", "2 as node", "3 as terms", "4 as spans",
        "5 as n", "6 as part", "7 as document", "8 as hash", "9 as score", "10 as hit_words", "11 as item_ids")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
