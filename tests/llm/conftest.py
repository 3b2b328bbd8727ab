import duckdb
import pytest

SF = "/root/testdata/sf0.001"

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def plain_docs():
    """The same rows as plain tuples (doc_id, text, lang, source)."""
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long_text = "alpha beta gamma delta " * 60_000
    rows = [
        (1, "the quick brown fox", "en", "a", 19), (1, "the quick brown fox", "en", "a", 19),
        (2, None, "en", "a", None), (3, "", "en", None, 0), (4, "the quick brown fox", None, "b", 19),
        (None, "le renard brun est vif", "fr", "b", 22), (None, None, None, None, None),
        (5, long_text, "en", "c", len(long_text)), (6, "12345 !!! 67", "fr", "c", 12), (7, "été là ça", "fr", "c", 9),
        (8, "\x00 ퟿ \U0001f600 a\x0bb", "fr", "c", 9),
    ]
    docs = spark.createDataFrame(rows, DOC)
    for name in ("size", "score", "lang_pred", "shard", "slot", "fp", "target", "taken", "length", "rank", "spans", "held_out", "count", "chunk"):
        docs = docs.selectExpr("*", f"'x' as {name}")
    return docs


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC)
