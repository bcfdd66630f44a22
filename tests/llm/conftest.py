import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def make(spark):
    def build(rows):
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def given(spark):
    """Rows of the smallest given table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long_text = "lorem ipsum dolor sit amet consectetur " * 6000
    return make(
        [
            (1, "One two three four five six.", "en", "a", 28), (2, "one TWO three four five six.", "en", "a", 28),
            (2, "one TWO three four five six.", "en", "a", 28), (3, None, "en", "a", 0), (4, "", None, None, 0),
            (None, "one two three four five six.", "en", "b", 28), (None, None, None, None, None),
            (5, long_text, "la", "b", len(long_text)), (6, long_text + "end", "la", None, len(long_text) + 3),
            (7, "... 123 ...", None, "b", 11), (8, "été à la plage", "fr", "c", 14), (9, "\t\n \x1c", "fr", "c", 4),
        ]
    )


@pytest.fixture(scope="session")
def answer():
    """Run one of the SQL counterparts over a table of documents."""

    def run(sql, df):
        connection = duckdb.connect()
        connection.register("documents", df.toArrow())
        found = connection.execute(sql)
        names = [d[0] for d in found.description]
        return [dict(zip(names, row)) for row in found.fetchall()]

    return run
