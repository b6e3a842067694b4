import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts (ids in order) or from (doc_id, text) pairs, with the given columns and two that clash with results."""

    def make(rows, extra=True):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        made = [(i, t, "en", "src", len(t or ""), "mine", 7) for i, t in pairs]
        df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int")
        return df if extra else df.drop("score", "n_words")

    return make


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
