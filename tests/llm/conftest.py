import pytest


@pytest.fixture
def frame(spark):
    """A DataFrame of (doc_id, text, lang, source, n_chars) rows and columns with clashing names."""

    def make(texts, schema="doc_id bigint, text string, lang string, source string, n_chars bigint, ids int, words string"):
        rows = [(i, t, "en", "s", len(t or ""), 1, "w") if not isinstance(t, tuple) else (*t, 1, "w") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make


