import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts, ids counted from 1 unless (id, text) pairs are given."""

    def make(*texts, source="s", lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, 1)]
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], DOCS)

    return make
