import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text, lang, source, n_chars) from rows of (doc_id, text[, lang, source])."""

    def make(rows):
        full = [(r + (None,) * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], "doc_id long, text string, lang string, source string, n_chars long")

    return make
