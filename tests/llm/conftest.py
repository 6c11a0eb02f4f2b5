import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts or (doc_id, text, lang, source), with an extra column of a clashing name."""

    def make(rows, extra="score"):
        full = []
        for k, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (k, row)
            doc_id, text, lang, source = (*row, "en", "s")[:4] if len(row) == 2 else row
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x"))
        return spark.createDataFrame(full, f"{DOCUMENTS}, {extra} string")

    return make
