import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""
    def make(rows, extra=""):
        full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], SCHEMA)
        # Columns whose names clash with the operators' own.
        return df.selectExpr("*", "'x' AS _id", "1 AS _text", "2 AS size", "3 AS component_id")
    return make
