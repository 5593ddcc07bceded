import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "code string, label int, id string, row string, size int, part int, `a.b` string"
)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names clash."""

    def make(rows):
        full = [(*r, None if r[1] is None else len(r[1]), "x", 1, "y", "z", 2, 3, "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
