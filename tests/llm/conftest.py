import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest string, node string, anchor string, score string, keys string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with nulls in any column, and columns named like those the operators use inside."""
    def make(rows):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r)), "x", "x", "x", "x", "x", None) for r in rows], DOCS)
    return make
