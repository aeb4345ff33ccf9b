import pytest

from creditlake.session import apply_job_conf


@pytest.fixture(autouse=True)
def _conf(spark):
    apply_job_conf(spark)


EDGE_TEXTS = [
    None, "", " \t\n", "one", "one two", "a b c", "a b c a b c a b c", "Ünï cødé wörds ▁ here \U0001F600 ok",
    "same text again and again", "same text again and again", "x" * 5000, "w " * 3000, "line\nline\n\nline\n \nother",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows,
    an extra column and one whose name clashes with an output."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t) if t else None, "x", 7)
            for i, t in enumerate(EDGE_TEXTS)]
    rows.append(rows[8])
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, extra string, kept int")
