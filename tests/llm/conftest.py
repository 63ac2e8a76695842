import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with the other columns and one more whose name clashes with an operator's."""

    def make(rows, lang="en"):
        full = [(i, t, lang, f"src{k % 20}", None if t is None else len(t), "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words string")

    return make


#: Nulls, empty and very long texts, ties and repeated rows.
AWKWARD = [(1, "the cat sat on the mat " * 3), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 50_000), (6, "ab cd " * 20_000), (None, "no id here at all"), (7, "same words same words"), (8, "same words same words"), (7, "same words same words"), (9, "naïve 日本語   text")]
