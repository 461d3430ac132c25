import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, count int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta\nShared  line\n" + passage, "en", "a", 5),
        (2, "alpha beta gamma delta epsilon zeta\nshared  line \nother end " + passage, "en", "b", 5),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (5, " \t\n \n", "de", "b", 5),
        (6, "one two", None, "a", 7),
        (7, "ONE two", "en", None, 7),
        (8, "\n".join(["word " * 2000 + "idiot ▁ é 日本"] * 20), "en", "c", None),
        (8, "\n".join(["word " * 2000 + "idiot ▁ é 日本"] * 20), "en", "c", None),
        (None, "Shared  line\nno id " + passage, "fr", "c", 3),
        (None, None, None, None, None),
    ]
    rows += [(100 + i, f"Shared  line\nown text of number {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "b", 9)
             for i in range(12)]
    return spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
