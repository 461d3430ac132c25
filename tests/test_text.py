"""Whitespace, tokens, labels: expected values from Python's own semantics."""

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as TX

WS_CASES = [
    "a b", "a b", "a\u0085b", "a\u001cb", "a\x0bb", "a\r\nb\n", "  lead and trail  ",
    "tabs\tand\x0cfeeds", "　ideographic　", "plain", "", "   ",
]


def test_whitespace_matches_python_split(spark):
    df = spark.createDataFrame([(s,) for s in WS_CASES], "t string")
    got = [r[0] for r in df.select(TX.normalize_whitespace("t")).collect()]
    assert got == [" ".join(s.split()) for s in WS_CASES]


def _py_tokens(text):
    import re
    stop = set(TX.STOPWORDS)
    out = []
    for w in re.findall(r"[a-zA-Z0-9]+", text.lower()):
        if w not in stop and len(w) > 2 and w not in out:
            out.append(w)
    return out


@pytest.mark.parametrize("text", ["naïve approach", "RAG-2 and GPT3 models", "what is the how",
                                  "", "repeat repeat REPEAT words", "Café déjà vu über"])
def test_tokenize(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(TX.tokenize("t")).collect()[0][0]
    assert got == _py_tokens(text)


def test_stopwords_fixed():
    assert len(TX.STOPWORDS) == 27
    assert len([w for w in TX.STOPWORDS if len(w) > 2]) == 18


def test_paper_label(spark):
    df = spark.createDataFrame([("1", "T", ["a", "b", "c", "d"]), ("2", "U", ["x"]), ("3", "V", [])],
                               "id string, title string, authors array<string>")
    got = [r[0] for r in df.select(TX.paper_label("id", "title", "authors")).orderBy("id").collect()]
    assert got == ["[1] T (a, b, c et al.)", "[2] U (x)", "[3] V ()"]


def test_title_contains_ascii_only(spark):
    df = spark.createDataFrame([("Diffusion Models",), ("ÉTUDE",), ("étude",)], "t string")
    hits = [r[0] for r in df.where(TX.title_contains("t", "DIFFUSION")).collect()]
    assert hits == ["Diffusion Models"]
    # ASCII folding only: 'É' does not match 'é'
    assert [r[0] for r in df.where(TX.title_contains("t", "étude")).collect()] == ["étude"]
