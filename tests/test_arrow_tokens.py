"""Tokens found in Arrow columns are those of ``text.tokenize``; pieces are bounded."""

import io
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from papyra.functions import arrow_tokens as AT
from papyra.functions import text as TX
from papyra.operators import embed as EM
from papyra.operators import hybrid as H
from papyra.operators import keyword_index as KI
from papyra.operators import substring_index as SI
from papyra.operators import vectors as V

ODD = ["", None, "  ", "abc", "ab abc", "The RAG-2 naïve GPT3 the rag", "İSTANBUL Kelvin", "x" * 50, "a b c dd eee", "😀abc😀abc2", "what abc what", "zz9,zz9;zz8\nend"]


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_tokens_equal_tokenize(spark):
    words = ["abc", "Abc", "the", "é", "x1", "x12", "-", "\t", "ab", "zz9"]
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(rng.choice(words, int(rng.integers(0, 30)))) + " ".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    want = {r.id: r.t or [] for r in df.select("id", TX.tokenize("text").alias("t")).collect()}
    assert {r.id: r.tokens for r in AT.with_tokens(df, "text").collect()} == want
    some = ["zz9", "abc", "x12"]
    assert {r.id: r.tokens for r in AT.with_tokens(df, "text", some).collect()} == {i: [x for x in t if x in some] for i, t in want.items()}
    assert all(r.tokens == [] for r in AT.with_tokens(df, "text", []).collect())


def test_slices_are_bounded():
    texts = pa.array(["a" * 10, None, "b" * 3, "c" * 25, "", "d" * 4, "e" * 4], pa.string())
    cut = list(AT.byte_slices(texts, 10))
    assert [a for a, _ in cut] == np.cumsum([0, *[n for _, n in cut]])[:-1].tolist() and sum(n for _, n in cut) == len(texts)
    assert all(n == 1 or sum(len(x or "") for x in texts.slice(a, n).to_pylist()) <= 10 for a, n in cut)
    assert list(AT.byte_slices(texts.slice(7))) == []


def test_whitespace_runs(spark):
    texts = ["a b", " a  b ", "a\t b \n\nc", "a  b", "é è  ê", " ", "x 　 y ", "a  ", "a\x1c\x1d b", "a \té"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(TX.normalize_whitespace("t").alias("n")).collect()]
    assert got == [" ".join(t.split()) for t in texts]


class Crowd:
    """How many texts an encoder sees at once."""

    def encode(self, texts, mode="document"):
        return np.full((len(texts), 1), len(texts), dtype=np.float32)


def test_encoder_holds_little(spark):
    enc = EM.HashingEncoder()
    v = enc.encode([" ".join(f"w{i}x{j}" for j in range(512)) for i in range(200)])
    assert len(enc._cache) <= 1 << 16 and (np.abs(v).sum(axis=1) > 0).all()
    df = spark.range(30).coalesce(1).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("word "), 200_000).alias("text"))
    seen = [r.embedding[0] for r in EM.encode(df, "text", "id", Crowd).collect()]
    assert len(seen) == 30 and max(seen) <= 4


def test_index_lists_are_made_by_block(spark):
    docs = spark.createDataFrame([(0, f"p{i:02d}", i % 3, ["x", f"t{i % 4}"] if i else []) for i in range(24)] + [(0, None, 1, ["x", "lost"])], KI.PAPERS)
    posts = KI.postings_of(docs)
    assert "Generate" not in plan(posts)  # no row per token and paper
    want = {}
    for r in docs.collect():
        for t in r.tokens if r.paper_id else []:
            want.setdefault((t, r.block), []).append(r.paper_id)
    assert {(r.token, r.block): r.ids for r in posts.collect()} == {k: sorted(v) for k, v in want.items()}
    texts = spark.createDataFrame([(f"p{i:02d}", i % 2, "ab" * (i % 3) + "😀") for i in range(12)] + [(None, 0, "ab"), ("p00", 0, None), ("p01", 1, "ab😀")], "paper_id string, block long, text string")
    grams = SI.grams_of(texts)
    assert "Generate" not in plan(grams)
    want = {}
    for r in texts.where("text is not null and paper_id is not null").collect():
        for k in range(4):
            for i in range(len(r.text) - k + 1):
                want.setdefault((r.text[i:i + k], r.block), set()).add(r.paper_id)
    assert {(r.gram, r.block): (r.ids, r.n) for r in grams.collect()} == {k: (sorted(v), len(v)) for k, v in want.items()}


def test_only_papers_that_are_asked_for_are_shaped(spark):
    papers = spark.range(500).select(F.col("id").cast("string").alias("arxiv_id"), *[F.repeat(F.lit(c + " word "), 5).alias(c) for c in ("title", "abstract", "primary_category", "pdf_url", "abs_url")])
    ranked = spark.createDataFrame([(1, "7"), (2, "9"), (2, "nobody")], "question_id long, paper_id string")
    out = H.attach_metadata(ranked, papers)
    assert "BroadcastHashJoin" in plan(out) and "LeftSemi" in plan(out)
    assert sorted((r.question_id, r.arxiv_id) for r in out.collect()) == [(1, "7"), (2, "9")]
    emb = spark.createDataFrame([(i, "m", [1.0, 2.0]) for i in ("7", "9", "gone")], "paper_id string, model string, embedding array<float>")
    qs = spark.createDataFrame([(1, "title word", [1.0, 0.0])], "question_id long, question string, qvec array<float>")
    corpus = H._corpus(papers, V.vectors_of(emb, "m"), qs)
    assert "LeftSemi" in plan(corpus)
    assert {r.paper_id: sorted(r.tokens) for r in corpus.collect()} == {"7": ["title", "word"], "9": ["title", "word"], "gone": []}
