"""Exact bucketed rank equals a plain window rank; pruned hybrid equals the
full-ranking hybrid; RRF and contexts by hand."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import hybrid as H
from papyra.operators import ranking as R
from papyra.sources import testbed as TB

SF = "/root/testdata/sf0.001"


def _window_rank(df, score):
    w = Window.partitionBy("g").orderBy(F.col(score).desc_nulls_last(), F.col("id").asc())
    return df.withColumn("want", (F.row_number().over(w) - 1).cast("long"))


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_rank_similarity(spark, seed):
    rng = np.random.default_rng(seed)
    n = 3000
    s = np.round(rng.uniform(-1, 1, n), 3)          # many exact ties
    s[rng.random(n) < 0.3] = 0.25                     # one hot score value: 30% of rows
    rows = [(int(rng.integers(0, 3)), f"{i:07d}", None if rng.random() < 0.02 else float(v))
            for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "g long, id string, score double")
    got = R.exact_rank(df, ["g"], "score", "id", R.similarity_bucket)
    chk = _window_rank(got, "score").where(F.col("rank") != F.col("want")).count()
    assert chk == 0
    assert got.count() == n


def test_exact_rank_integer(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 2)), f"{i:06d}", int(rng.choice([0, 0, 0, 1, 2, 5]))) for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, id string, overlap long")
    got = R.exact_rank(df, ["g"], "overlap", "id", R.integer_bucket)
    assert _window_rank(got, "overlap").where(F.col("rank") != F.col("want")).count() == 0


def test_exact_rank_plan_has_no_single_partition(spark):
    df = spark.createDataFrame([(0, "a", 0.5)], "g long, id string, score double")
    plan = R.exact_rank(df, ["g"], "score", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_rrf_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (1, 5), (5, 1)], "a long, b long")
    got = [r[0] for r in df.select(R.rrf(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2 / 60)
    assert got[1] == got[2] == 1 / 61 + 1 / 65


def test_candidate_depth_bound():
    # k documents ranked 0..k-1 by embedding beat any document ranked >= M in both lists
    for k in (1, 5, 10):
        m = H.candidate_depth(k)
        assert 2 / (60 + m) < 1 / (60 + k - 1)


@pytest.mark.parametrize("top_k", [1, 5, 20])
def test_pruned_hybrid_equals_full(spark, top_k):
    p, e, q = TB.papers(spark, SF), TB.paper_embeddings(spark, SF), TB.questions(spark, SF)
    fast = H.search_hybrid(p, e, q, "m1", top_k=top_k).toPandas().sort_values(["question_id", "rank"])
    full = H.search_hybrid_full(p, e, q, "m1", top_k=top_k).toPandas().sort_values(["question_id", "rank"])
    assert list(fast.paper_id) == list(full.paper_id)
    assert np.allclose(fast.score.to_numpy(), full.score.to_numpy(), rtol=0, atol=1e-15)


def test_hybrid_k_zero_and_negative(spark):
    p, e, q = TB.papers(spark, SF), TB.paper_embeddings(spark, SF), TB.questions(spark, SF)
    assert H.search_hybrid(p, e, q, "m1", top_k=0).count() == 0
    with pytest.raises(ValueError):
        H.search_hybrid(p, e, q, "m1", top_k=-1)


def test_build_contexts_text(spark):
    qs = spark.createDataFrame([(1, "why?"), (2, "none")], "question_id long, question string")
    ans = spark.createDataFrame([(1, 2, "b", "T [x]\nline", "abs2"), (1, 1, "a", "Title", "abs1")],
                                "question_id long, rank long, arxiv_id string, title string, abstract string")
    got = {r.question_id: r.prompt for r in H.build_contexts(qs, ans).collect()}
    assert got[1] == ("Question: why?\n\nCandidate papers:\n\n1. [a] Title\n   Abstract: abs1"
                      "\n\n2. [b] T [x]\nline\n   Abstract: abs2")
    assert got[2] == "No relevant papers were found to answer this question."


def test_all_zero_overlaps_rank_by_id(spark):
    rows = [(0, f"{i:04d}", 0) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, id string, overlap long")
    got = {r.id: r.rank for r in R.exact_rank(df, ["g"], "overlap", "id", R.integer_bucket).collect()}
    assert got == {f"{i:04d}": i for i in range(50)}


def test_all_scores_equal_rank_by_id(spark):
    rows = [(0, f"{i:04d}", 0.5) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, id string, score double")
    got = {r.id: r.rank for r in R.exact_rank(df, ["g"], "score", "id").collect()}
    assert got == {f"{i:04d}": i for i in range(50)}


def test_exact_rank_hot_tie_with_long_common_prefix(spark):
    rng = np.random.default_rng(7)
    n = 3000
    rows = [(0, f"paper-2024-{i:06d}", 0.5 if rng.random() < 0.34 else float(np.round(rng.uniform(-1, 1), 4)))
            for i in range(n)]
    df = spark.createDataFrame(rows, "g long, id string, score double")
    got = R.exact_rank(df, ["g"], "score", "id")
    assert _window_rank(got, "score").where(F.col("rank") != F.col("want")).count() == 0


def test_exact_rank_ties_split_despite_odd_ids(spark):
    rows = [(0, f"paper-2024-{i:06d}", 0.0) for i in range(3000)] + [(0, "urn:x:1", 0.0), (0, "a", 0.0)]
    df = spark.createDataFrame(rows, "g long, id string, score double")
    levels = R.split_levels(df, "id", 8)
    i1, i2 = R._range_of("id", levels)
    sizes = [r["count"] for r in df.groupBy(i1.alias("a"), i2.alias("b")).count().collect()]
    assert len(sizes) > 32 and max(sizes) < 300
    got = R.exact_rank(df, ["g"], "score", "id", levels=levels)
    assert _window_rank(got, "score").where(F.col("rank") != F.col("want")).count() == 0


def test_pruned_hybrid_equals_full_under_ties(spark):
    import datetime as dt
    rng = np.random.default_rng(21)
    n = 240
    base = rng.normal(size=(40, 8))
    vec = base[rng.integers(0, 40, n)]            # many identical vectors: exact score ties
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    ids = [f"p{i:04d}" for i in range(n)]
    emb = spark.createDataFrame([(i, "m", [float(x) for x in v], 8, dt.datetime(2024, 1, 1))
                                 for i, v in zip(ids, vec)],
                                "paper_id string, model string, embedding array<float>, dim int, "
                                "created_at timestamp_ntz")
    # every third paper has no metadata; most texts share no question word
    papers = spark.createDataFrame(
        [(i, " ".join(rng.choice(words, 2)) if k % 5 == 0 else "plain text here", "abstract")
         for k, i in enumerate(ids) if k % 3],
        "arxiv_id string, title string, abstract string")
    qs = spark.createDataFrame([(j, f"what about {words[j]} and {words[(j + 1) % 5]}",
                                 [float(x) for x in rng.normal(size=8)]) for j in range(5)],
                               "question_id long, question string, qvec array<float>")
    for k in (1, 5, 30):
        fast = H.search_hybrid(papers, emb, qs, "m", top_k=k).toPandas().sort_values(["question_id", "rank"])
        full = H.search_hybrid_full(papers, emb, qs, "m", top_k=k).toPandas().sort_values(["question_id", "rank"])
        assert list(fast.paper_id) == list(full.paper_id), k
        assert np.allclose(fast.score.to_numpy(), full.score.to_numpy(), rtol=0, atol=1e-15)
