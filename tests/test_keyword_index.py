import numpy as np
import pytest

from papyra.operators import hybrid as H
from papyra.operators import keyword_index as KI
from papyra.operators import threshold as TA
from papyra.operators import vectors as V
from papyra.session import checkpoint_dir

PAPERS = "arxiv_id string, title string, abstract string"
WORDS = [f"word{i}" for i in range(40)]


def corpus(spark, n=240, seed=4):
    """Papers of neighbouring ids share words; some vectors are equal, some have no paper."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(WORDS[(i // 12 + int(j)) % 40] for j in rng.integers(0, 3, 6)) + " common" * (i % 2) for i in range(n)]
    papers = spark.createDataFrame([(f"p{i:04d}", t, "The Abstract") for i, t in enumerate(texts) if i % 5], PAPERS)
    base = rng.normal(size=(60, 8))
    emb = spark.createDataFrame([(f"p{i:04d}", "m", [float(x) for x in base[int(rng.integers(0, 60))]]) for i in range(n) if i % 7],
                                "paper_id string, model string, embedding array<float>")
    qs = spark.createDataFrame([(j, f"What about {WORDS[5 * j]} and {WORDS[5 * j + 1]}" + " common" * (j == 3) if j < 5 else "of the unknown",
                                 [float(x) for x in rng.normal(size=8)] if j != 4 else None) for j in range(6)],
                               "question_id long, question string, qvec array<float>")
    return papers, emb, qs


def stored(spark, root, parts, block):
    checkpoint_dir(spark)
    for k, p in enumerate(parts):
        KI.KeywordIndex.add(root, p, k, block_papers=block)
    return KI.KeywordIndex.open(spark, root)


def ranked(df):
    return sorted((r.question_id, r["rank"], r.paper_id, round(r.score, 15)) for r in df.collect())


@pytest.mark.parametrize("top_k", [1, 5, 40])
def test_indexed_hybrid_equals_full(spark, tmp_dir, top_k):
    papers, emb, qs = corpus(spark)
    index = stored(spark, tmp_dir, [papers], 4)
    touched = {}
    got = ranked(TA.search_hybrid_indexed(index, emb, qs, "m", top_k, watch=lambda what, df: touched.update({what: df.count()})))
    assert got == ranked(H.search_hybrid_full(papers, emb, qs, "m", top_k)) and len({g[0] for g in got}) == 5
    if top_k == 1:
        # sorted access of the embedding order stops before its full depth of 62 a question
        assert touched["lookups"] < 5 * H.candidate_depth(1)


def test_newest_segment_of_a_paper_counts(spark, tmp_dir):
    papers, emb, qs = corpus(spark)
    old = papers.where("substr(arxiv_id, 2) % 3 = 0").selectExpr("arxiv_id", "'word5 word6 common' AS title", "abstract")
    index = stored(spark, tmp_dir, [papers.where("substr(arxiv_id, 2) % 3 = 1"), old, papers.where("substr(arxiv_id, 2) % 3 <> 1"), papers.limit(0)], 4)
    assert index.live().count() == papers.count()
    assert ranked(TA.search_hybrid_indexed(index, emb, qs, "m")) == ranked(H.search_hybrid_full(papers, emb, qs, "m"))
    first = KI.KeywordIndex.open(spark, tmp_dir, last=0)
    assert first.live().count() == papers.where("substr(arxiv_id, 2) % 3 = 1").count()


def test_blocks_whose_bound_is_too_small_are_not_read(spark, tmp_dir):
    papers, emb, _ = corpus(spark)
    # question 0 has six papers that hold all three of its words; every other paper at most one
    papers = papers.selectExpr("arxiv_id", "CASE WHEN arxiv_id BETWEEN 'p0100' AND 'p0108' THEN 'alpha beta gamma' ELSE title || ' alpha' END AS title", "abstract")
    qs = spark.createDataFrame([(0, "alpha beta gamma", None)], "question_id long, question string, qvec array<float>")
    index = stored(spark, tmp_dir, [papers], 4)
    universe, asked = index.universe(V.vectors_of(emb, "m")).checkpoint(), KI.question_tokens(qs).checkpoint()
    bound = KI.bounds(index, universe, asked).checkpoint()
    top, read = KI.keyword_top(index, universe, asked, bound, 3)
    full = H.keyword_overlap_sparse(papers, V.vectors_of(emb, "m"), qs).orderBy("overlap", "paper_id", ascending=[False, True]).limit(3).collect()
    assert [(r.paper_id, r.overlap, r.rank_keyword) for r in sorted(top.collect(), key=lambda r: r.rank_keyword)] == [
        (r.paper_id, r.overlap, i) for i, r in enumerate(full)]
    assert {r.overlap for r in full} == {3}
    visited, blocks = {r.block for r in read.collect()}, {r.block: r.bound for r in bound.collect()}
    assert len(blocks) > 20 and visited == {b for b, n in blocks.items() if n == 3} and len(visited) < 10


def test_blocks_hold_a_bounded_number_of_papers(spark, tmp_dir):
    papers, _, _ = corpus(spark)
    index = stored(spark, tmp_dir, [papers], 4)
    assert index.papers.groupBy("block").count().agg({"count": "max"}).first()[0] <= 16
    wide = index.postings.where("n <> size(ids) or first <> ids[0] or last <> ids[size(ids) - 1] or first > last")
    assert wide.count() == 0
