"""Hybrid retrieval: debiased cosine rank fused with keyword-overlap rank.

For every question, every vector of the model gets an embedding rank and a
keyword rank (0-based, ties by id); the fused score is
1/(k + rank_e) + 1/(k + rank_l).  Papers without metadata still take part
with empty text.  ``ask`` attaches metadata after the top-k cut, so a ranked
vector without a paper row is dropped (fewer than k rows may return).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.arrow_tokens import with_tokens
from papyra.functions.text import tokenize
from papyra.operators import lexical as L
from papyra.operators import ranking as R
from papyra.operators import vectors as V
from papyra.operators.lookup import METADATA_COLS
from papyra.session import ship_package, written

# Fixed texts of the answer prompt.
PROMPT_HEAD = "Question: {q}\n\nCandidate papers:"
PROMPT_ITEM = "\n{i}. [{arxiv_id}] {title}\n   Abstract: {abstract}"
NO_PAPERS = "No relevant papers were found to answer this question."


def scored_pairs(papers: DataFrame, paper_embeddings: DataFrame, questions: DataFrame, model: str,
                 n_components: int = V.DEFAULT_COMPONENTS, basis: V.Basis | None = None) -> DataFrame:
    """(question_id, paper_id, score, overlap) for every question and every
    vector of the model."""
    vecs = V.vectors_of(paper_embeddings, model)
    basis = basis or V.fit_basis(vecs, n_components)
    sims = V.score_corpus(vecs, questions, basis, components=(n_components,)).drop("n_components")
    ov = keyword_overlap_sparse(papers, vecs, questions)
    return (sims.join(ov, ["question_id", "paper_id"], "left")
            .withColumn("overlap", F.coalesce(F.col("overlap"), F.lit(0)).cast("long")))


def keyword_overlap_sparse(papers: DataFrame, vecs: DataFrame, questions: DataFrame) -> DataFrame:
    """Sparse overlaps of the questions with every vector's paper text."""
    texts = L.paper_texts(vecs.select("paper_id"), papers)
    return L.keyword_overlap(L.paper_tokens(texts), L.question_tokens(questions))


def ranked_pairs(pairs: DataFrame, levels=None) -> DataFrame:
    """Both full rankings: adds rank_embedding and rank_keyword (0-based)."""
    er = R.exact_rank(pairs.select("question_id", "paper_id", "score"), ["question_id"], "score",
                      "paper_id", R.similarity_bucket, "rank_embedding", levels=levels)
    lr = R.exact_rank(pairs.select("question_id", "paper_id", "overlap"), ["question_id"], "overlap",
                      "paper_id", R.integer_bucket, "rank_keyword", levels=levels)
    return er.join(lr, ["question_id", "paper_id"])


def fused_scores(papers: DataFrame, paper_embeddings: DataFrame, questions: DataFrame, model: str,
                 n_components: int = V.DEFAULT_COMPONENTS, rrf_k: int = R.RRF_K) -> DataFrame:
    """(question_id, paper_id, rank_embedding, rank_keyword, score) for all pairs."""
    pairs = scored_pairs(papers, paper_embeddings, questions, model, n_components)
    levels = R.split_levels(V.vectors_of(paper_embeddings, model), "paper_id")
    ranked = ranked_pairs(pairs, levels)
    return ranked.withColumn("score", R.rrf(F.col("rank_embedding"), F.col("rank_keyword"), rrf_k))


def search_hybrid_full(papers: DataFrame, paper_embeddings: DataFrame, questions: DataFrame, model: str,
                       top_k: int = 5, n_components: int = V.DEFAULT_COMPONENTS,
                       rrf_k: int = R.RRF_K) -> DataFrame:
    """Top-k fused from the full rankings (reference implementation, used
    to check ``search_hybrid``): (question_id, rank, paper_id, score)."""
    if top_k < 0:
        raise ValueError("top_k must be >= 0")
    fused = fused_scores(papers, paper_embeddings, questions, model, n_components, rrf_k)
    return R.top_k(fused, top_k, ["question_id"], "score", "paper_id").select(
        "question_id", "rank", "paper_id", "score")


HYBRID_SCHEMA = "question_id long, rank long, paper_id string, score double"


def candidate_depth(top_k: int, rrf_k: int = R.RRF_K) -> int:
    """Depth M of each ranking that provably contains the fused top-k.

    The k papers ranked 0..k-1 by embedding each score more than
    1/(rrf_k + k - 1).  A paper ranked >= M in both lists scores at most
    2/(rrf_k + M), which is not more than that once M >= rrf_k + 2k - 2."""
    return rrf_k + 2 * top_k


def _corpus(papers: DataFrame, vecs: DataFrame, questions: DataFrame) -> DataFrame:
    """(paper_id, embedding, tokens): each vector with those distinct tokens of
    its paper's text that occur in a question.  Only papers that have a vector are
    shaped and cut into tokens."""
    vocabulary = questions.select(F.explode(tokenize("question")).alias("t")).agg(F.collect_set("t")).first()[0]
    found = papers.join(vecs.select(F.col("paper_id").alias("arxiv_id")), "arxiv_id", "left_semi")
    texts = with_tokens(found.select(F.col("arxiv_id").alias("paper_id"), F.concat_ws(" ", "title", "abstract").alias("_t")), "_t", vocabulary)
    return (vecs.join(texts, "paper_id", "left")
            .select("paper_id", "embedding", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")))


class _Chunk:
    """Scores and overlaps of a chunk of the corpus for a block of questions,
    slice by slice; rows in id order, so every pass computes the same numbers."""

    SLICE = 2048

    def __init__(self, left: pa.Table, right: pa.Table, basis: V.Basis, k: int):
        self.left, right = left.sort_by("paper_id").combine_chunks(), right.sort_by("question_id")
        self.right = right
        self.qids = right["question_id"].to_numpy()
        qvec = np.array(right["qvec"].to_pylist(), dtype=np.float64)
        self.qp = V.query_residuals(qvec, basis, k) if len(qvec) else qvec
        self.basis, self.k = basis, k
        words = pa.array(sorted({t for row in right["qtokens"].to_pylist() for t in row}), pa.string())
        self.words = words
        self.has = np.zeros((len(words), len(self.qids)), np.float32)
        for q, row in enumerate(right["qtokens"].to_pylist()):
            for i in pc.index_in(pa.array(row, pa.string()), words).to_pylist():
                self.has[i, q] = 1

    def __iter__(self):
        for at in range(0, self.left.num_rows, self.SLICE):
            part = self.left.slice(at, self.SLICE)
            ids = np.asarray(part["paper_id"].to_pylist(), dtype=object)
            x = np.array(part["embedding"].combine_chunks().flatten().to_numpy(), np.float64).reshape(len(ids), self.basis.dim)
            c = x - self.basis.mean
            cum = np.cumsum((c @ self.basis.directions.T) ** 2, axis=1) if self.basis.k else None
            s = V._block_scores(c, np.einsum("ij,ij->i", c, c), cum, self.k, self.qp)
            tokens = part["tokens"].combine_chunks()
            row = np.repeat(np.arange(len(ids)), pc.list_value_length(tokens).to_numpy())
            word = pc.index_in(tokens.flatten(), self.words).fill_null(-1).to_numpy()
            held = np.zeros((len(ids), len(self.words)), np.float32)
            held[row[word >= 0], word[word >= 0]] = 1
            yield ids, np.where(np.isnan(s), -np.inf, s), np.rint(held @ self.has).astype(np.int64)


def _best(basis: V.Basis, k: int, depth: int):
    """Per chunk and question: the ``depth`` best rows by score and by overlap."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left, right, basis, k)
        held = [None] * len(chunk.qids)
        for ids, s, ov in chunk:
            for q in range(len(chunk.qids)):
                a, b, c = ids, s[:, q], ov[:, q]
                if held[q] is not None:
                    a, b, c = (np.concatenate(x) for x in zip(held[q], (a, b, c)))
                keep = np.union1d(V._topk_positions(b, a, depth), V._topk_positions(c.astype(np.float64), a, depth))
                held[q] = (a[keep], b[keep], c[keep])
        rows = [(np.full(len(h[0]), chunk.qids[q]), *h) for q, h in enumerate(held) if h is not None]
        cols = [np.concatenate(c) for c in zip(*rows)] if rows else [[], [], [], []]
        return pa.table({"question_id": pa.array(cols[0], pa.int64()), "paper_id": pa.array(cols[1], pa.string()),
                         "score": pa.array(cols[2], pa.float64()), "overlap": pa.array(cols[3], pa.int64())})
    return run


def _counts(basis: V.Basis, k: int):
    """Per chunk and candidate: how many of its rows come before in either order."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left, right, basis, k)
        probes = chunk.right["cand"].to_pylist()
        coder = V.IdCoder(np.array([p["paper_id"] for row in probes for p in row], dtype=object))
        codes = [coder.codes([p["paper_id"] for p in row]) for row in probes]
        keys = [(np.array([p["score"] for p in row]), np.array([p["overlap"] for p in row], dtype=np.float64)) for row in probes]
        before = [np.zeros((2, len(row)), np.int64) for row in probes]
        for ids, s, ov in chunk:
            mine = coder.codes(ids)
            for q in range(len(probes)):
                before[q][0] += V.count_before(s[:, q], mine, keys[q][0], codes[q], coder.n_codes)
                before[q][1] += V.count_before(ov[:, q].astype(np.float64), mine, keys[q][1], codes[q], coder.n_codes)
        n = [len(row) for row in probes]
        flat = np.concatenate(before, axis=1) if before else np.zeros((2, 0), np.int64)
        return pa.table({"question_id": pa.array(np.repeat(chunk.qids, n), pa.int64()),
                         "paper_id": pa.array([p["paper_id"] for row in probes for p in row], pa.string()),
                         "rank_embedding": pa.array(flat[0], pa.int64()), "rank_keyword": pa.array(flat[1], pa.int64())})
    return run


def search_hybrid(papers: DataFrame, paper_embeddings: DataFrame, questions: DataFrame, model: str,
                  top_k: int = 5, n_components: int = V.DEFAULT_COMPONENTS,
                  rrf_k: int = R.RRF_K) -> DataFrame:
    """Exact fused top-k without ranking the whole corpus, as one lazy plan.

    The corpus is dealt into chunks by hash, the questions into blocks; each
    (chunk, block) is one task.  A first pass scores it and keeps the best M rows
    of either order; the best M over all chunks are the candidates.  A second
    pass over the same exchange counts, for each candidate, the rows of the chunk
    that come before it; the sums over chunks are its exact ranks.  What moves is
    the corpus once and chunks x questions x 2M small rows; (question, paper) pairs
    exist only inside a task, a slice at a time.  Questions without a vector find
    nothing."""
    if top_k < 0:
        raise ValueError("top_k must be >= 0")
    spark = questions.sparkSession
    ship_package(spark)
    vecs = V.vectors_of(paper_embeddings, model)
    basis = V.fit_basis(vecs, n_components)
    if basis.n == 0 or top_k == 0:
        return spark.createDataFrame([], HYBRID_SCHEMA)
    k = min(V.capped_components(n_components, basis.n, basis.dim), basis.k)
    depth = candidate_depth(top_k, rrf_k)
    asked = questions.where(F.col("qvec").isNotNull())
    blocks = max(1, -(-asked.count() // V.QUESTIONS_PER_BLOCK))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, column: str, parts: int, other: str, others: int) -> DataFrame:
        return df.withColumn(column, F.pmod(F.xxhash64(df.columns[0]), F.lit(parts)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    grid = ["_chunk", "_block"]
    corpus = dealt(_corpus(papers, vecs, asked), "_chunk", n, "_block", blocks).repartition(n, *grid)
    qs = asked.select("question_id", F.col("qvec").cast("array<double>").alias("qvec"), tokenize("question").alias("qtokens"))
    best = corpus.groupBy(*grid).cogroup(dealt(qs, "_block", blocks, "_chunk", n).groupBy(*grid)).applyInArrow(
        _best(basis, k, depth), "question_id long, paper_id string, score double, overlap long")
    by = Window.partitionBy("question_id")
    place = [F.row_number().over(by.orderBy(F.desc(c), "paper_id")) for c in ("score", "overlap")]
    cand = best.withColumns({"_e": place[0], "_l": place[1]}).where((F.col("_e") <= depth) | (F.col("_l") <= depth))
    probes = qs.join(cand.groupBy("question_id").agg(F.collect_list(F.struct("paper_id", "score", "overlap")).alias("cand")),
                     "question_id")
    ranks = corpus.groupBy(*grid).cogroup(dealt(probes, "_block", blocks, "_chunk", n).groupBy(*grid)).applyInArrow(
        _counts(basis, k), "question_id long, paper_id string, rank_embedding long, rank_keyword long")
    ranks = ranks.groupBy("question_id", "paper_id").agg(F.sum("rank_embedding").alias("_e"), F.sum("rank_keyword").alias("_l"))
    fused = ranks.withColumn("score", R.rrf(F.col("_e"), F.col("_l"), rrf_k))
    return R.top_k(fused, top_k, ["question_id"], "score", "paper_id").select("question_id", "rank", "paper_id", "score")


def attach_metadata(ranked: DataFrame, papers: DataFrame) -> DataFrame:
    """Inner join after the cut (questions x k rows): ids without a paper row
    vanish.  The ranked rows are written first: Spark then knows how few they are,
    and only the papers among them are shaped."""
    ranked = written(ranked, "ranked")
    meta = papers.join(ranked.select(F.col("paper_id").alias("arxiv_id")), "arxiv_id", "left_semi").select(*METADATA_COLS)
    return ranked.join(meta, ranked.paper_id == meta.arxiv_id, "inner").drop("paper_id")


def ask(papers: DataFrame, paper_embeddings: DataFrame, questions: DataFrame, model: str,
        top_k: int = 5) -> DataFrame:
    """Questions -> top-k papers with metadata and fused score."""
    hits = search_hybrid(papers, paper_embeddings, questions, model, top_k=top_k)
    return attach_metadata(hits, papers).select(
        "question_id", "rank", *METADATA_COLS, "score")


def build_contexts(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One prompt per question from its ranked papers; a question with no
    papers gets the fixed no-papers sentence.  Each question holds at most
    top-k papers, so the per-question list is bounded."""
    fmt = (PROMPT_ITEM.replace("{i}", "%d").replace("{arxiv_id}", "%s")
           .replace("{title}", "%s").replace("{abstract}", "%s"))
    per_q = (answers.groupBy("question_id")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "arxiv_id", "title", "abstract")))
                  .alias("_items")))
    head = F.format_string(PROMPT_HEAD.replace("{q}", "%s"), F.col("question"))
    # papers are numbered 1.. in rank order among those present
    body = F.array_join(F.transform("_items", lambda s, i: F.format_string(
        fmt, i + 1, s["arxiv_id"], s["title"], s["abstract"])), "\n")
    return (questions.select("question_id", "question").join(per_q, "question_id", "left")
            .select("question_id",
                    F.when(F.size(F.coalesce("_items", F.array())) > 0,
                           F.concat(head, F.lit("\n"), body)).otherwise(F.lit(NO_PAPERS)).alias("prompt")))
