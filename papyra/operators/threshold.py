"""Hybrid search over stored keyword postings, by the threshold algorithm.

The two sorted orders of a question are read only as deep as its stop bound asks,
and no paper text is read:

1. the ``M`` best papers by keyword overlap with their exact ranks, from the blocks
   whose overlap bound can hold one (``keyword_index``);
2. one pass over the vectors, which gives the ``M`` best by score and counts, for
   each paper of step 1, the vectors that come before it: its exact embedding rank;
3. papers of step 1 now have both ranks.  The k-th best fused score among them is the
   bound T.  In the embedding order, a paper at rank r that step 1 did not find has a
   keyword rank of M or more, so sorted access stops where 1/(c+r) + 1/(c+M) < T;
4. the few papers left get their keyword rank from the postings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators import keyword_index as K
from papyra.operators import ranking as R
from papyra.operators import vectors as V
from papyra.operators.hybrid import HYBRID_SCHEMA, candidate_depth
from papyra.session import checkpoint_dir, ship_package

CHUNK_ROWS = 8192  # vectors of one task
SLICE = 2048


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _prepared(x: np.ndarray, basis: V.Basis):
    c = x - basis.mean
    return c, np.einsum("ij,ij->i", c, c), np.cumsum((c @ basis.directions.T) ** 2, axis=1) if basis.k else None


def pair_scores(pairs: DataFrame, vecs: DataFrame, questions: DataFrame, basis: V.Basis, k: int) -> DataFrame:
    """(question_id, paper_id, score) of given (question_id, paper_id)."""
    rows = pairs.select("question_id", "paper_id").join(vecs, "paper_id").join(
        questions.select("question_id", F.col("qvec").cast("array<double>").alias("qvec")), "question_id")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c, sq, cum = _prepared(_matrix(b["embedding"], basis.dim), basis)
            qp = V.query_residuals(_matrix(b["qvec"], basis.dim), basis, k)
            den = np.sqrt(np.maximum(sq - cum[:, k - 1] if k else sq, 0.0)) + V.EPS
            s = np.round(np.einsum("ij,ij->i", c, qp) / den, V.SCORE_DECIMALS)
            yield pa.RecordBatch.from_arrays([b["question_id"], b["paper_id"], pa.array(np.where(np.isnan(s), -np.inf, s))],
                                             ["question_id", "paper_id", "score"])

    return rows.select("question_id", "paper_id", "embedding", "qvec").mapInArrow(run, "question_id long, paper_id string, score double")


def _pass(basis: V.Basis, k: int, depth: int):
    """Per chunk and question: the ``depth`` best rows by score (kind 0), and for each
    probe how many rows come before it (kind 1)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("paper_id").combine_chunks(), right.sort_by("question_id")
        qids = right["question_id"].to_numpy()
        qp = V.query_residuals(np.array(right["qvec"].to_pylist(), np.float64), basis, k) if len(qids) else np.zeros((0, basis.dim))
        probes = [row or [] for row in right["probes"].to_pylist()]
        names = [np.array([p["paper_id"] for p in row], dtype=object) for row in probes]
        keys = [np.array([p["score"] for p in row], np.float64) for row in probes]
        coder = V.IdCoder(np.concatenate([np.zeros(0, object), *names]))
        codes = [coder.codes(x) if len(x) else np.zeros(0, np.int64) for x in names]
        before = [np.zeros(len(x), np.int64) for x in names]
        held = [(np.zeros(0, object), np.zeros(0))] * len(qids)
        for at in range(0, left.num_rows, SLICE):
            part = left.slice(at, SLICE)
            ids = np.asarray(part["paper_id"].to_pylist(), dtype=object)
            c, sq, cum = _prepared(_matrix(part["embedding"], basis.dim), basis)
            s = V._block_scores(c, sq, cum, k, qp)
            s = np.where(np.isnan(s), -np.inf, s)
            mine = coder.codes(ids)
            asked = np.flatnonzero(mine % 2)
            for q in range(len(qids)):
                col = s[:, q]
                if len(codes[q]):
                    order = np.argsort(codes[q])
                    spot = np.minimum(np.searchsorted(codes[q][order], mine[asked]), len(order) - 1)
                    own = codes[q][order][spot] == mine[asked]
                    col[asked[own]] = keys[q][order[spot[own]]]  # a probe's score is one number everywhere
                    before[q] += V.count_before(col, mine, keys[q], codes[q], coder.n_codes)
                a, b = np.concatenate([held[q][0], ids]), np.concatenate([held[q][1], col])
                best = V._topk_positions(b, a, depth)
                held[q] = a[best], b[best]
        cols = ([], [], [], [], [])
        for q, qid in enumerate(qids.tolist()):
            for kind, ids, score, n in ((0, *held[q], np.zeros(len(held[q][0]), np.int64)), (1, names[q], keys[q], before[q])):
                for c, v in zip(cols, ([qid] * len(ids), [kind] * len(ids), ids.tolist(), score.tolist(), n.tolist()), strict=True):
                    c.extend(v)
        types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("question_id", "kind", "paper_id", "score", "value"), cols, types, strict=True)})
    return run


def embedding_pass(vecs: DataFrame, questions: DataFrame, probes: DataFrame, basis: V.Basis, k: int, depth: int) -> DataFrame:
    """One scan of the vectors, dealt into chunks of some ``CHUNK_ROWS`` rows."""
    chunks = max(1, -(-basis.n // CHUNK_ROWS))
    blocks = max(1, -(-questions.count() // V.QUESTIONS_PER_BLOCK))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vecs.withColumn("_chunk", spot("paper_id", chunks)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    per = probes.groupBy("question_id").agg(F.collect_list(F.struct("paper_id", "score")).alias("probes"))  # at most M a question
    right = (questions.select("question_id", F.col("qvec").cast("array<double>").alias("qvec")).join(per, "question_id", "left")
             .withColumn("_block", spot("question_id", blocks)).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    return left.groupBy("_chunk", "_block").cogroup(right.groupBy("_chunk", "_block")).applyInArrow(
        _pass(basis, k, depth), "question_id long, kind int, paper_id string, score double, value long")


def search_hybrid_indexed(index: K.KeywordIndex, paper_embeddings: DataFrame, questions: DataFrame, model: str, top_k: int = 5,
                          n_components: int = V.DEFAULT_COMPONENTS, rrf_k: int = R.RRF_K,
                          watch: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """Exact fused top-k: (question_id, rank, paper_id, score), equal to ``search_hybrid``
    over the papers of the index.  Runs step by step; what is used twice is
    checkpointed in the shared folder.  ``watch`` is shown what each step touched:
    "blocks" (question_id, block) and "lookups" (question_id, paper_id)."""
    if top_k < 0:
        raise ValueError("top_k must be >= 0")
    spark = questions.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    store = lambda df, name=None: df.checkpoint()
    vecs = V.vectors_of(paper_embeddings, model)
    basis = V.fit_basis(vecs, n_components)
    if basis.n == 0 or top_k == 0:
        return spark.createDataFrame([], HYBRID_SCHEMA)
    k = min(V.capped_components(n_components, basis.n, basis.dim), basis.k)
    depth = candidate_depth(top_k, rrf_k)
    questions = store(questions.where(F.col("qvec").isNotNull()).select("question_id", "question", "qvec"))
    asked = store(K.question_tokens(questions))
    universe = store(index.universe(vecs))
    bound = store(K.bounds(index, universe, asked))

    top, read = K.keyword_top(index, universe, asked, bound, depth, store)
    top = store(top)
    probes = pair_scores(top, vecs, questions, basis, k)
    seen = store(embedding_pass(vecs, questions, probes, basis, k, depth))
    key = ["question_id", "paper_id"]
    ranks = seen.where("kind = 1").groupBy(*key).agg(F.sum("value").alias("rank_embedding"))
    known = top.join(ranks, key).withColumn("score", R.rrf(F.col("rank_embedding"), F.col("rank_keyword"), rrf_k))
    known = store(known.select(*key, "score"))

    limit = K.best_by(known, [F.desc("score"), F.asc("paper_id")], top_k, "_r").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("score").alias("_t"))
    by_score = K.best_by(seen.where("kind = 0"), [F.desc("score"), F.asc("paper_id")], depth, "rank_embedding")
    reach = R.rrf(F.col("rank_embedding"), F.lit(depth), rrf_k)
    open_ = (by_score.select(*key, "rank_embedding").join(top.select(*key), key, "left_anti").join(limit, "question_id", "left")
             .where(F.col("_n").isNull() | (F.col("_n") < top_k) | (reach >= F.col("_t"))).select(*key, "rank_embedding"))
    open_ = store(open_)
    if watch is not None:
        watch("blocks", read)
        watch("lookups", open_.select(*key))
    found = K.keyword_ranks(index, universe, asked, bound, open_, store).join(open_, key)
    rest = found.select(*key, R.rrf(F.col("rank_embedding"), F.col("rank_keyword"), rrf_k).alias("score"))
    return R.top_k(known.unionByName(rest), top_k, ["question_id"], "score", "paper_id").select("question_id", "rank", "paper_id", "score")
