"""Registered queries: each is (spark, sf_dir) -> DataFrame over the driver's
tables, with an equivalent SQL string in ``SQL``.

Output conventions shared with the SQL side: scores rounded to 6 places
(RRF scores to 9), counts and ranks as BIGINT, timestamps as ISO text,
arrays flattened to rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import cells as CE
from papyra.operators import substring_index as SI
from papyra.operators import vectors as V
from papyra.plans import oracle_sql as O
from papyra.sources import testbed as TB

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _r6(c) -> F.Column:
    return F.round(c, 6)


def _topk_sql(scores_ctes: list[str], k: int, with_n: bool = False) -> str:
    n_cols = "n AS n_components, " if with_n else ""
    part = "question_id, n" if with_n else "question_id"
    return O.with_(O.PE, O.QUESTIONS, *scores_ctes) + f"""
SELECT question_id, {n_cols}rank, paper_id, round(s, 6) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY s DESC NULLS LAST, paper_id) AS rank
  FROM scores) t
WHERE rank <= {k}"""


# --- vector search ----------------------------------------------------------------

@register("similar_topk", _topk_sql(O.raw_cosine_scores("m1"), 5))
def similar_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Plain cosine top-5 per question."""
    vecs = V.vectors_of(TB.paper_embeddings(spark, sf), "m1")
    basis = V.fit_basis(vecs, 0, center=False)
    cand = V.score_corpus(vecs, TB.questions(spark, sf), basis, components=(0,), top_k=5, raw=True)
    return V.top_k_per_question(cand, 5).select(
        "question_id", F.col("rank").cast("long").alias("rank"), "paper_id", _r6("score").alias("score"))


@register("centered_cosine", _topk_sql(O.debiased_scores("m1", (0,)), 10))
def centered_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """V2: cosine after centring by the corpus mean, top-10 per question."""
    out = V.search_similar(TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1",
                           top_k=10, n_components=0)
    return out.withColumn("score", _r6("score"))


@register("similar_debiased", _topk_sql(O.debiased_scores("m1", (3,)), 5))
def similar_debiased(spark: SparkSession, sf: str) -> DataFrame:
    """V6: centring plus removal of the top-3 variance directions, top-5."""
    out = V.search_similar(TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1",
                           top_k=5, n_components=3)
    return out.withColumn("score", _r6("score"))


@register("similar_debiased_cells", _topk_sql(O.debiased_scores("m1", (3,)), 5))
def similar_debiased_cells(spark: SparkSession, sf: str) -> DataFrame:
    """V6/R1 over balanced cells: as similar_debiased, skipping cells whose bound is too low."""
    vecs = V.vectors_of(TB.paper_embeddings(spark, sf), "m1")
    out = CE.search_cells(vecs, TB.questions(spark, sf), V.fit_basis(vecs, 3), 5, 3)
    return out.withColumn("score", _r6("score"))


@register("similar_debiased_iterative", _topk_sql(O.debiased_scores("m1", (3,)), 5))
def similar_debiased_iterative(spark: SparkSession, sf: str) -> DataFrame:
    """V4/V6: as similar_debiased, with directions from products, not from the dim x dim matrix."""
    pe = TB.paper_embeddings(spark, sf)
    basis = V.fit_basis_iterative(V.vectors_of(pe, "m1"), 3)
    return V.search_similar(pe, TB.questions(spark, sf), "m1", top_k=5, n_components=3, basis=basis).withColumn("score", _r6("score"))


@register("sweep_components", O.with_(O.ENTRIES, O.PE, O.QUESTIONS, *O.debiased_scores("m1", V.SWEEP_COMPONENTS)) + """
SELECT t.question_id, t.n AS n_components, t.rank, t.paper_id,
       coalesce(substr(e.title, 1, 70), '?') AS title, printf('%.3f', t.s) AS score_text,
       round(t.s, 6) + 0.0 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY question_id, n ORDER BY s DESC NULLS LAST, paper_id) AS rank
      FROM scores) t
LEFT JOIN entries e ON e.arxiv_id = t.paper_id
WHERE t.rank <= 5""")
def sweep_components(spark: SparkSession, sf: str) -> DataFrame:
    """V10 + P13: top-5 for n in (0,1,2,3,5,8,15) from one fit and one pass,
    with display title (70 chars, '?' when missing) and score text."""
    top = V.sweep_components(TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1", top_k=5)
    p = TB.papers(spark, sf).select(F.col("arxiv_id").alias("paper_id"), "title")
    return (top.join(p, "paper_id", "left")
            .select("question_id", "n_components", F.col("rank").cast("long").alias("rank"), "paper_id",
                    F.coalesce(F.substring("title", 1, 70), F.lit("?")).alias("title"),
                    F.format_string("%.3f", "score").alias("score_text"),
                    _r6("score").alias("score")))


# --- lexical, ranks, fusion, answers ----------------------------------------------

from papyra.operators import hybrid as H  # noqa: E402
from papyra.operators import keyword_index as KI  # noqa: E402
from papyra.operators import threshold as TA  # noqa: E402
from papyra.operators import lexical as L  # noqa: E402
from papyra.operators import ranking as R  # noqa: E402
from papyra.functions.text import tokenize as _tokenize  # noqa: E402

_BASE = [O.ENTRIES, O.PAPERS, O.PE, O.QUESTIONS]


@register("tokenize", O.with_(O.ENTRIES, O.PAPERS) + f"""
SELECT DISTINCT arxiv_id AS paper_id, unnest({O.tokens("title || ' ' || abstract")}) AS token FROM papers""")
def tokenize_q(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct keyword tokens of every paper's title + abstract."""
    p = TB.papers(spark, sf)
    return p.select(F.col("arxiv_id").alias("paper_id"),
                    F.explode(_tokenize(F.concat_ws(" ", "title", "abstract"))).alias("token"))


@register("keyword_overlap", O.with_(O.ENTRIES, O.PAPERS, O.QUESTIONS) + f"""
, dtok AS (SELECT arxiv_id AS paper_id, unnest({O.tokens("title || ' ' || abstract")}) AS token FROM papers),
qtok AS (SELECT question_id, unnest({O.tokens('question')}) AS token FROM questions)
SELECT q.question_id, d.paper_id, count(*) AS overlap FROM qtok q JOIN dtok d ON q.token = d.token
GROUP BY q.question_id, d.paper_id""")
def keyword_overlap_q(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse token-set intersection sizes, every question x every paper
    (pairs with overlap 0 are absent)."""
    p = TB.papers(spark, sf)
    texts = p.select(F.col("arxiv_id").alias("paper_id"), F.concat_ws(" ", "title", "abstract").alias("text"))
    return L.keyword_overlap(L.paper_tokens(texts), L.question_tokens(TB.questions(spark, sf)))


@register("rank_by_similarity", O.with_(*_BASE, *O.debiased_scores("m1", (3,))) + """
SELECT question_id, paper_id, row_number() OVER (PARTITION BY question_id ORDER BY s DESC NULLS LAST, paper_id) - 1
       AS rank, round(s, 6) + 0.0 AS score FROM scores""")
def rank_by_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """R2: full 0-based debiased-cosine rank of every vector, per question."""
    vecs = V.vectors_of(TB.paper_embeddings(spark, sf), "m1")
    sims = V.score_corpus(vecs, TB.questions(spark, sf), V.fit_basis(vecs, 3), components=(3,))
    levels = R.split_levels(vecs, "paper_id")
    return (R.exact_rank(sims, ["question_id"], "score", "paper_id", R.similarity_bucket, levels=levels)
            .select("question_id", "paper_id", "rank", _r6("score").alias("score")))


@register("rank_by_overlap", O.with_(*_BASE, *O.hybrid_ctes("m1")) + """
SELECT question_id, paper_id, overlap, rl AS rank FROM lr""")
def rank_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """R2: full 0-based keyword rank (overlap desc, id asc) of every vector."""
    pe = TB.paper_embeddings(spark, sf)
    pairs = H.scored_pairs(TB.papers(spark, sf), pe, TB.questions(spark, sf), "m1")
    levels = R.split_levels(V.vectors_of(pe, "m1"), "paper_id")
    return (R.exact_rank(pairs.select("question_id", "paper_id", "overlap"), ["question_id"], "overlap",
                         "paper_id", R.integer_bucket, levels=levels)
            .select("question_id", "paper_id", "overlap", "rank"))


@register("rrf_scores", O.with_(*_BASE, *O.hybrid_ctes("m1")) + """
SELECT question_id, paper_id, re AS rank_embedding, rl AS rank_keyword, round(rrf, 9) + 0.0 AS score FROM fused""")
def rrf_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Fused score of every (question, vector)."""
    f = H.fused_scores(TB.papers(spark, sf), TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1")
    return f.select("question_id", "paper_id", "rank_embedding", "rank_keyword",
                    F.round("score", 9).alias("score"))


@register("hybrid_search", O.with_(*_BASE, *O.hybrid_ctes("m1")) + """
SELECT question_id, rank, paper_id, round(rrf, 9) + 0.0 AS score FROM hyb WHERE rank <= 5""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """V7: fused top-5 per question."""
    h = H.search_hybrid(TB.papers(spark, sf), TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1")
    return h.withColumn("score", F.round("score", 9))


def _index_of(spark: SparkSession, papers: DataFrame) -> KI.KeywordIndex:
    """A keyword index of the papers in the shared folder."""
    import uuid

    from papyra.session import checkpoint_dir
    root = f"{checkpoint_dir(spark).rstrip('/')}/keyword-index-{uuid.uuid4().hex}"
    KI.KeywordIndex.add(root, papers, 0)
    return KI.KeywordIndex.open(spark, root)


@register("hybrid_indexed", O.with_(*_BASE, *O.hybrid_ctes("m1")) + """
SELECT question_id, rank, paper_id, round(rrf, 9) + 0.0 AS score FROM hyb WHERE rank <= 5""")
def hybrid_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """R4/V7 from stored postings: index the papers, then fused top-5 per question
    by the threshold algorithm, without their text."""
    index = _index_of(spark, TB.papers(spark, sf))
    h = TA.search_hybrid_indexed(index, TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1")
    return h.withColumn("score", F.round("score", 9))


@register("keyword_top_indexed", O.with_(*_BASE, *O.hybrid_ctes("m1")) + """
SELECT question_id, paper_id, overlap, rl AS rank FROM lr WHERE rl < 10""")
def keyword_top_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """R5 from stored postings: the ten papers of largest overlap per question that
    has a vector, among the papers with a vector."""
    index = _index_of(spark, TB.papers(spark, sf))
    qs = TB.questions(spark, sf).where(F.col("qvec").isNotNull())
    universe = index.universe(V.vectors_of(TB.paper_embeddings(spark, sf), "m1")).checkpoint()
    asked = KI.question_tokens(qs).checkpoint()
    top, _ = KI.keyword_top(index, universe, asked, KI.bounds(index, universe, asked).checkpoint(), 10, lambda df, name: df.checkpoint())
    return top.withColumnRenamed("rank_keyword", "rank")


_ASK_SQL = """
SELECT h.question_id, h.rank, p.arxiv_id, p.title, p.abstract, p.primary_category, p.pdf_url, p.abs_url,
       round(h.rrf, 9) + 0.0 AS score
FROM hyb h JOIN papers p ON p.arxiv_id = h.paper_id WHERE h.rank <= 5"""


@register("ask", O.with_(*_BASE, *O.hybrid_ctes("m1")) + _ASK_SQL)
def ask_q(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 (flagship): questions -> top-5 papers with metadata and fused score."""
    a = H.ask(TB.papers(spark, sf), TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1")
    return a.withColumn("score", F.round("score", 9))


@register("ask_metadata_drop",
          O.with_(O.ENTRIES, O.papers_minus("toxic = 1"), O.PE, O.QUESTIONS, *O.hybrid_ctes("m1")) + _ASK_SQL)
def ask_metadata_drop(spark: SparkSession, sf: str) -> DataFrame:
    """As ask, over a corpus whose toxic-labelled papers were removed but
    whose vectors remain: those vectors rank with empty text and are dropped
    after the cut."""
    p = TB.papers_without_labelled(spark, sf, "toxic = 1")
    a = H.ask(p, TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1")
    return a.withColumn("score", F.round("score", 9))


@register("build_contexts", O.with_(*_BASE, *O.hybrid_ctes("m1")) + """
, a AS (SELECT h.question_id, h.rank, p.arxiv_id, p.title, p.abstract,
               row_number() OVER (PARTITION BY h.question_id ORDER BY h.rank) AS pos
        FROM hyb h JOIN papers p ON p.arxiv_id = h.paper_id WHERE h.rank <= 3),
b AS (SELECT question_id, string_agg(printf(chr(10) || '%d. [%s] %s' || chr(10) || '   Abstract: %s',
             pos, arxiv_id, title, abstract), chr(10) ORDER BY pos) AS body FROM a GROUP BY question_id)
SELECT q.question_id,
       CASE WHEN b.body IS NULL THEN 'No relevant papers were found to answer this question.'
            ELSE 'Question: ' || q.question || chr(10) || chr(10) || 'Candidate papers:' || chr(10) || b.body
       END AS prompt
FROM questions q LEFT JOIN b ON b.question_id = q.question_id""")
def build_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Q2/Q3: one answer prompt per question from its top-3 papers."""
    p, qs = TB.papers(spark, sf), TB.questions(spark, sf)
    a = H.ask(p, TB.paper_embeddings(spark, sf), qs, "m1", top_k=3)
    return H.build_contexts(qs, a)


@register("contexts_without_papers", O.with_(O.ENTRIES, O.papers_minus("quality = 1"), O.PE, O.QUESTIONS, *O.hybrid_ctes("m1")) + """
, a AS (SELECT h.question_id, p.arxiv_id, p.title, p.abstract
        FROM hyb h JOIN papers p ON p.arxiv_id = h.paper_id WHERE h.rank <= 1)
SELECT q.question_id,
       CASE WHEN a.question_id IS NULL THEN 'No relevant papers were found to answer this question.'
            ELSE 'Question: ' || q.question || chr(10) || chr(10) || 'Candidate papers:' || chr(10) || chr(10)
              || '1. [' || a.arxiv_id || '] ' || a.title || chr(10) || '   Abstract: ' || a.abstract END AS prompt
FROM questions q LEFT JOIN a ON a.question_id = q.question_id""")
def contexts_without_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Q3: prompts from the best hit alone, over a corpus that lost its papers of
    quality 1; questions whose hit has no paper get the no-papers sentence."""
    qs = TB.questions(spark, sf)
    p = TB.papers_without_labelled(spark, sf, "quality = 1")
    return H.build_contexts(qs, H.ask(p, TB.paper_embeddings(spark, sf), qs, "m1", top_k=1))


# --- normalisation ------------------------------------------------------------------

from papyra.functions import text as TX  # noqa: E402
from papyra.operators import normalize as N  # noqa: E402


def _iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _normalized(spark, sf):
    return N.normalize_entries(TB.atom_entries(spark, sf), keep=("doc_id",))


@register("entry_id", O.with_(O.ATOM) + "SELECT id, string_split(id, '/abs/')[-1] AS arxiv_id FROM atom")
def entry_id_q(spark: SparkSession, sf: str) -> DataFrame:
    """Id after the last '/abs/' (old-style ids keep their slash)."""
    return TB.atom_entries(spark, sf).select("id", N.entry_id("id").alias("arxiv_id"))


@register("pdf_url_fallback", O.with_(O.ATOM, O.NORMALIZED) + "SELECT abs_url, pdf_url FROM normalized")
def pdf_url_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Titled pdf link, else /abs/ -> /pdf/ in the id."""
    return _normalized(spark, sf).select("abs_url", "pdf_url")


@register("primary_category_default", O.with_(O.ATOM, O.NORMALIZED) + """
SELECT abs_url, primary_category, array_to_string(categories, ';') AS categories FROM normalized""")
def primary_category_default(spark: SparkSession, sf: str) -> DataFrame:
    """Categories in feed order; primary = own element, first category or ''."""
    return _normalized(spark, sf).select("abs_url", "primary_category",
                                         F.array_join("categories", ";").alias("categories"))


@register("normalize_whitespace", f"SELECT {O.pid('doc_id')} AS paper_id, {O.ws('text')} AS text FROM documents")
def normalize_whitespace_q(spark: SparkSession, sf: str) -> DataFrame:
    """P5: whitespace runs (Python's full set) collapsed, ends stripped."""
    d = TB.table(spark, sf, "documents")
    return d.select(TB.padded_id("doc_id").alias("paper_id"), TX.normalize_whitespace("text").alias("text"))


@register("truncate_seconds", "SELECT event_id, " + O.iso("date_trunc('second', ts)") + " AS ts FROM events")
def truncate_seconds_q(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps to whole seconds, naive UTC, as ISO text."""
    e = TB.table(spark, sf, "events")
    return e.select("event_id", _iso(N.truncate_seconds("ts")).alias("ts"))


_NORM_COLS = """arxiv_id, title, abstract, array_to_string(authors, ';') AS authors,
  array_to_string(categories, ';') AS categories, primary_category, """ + O.iso("published") + """ AS published,
  """ + O.iso("updated") + """ AS updated, pdf_url, abs_url, comment, journal_ref, doi"""


@register("normalize_papers", O.with_(O.ATOM, O.NORMALIZED) + f"SELECT {_NORM_COLS} FROM normalized")
def normalize_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Whole entry -> paper projection."""
    n = _normalized(spark, sf)
    return n.select("arxiv_id", "title", "abstract", F.array_join("authors", ";").alias("authors"),
                    F.array_join("categories", ";").alias("categories"), "primary_category",
                    _iso("published").alias("published"), _iso("updated").alias("updated"),
                    "pdf_url", "abs_url", "comment", "journal_ref", "doi")


@register("validate_papers", O.with_(O.ATOM, O.NORMALIZED) + """
SELECT abs_url, reasons = '' AS is_valid, reasons FROM (
  SELECT abs_url, concat_ws(';', """ + ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{c} is null' END" for c in N.REQUIRED) + """) AS reasons FROM normalized) t""")
def validate_papers_q(spark: SparkSession, sf: str) -> DataFrame:
    """P10: required fields checked; rejects quarantined with reasons."""
    valid, rejects = N.validate_papers(_normalized(spark, sf))
    return (valid.select("abs_url", F.lit(True).alias("is_valid"), F.lit("").alias("reasons"))
            .unionByName(rejects.select("abs_url", F.lit(False).alias("is_valid"),
                                        F.array_join("reasons", ";").alias("reasons"))))


@register("document_text", O.with_(O.ENTRIES) + "SELECT arxiv_id AS paper_id, title || '[SEP]' || abstract AS text FROM entries")
def document_text_q(spark: SparkSession, sf: str) -> DataFrame:
    """Encoder input text."""
    e = TB.paper_entries(spark, sf)
    return e.select(F.col("arxiv_id").alias("paper_id"), TX.document_text("title", "abstract").alias("text"))


@register("paper_label", O.with_(O.ENTRIES) + """
SELECT arxiv_id AS paper_id, '[' || arxiv_id || '] ' || title || ' (' || array_to_string(authors[1:3], ', ')
       || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END || ')' AS label FROM entries""")
def paper_label_q(spark: SparkSession, sf: str) -> DataFrame:
    """Display label with at most three authors."""
    e = TB.paper_entries(spark, sf)
    return e.select(F.col("arxiv_id").alias("paper_id"), TX.paper_label("arxiv_id", "title", "authors").alias("label"))


# --- upserts and integrity -------------------------------------------------------------

from papyra.operators import upsert as U  # noqa: E402

_UP = O.with_(O.ENTRIES, *O.UPSERT)


def _stores(spark, sf, authors=False):
    """(current store, incoming batch, next store)."""
    empty = U.empty_tables(spark)
    cur = U.apply_batch(empty, TB.current_entries(spark, sf), TB.ts(TB.INGESTED_AT), authors=authors)
    inc = TB.incoming_entries(spark, sf)
    nxt = U.apply_batch(cur, inc, TB.ts(TB.BATCH_TS), authors=authors)
    return cur, inc, nxt


@register("upsert_papers", _UP + "SELECT arxiv_id, title, doi, " + O.iso("ingested_at") + " AS ingested_at FROM next_papers")
def upsert_papers_q(spark: SparkSession, sf: str) -> DataFrame:
    """Last write wins (NULL doi included), first ingested_at kept."""
    _, _, nxt = _stores(spark, sf)
    return nxt["papers"].select("arxiv_id", "title", "doi", _iso("ingested_at").alias("ingested_at"))


@register("upsert_counts", _UP + """
SELECT (SELECT count(DISTINCT arxiv_id) FROM inc WHERE arxiv_id NOT IN (SELECT arxiv_id FROM cur_papers)) AS new_count,
       (SELECT count(*) FROM inc) - (SELECT count(DISTINCT arxiv_id) FROM inc WHERE arxiv_id NOT IN
        (SELECT arxiv_id FROM cur_papers)) AS updated_count""")
def upsert_counts_q(spark: SparkSession, sf: str) -> DataFrame:
    """(new, updated) of a batch."""
    cur, inc, _ = _stores(spark, sf)
    return U.upsert_counts(cur["papers"], inc)


@register("upsert_categories", _UP + "SELECT DISTINCT unnest(categories) AS code FROM (SELECT categories FROM cur UNION ALL SELECT categories FROM inc)")
def upsert_categories_q(spark: SparkSession, sf: str) -> DataFrame:
    """Category dimension, insert if absent."""
    return _stores(spark, sf)[2]["categories"]


@register("upsert_paper_categories", _UP + """
SELECT DISTINCT arxiv_id AS paper_id, unnest(categories) AS category_code
FROM (SELECT arxiv_id, categories FROM cur UNION ALL SELECT arxiv_id, categories FROM inc)""")
def upsert_paper_categories_q(spark: SparkSession, sf: str) -> DataFrame:
    """U4: paper-category links accumulate from every batch row."""
    return _stores(spark, sf)[2]["paper_categories"]


@register("upsert_authors", _UP + "SELECT author_id, name FROM next_authors")
def upsert_authors_q(spark: SparkSession, sf: str) -> DataFrame:
    """Author dimension with increasing, unique, stable ids."""
    return _stores(spark, sf, authors=True)[2]["authors"]


@register("upsert_paper_authors", _UP + """
SELECT p.paper_id, a.name, p.author_order FROM next_pa p JOIN next_authors a ON a.author_id = p.author_id""")
def upsert_paper_authors_q(spark: SparkSession, sf: str) -> DataFrame:
    """Links with position; the first order of a (paper, author) wins."""
    nxt = _stores(spark, sf, authors=True)[2]
    return nxt["paper_authors"].join(nxt["authors"], "author_id").select("paper_id", "name", "author_order")


@register("ordered_bridge_lineitem", """
SELECT l_orderkey, l_suppkey, min(l_linenumber) AS author_order FROM lineitem GROUP BY l_orderkey, l_suppkey""")
def ordered_bridge_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """U6 at scale: order -> paper, supplier -> author, line number -> position;
    first (smallest) position per pair wins."""
    li = TB.table(spark, sf, "lineitem")
    return U.first_order_bridge(li, "l_orderkey", "l_suppkey", "l_linenumber").withColumnRenamed(
        "l_linenumber", "author_order")


def _checksum(c: str) -> F.Column:
    return F.round(F.aggregate(F.col(c), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double")), 6)


@register("upsert_embeddings", O.with_(O.PE, *O.VEC_UPSERT) + """
SELECT paper_id, model, dim, """ + O.iso("created_at") + """ AS created_at,
       round(list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, b: a + b), 6) + 0.0 AS checksum
FROM next_pe""")
def upsert_embeddings_q(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors by (paper, model): last valid write wins, created_at and
    dim refreshed, broken vectors quarantined."""
    nxt, _ = U.upsert_embeddings(TB.paper_embeddings(spark, sf), TB.incoming_vectors(spark, sf),
                                 TB.ts(TB.BATCH_TS))
    return nxt.select("paper_id", "model", "dim", _iso("created_at").alias("created_at"),
                      _checksum("embedding").alias("checksum"))


@register("rejected_embeddings", O.with_(O.ENTRIES, O.papers_minus("toxic = 1"), O.PE, *O.VEC_UPSERT) + """
SELECT paper_id, model, seq, CASE
    WHEN list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) THEN 'vector has a non-finite element'
    WHEN len(embedding) <> (SELECT max(dim) FROM pe p WHERE p.model = vin.model) THEN 'vector length differs from the model''s dimension'
    ELSE 'paper is missing' END AS reason
FROM vin WHERE list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
  OR len(embedding) <> (SELECT max(dim) FROM pe p WHERE p.model = vin.model)
  OR paper_id NOT IN (SELECT arxiv_id FROM papers)""")
def rejected_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """U7 + U8: what a vector batch leaves in quarantine and why, vectors of
    missing papers included."""
    _, rejects = U.upsert_embeddings(TB.paper_embeddings(spark, sf), TB.incoming_vectors(spark, sf), TB.ts(TB.BATCH_TS),
                                     papers=TB.papers_without_labelled(spark, sf, "toxic = 1"))
    return rejects.select("paper_id", "model", "seq", "reason")


@register("orphan_embeddings", O.with_(O.ENTRIES, O.papers_minus("toxic = 1"), O.PE) + """
SELECT paper_id, model FROM pe WHERE paper_id NOT IN (SELECT arxiv_id FROM papers)""")
def orphan_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """U8: vectors whose paper row is missing (here: papers removed for a
    toxic label, vectors left behind)."""
    p = TB.papers_without_labelled(spark, sf, "toxic = 1")
    return U.orphans(TB.paper_embeddings(spark, sf), p).select("paper_id", "model")


@register("cascade_delete", O.with_(O.ENTRIES, O.PE) + """
, gone AS (SELECT lpad(cast(doc_id AS VARCHAR), 19, '0') AS arxiv_id FROM labels WHERE toxic = 1),
m AS (SELECT arxiv_id, unnest(authors) AS name FROM entries),
c AS (SELECT arxiv_id, unnest(categories) AS code FROM entries)
SELECT 'papers' AS table_name, (SELECT count(*) FROM entries WHERE arxiv_id NOT IN (SELECT arxiv_id FROM gone)) AS n_rows
UNION ALL SELECT 'authors', (SELECT count(DISTINCT name) FROM m)
UNION ALL SELECT 'paper_authors', (SELECT count(*) FROM (SELECT DISTINCT arxiv_id, name FROM m
                                   WHERE arxiv_id NOT IN (SELECT arxiv_id FROM gone)))
UNION ALL SELECT 'categories', (SELECT count(DISTINCT code) FROM c)
UNION ALL SELECT 'paper_categories', (SELECT count(*) FROM (SELECT DISTINCT arxiv_id, code FROM c
                                      WHERE arxiv_id NOT IN (SELECT arxiv_id FROM gone)))
UNION ALL SELECT 'paper_embeddings', (SELECT count(*) FROM pe WHERE paper_id NOT IN (SELECT arxiv_id FROM gone))""")
def cascade_delete_q(spark: SparkSession, sf: str) -> DataFrame:
    """Delete toxic-labelled papers from the whole store; links and
    vectors follow, dimensions stay.  Rows left per table."""
    entries = TB.paper_entries(spark, sf).withColumn("seq", F.col("doc_id"))
    store = U.apply_batch(U.empty_tables(spark), entries, TB.ts(TB.INGESTED_AT))
    store["paper_embeddings"] = TB.paper_embeddings(spark, sf)
    gone = (TB.table(spark, sf, "labels").where("toxic = 1")
            .select(TB.padded_id("doc_id").alias("arxiv_id")))
    after = U.cascade_delete(store, gone)
    counts = [after[t].agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
              for t in ("papers", "authors", "paper_authors", "categories", "paper_categories", "paper_embeddings")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register("cascade_delete_parents", O.with_(O.ENTRIES) + """
, m AS (SELECT DISTINCT arxiv_id, unnest(authors) AS name FROM entries),
c AS (SELECT DISTINCT arxiv_id, unnest(categories) AS code FROM entries)
SELECT 'authors' AS table_name, (SELECT count(DISTINCT name) FROM m WHERE NOT starts_with(name, 'c')) AS n_rows
UNION ALL SELECT 'paper_authors', (SELECT count(*) FROM m WHERE NOT starts_with(name, 'c'))
UNION ALL SELECT 'categories', (SELECT count(DISTINCT code) FROM c WHERE NOT starts_with(code, 'src1'))
UNION ALL SELECT 'paper_categories', (SELECT count(*) FROM c WHERE NOT starts_with(code, 'src1'))
UNION ALL SELECT 'papers', (SELECT count(*) FROM entries)""")
def cascade_delete_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Delete the authors named c*, then the categories src1*; their links follow,
    papers stay.  Rows left per table."""
    entries = TB.paper_entries(spark, sf).withColumn("seq", F.col("doc_id"))
    store = U.apply_batch(U.empty_tables(spark), entries, TB.ts(TB.INGESTED_AT))
    after = U.cascade_delete(store, store["authors"].where(F.startswith("name", F.lit("c"))), "authors")
    after = U.cascade_delete(after, store["categories"].where(F.startswith("code", F.lit("src1"))), "categories")
    out = None
    for t in ("authors", "paper_authors", "categories", "paper_categories", "papers"):
        n = after[t].agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


# --- lookups, filters, statistics, paging, encoding ----------------------------------

from papyra.operators import diagnostics as D  # noqa: E402
from papyra.operators import embed as EM  # noqa: E402
from papyra.operators import lookup as LK  # noqa: E402
from papyra.streaming.ingest import first_entries  # noqa: E402

_IDS_SQL = ("ids AS (SELECT lpad(cast(doc_id AS VARCHAR), 19, '0') AS arxiv_id FROM labels "
            "UNION SELECT lpad(cast(doc_id * 3 AS VARCHAR), 19, '0') FROM labels)")


def _lookup_ids(spark, sf):
    """Requested ids: every labelled document and the id three times its
    number (many of those are unknown)."""
    lab = TB.table(spark, sf, "labels")
    return (lab.select(TB.padded_id("doc_id").alias("arxiv_id"))
            .unionByName(lab.select(F.lpad((F.col("doc_id") * 3).cast("string"), TB.ID_WIDTH, "0").alias("arxiv_id"))))


@register("paper_exists", O.with_(O.ENTRIES, O.PAPERS, _IDS_SQL) + """
SELECT i.arxiv_id, p.arxiv_id IS NOT NULL AS present FROM ids i LEFT JOIN papers p ON p.arxiv_id = i.arxiv_id""")
def paper_exists_q(spark: SparkSession, sf: str) -> DataFrame:
    """Existence of each requested id."""
    return LK.paper_exists(TB.papers(spark, sf), _lookup_ids(spark, sf))


@register("papers_by_ids", O.with_(O.ENTRIES, O.PAPERS, _IDS_SQL) + """
SELECT arxiv_id, title, abstract, primary_category, pdf_url, abs_url FROM papers WHERE arxiv_id IN (SELECT arxiv_id FROM ids)""")
def papers_by_ids_q(spark: SparkSession, sf: str) -> DataFrame:
    """Six metadata columns for an unbounded id list; unknown ids vanish."""
    return LK.papers_by_ids(TB.papers(spark, sf), _lookup_ids(spark, sf))


@register("get_by_id", O.with_(O.ENTRIES, O.PAPERS) + """
SELECT arxiv_id, title, abstract, primary_category, """ + O.iso("published") + """ AS published, pdf_url, abs_url
FROM papers WHERE arxiv_id IN (SELECT lpad(cast(item_id AS VARCHAR), 19, '0') FROM benchmark)""")
def get_by_id_q(spark: SparkSession, sf: str) -> DataFrame:
    """F3 id: one paper per requested id (ids from the benchmark items)."""
    ids = TB.table(spark, sf, "benchmark").select(TB.padded_id("item_id").alias("arxiv_id"))
    return LK.get_by_id(TB.papers(spark, sf), ids).select(
        "arxiv_id", "title", "abstract", "primary_category", _iso("published").alias("published"), "pdf_url",
        "abs_url")


@register("embedding_lookup", O.with_(O.PE, _IDS_SQL) + """
SELECT paper_id, unnest(range(len(embedding))) AS pos, round(unnest(embedding)::DOUBLE, 6) + 0.0 AS value
FROM pe WHERE model = 'm2' AND paper_id IN (SELECT arxiv_id FROM ids)""")
def embedding_lookup_q(spark: SparkSession, sf: str) -> DataFrame:
    """The m2 vector of each requested id, or nothing."""
    e = LK.embedding_lookup(TB.paper_embeddings(spark, sf), _lookup_ids(spark, sf), "m2")
    return e.select("paper_id", F.posexplode("embedding").alias("pos", "value")).select(
        "paper_id", F.col("pos").cast("long").alias("pos"), _r6(F.col("value").cast("double")).alias("value"))


@register("papers_missing_embedding", O.with_(O.ENTRIES, O.PAPERS, O.PE) + """
SELECT arxiv_id, title, abstract FROM papers
WHERE arxiv_id IN (SELECT arxiv_id FROM papers EXCEPT SELECT paper_id FROM pe WHERE model = 'm2')""")
def papers_missing_embedding_q(spark: SparkSession, sf: str) -> DataFrame:
    """Papers without an m2 vector (an m1 vector does not count)."""
    return LK.papers_missing_embedding(TB.papers(spark, sf), TB.paper_embeddings(spark, sf), "m2").select(
        "arxiv_id", "title", "abstract")


@register("embeddings_by_model", O.with_(O.PE) + "SELECT paper_id, dim FROM pe WHERE model = 'm2'")
def embeddings_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors of one model."""
    return V.vectors_of(TB.paper_embeddings(spark, sf), "m2").select(
        "paper_id", F.size("embedding").alias("dim"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@register("title_contains", O.with_(O.ENTRIES, O.PAPERS) + f"""
SELECT arxiv_id, title FROM papers WHERE contains(translate(title, {_AZ}), 'tion')""")
def title_contains(spark: SparkSession, sf: str) -> DataFrame:
    """case-insensitive (ASCII only) substring on titles."""
    p = TB.papers(spark, sf)
    return p.where(TX.title_contains("title", "TION")).select("arxiv_id", "title")


@register("part_name_contains", f"SELECT p_partkey, p_name FROM part WHERE contains(translate(p_name, {_AZ}), 'widget')")
def part_name_contains(spark: SparkSession, sf: str) -> DataFrame:
    """F1 on another table: part names containing 'widget'."""
    p = TB.table(spark, sf, "part")
    return p.where(TX.title_contains("p_name", "widget")).select("p_partkey", "p_name")


@register("fielded_search", O.with_(O.ENTRIES) + f"""
SELECT arxiv_id, title FROM entries
WHERE (contains(translate(title, {_AZ}), 'tion') AND NOT list_contains(categories, 'src1'))
   OR len(list_filter(authors, lambda a: translate(a, {_AZ}) = 'a5')) > 0""")
def fielded_search(spark: SparkSession, sf: str) -> DataFrame:
    """title:tion ANDNOT cat:src1, OR au:a5."""
    e = TB.paper_entries(spark, sf)
    pred = (LK.field.title("tion") & ~LK.field.category("src1")) | LK.field.author("A5")
    return e.where(pred).select("arxiv_id", "title")


def _titles_of(spark: SparkSession, papers: DataFrame) -> SI.SubstringIndex:
    """A substring index of the papers' titles in the shared folder."""
    import uuid

    from papyra.session import checkpoint_dir
    root = f"{checkpoint_dir(spark).rstrip('/')}/title-index-{uuid.uuid4().hex}"
    SI.SubstringIndex.add(root, papers, 0)
    return SI.SubstringIndex.open(spark, root)


@register("title_terms_indexed", O.with_(O.ENTRIES, O.PAPERS, O.QUESTIONS) + f"""
SELECT term, arxiv_id FROM (
  SELECT DISTINCT translate(substr(question, 1, n), {_AZ}) AS term FROM questions, (VALUES (2), (4), (9)) v(n) WHERE question IS NOT NULL)
JOIN papers ON contains(translate(title, {_AZ}), term)""")
def title_terms_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """F1 for a table of terms (how each question begins) from stored character grams."""
    terms = TB.questions(spark, sf).select(F.explode(F.array(*[F.substring("question", 1, n) for n in (2, 4, 9)])).alias("term"))
    return SI.find(_titles_of(spark, TB.papers(spark, sf)), terms).withColumnRenamed("paper_id", "arxiv_id")


@register("fielded_search_indexed", SQL["fielded_search"])
def fielded_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """F3 as ``fielded_search``, the title test from stored character grams."""
    e = TB.paper_entries(spark, sf)
    hits = SI.find(_titles_of(spark, TB.papers(spark, sf)), spark.createDataFrame([("TION",)], "term string"))
    hits = hits.select(F.col("paper_id").alias("arxiv_id"), F.lit(True).alias("_hit"))
    pred = (F.coalesce("_hit", F.lit(False)) & ~LK.field.category("src1")) | LK.field.author("A5")
    return e.join(hits, "arxiv_id", "left").where(pred).select("arxiv_id", "title")


@register("search_page", O.with_(O.ENTRIES) + f"""
SELECT arxiv_id, title, """ + O.iso("updated") + f""" AS updated FROM entries
WHERE contains(translate(title, {_AZ}), 'é') AND NOT list_contains(categories, 'src1')
ORDER BY updated DESC, arxiv_id DESC LIMIT 25 OFFSET 5""")
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    """F3 + S3: title:é ANDNOT cat:src1, newest update first, entries 6 to 30
    (the page is the feature)."""
    e = LK.search_papers(TB.paper_entries(spark, sf), LK.field.title("é") & ~LK.field.category("src1"),
                         sort_by="updated", start=5, max_results=25)
    return e.select("arxiv_id", "title", _iso("updated").alias("updated"))


@register("corpus_coverage", O.with_(O.ENTRIES, O.PAPERS, O.PE) + """
SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM pe WHERE model = 'm1') AS embedded""")
def corpus_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A1: papers and vectors of a model."""
    return D.corpus_coverage(TB.papers(spark, sf), TB.paper_embeddings(spark, sf), "m1")


@register("category_counts", O.with_(O.ENTRIES, O.PAPERS) + """
SELECT primary_category, count(*) AS n FROM papers GROUP BY primary_category""")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A2: papers per primary category, largest first."""
    return D.category_counts(TB.papers(spark, sf))


@register("corpus_mean", O.with_(O.PE) + """
SELECT i AS pos, round(avg(v), 6) + 0.0 AS mean FROM (SELECT unnest(range(len(embedding))) AS i,
  unnest(embedding)::DOUBLE AS v FROM pe WHERE model = 'm1') GROUP BY i""")
def corpus_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A3: column-wise mean of the m1 vectors."""
    m = V.corpus_mean(V.vectors_of(TB.paper_embeddings(spark, sf), "m1"))
    return m.select(F.col("pos").cast("long").alias("pos"), _r6("mean").alias("mean"))


@register("l2_normalize", O.with_(O.PE) + """
SELECT paper_id, i AS pos, round(v / (sqrt(sum(v * v) OVER (PARTITION BY paper_id)) + 1e-8), 6) + 0.0 AS value
FROM (SELECT paper_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM pe WHERE model = 'm1')""")
def l2_normalize_q(spark: SparkSession, sf: str) -> DataFrame:
    """V1: unit vectors (eps 1e-8), one row per element."""
    v = V.vectors_of(TB.paper_embeddings(spark, sf), "m1")
    return v.select("paper_id", F.posexplode(V.l2_normalize("embedding")).alias("pos", "value")).select(
        "paper_id", F.col("pos").cast("long").alias("pos"), _r6("value").alias("value"))


_UNIT_SQL = ("unit AS MATERIALIZED (SELECT paper_id, i, v / (sqrt(sum(v * v) OVER (PARTITION BY paper_id)) + 1e-8) AS u "
             "FROM (SELECT paper_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM pe "
             "WHERE model = 'm1'))")


@register("anisotropy_mean_onepass", O.with_(O.PE, _UNIT_SQL) + """
, sims AS (SELECT a.paper_id, b.paper_id AS other, sum(a.u * b.u) AS s FROM unit a JOIN unit b
           ON a.i = b.i AND a.paper_id < b.paper_id GROUP BY a.paper_id, b.paper_id)
SELECT count(*) AS n_pairs, round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) + 0.0 AS std FROM sims""")
def anisotropy_mean_onepass(spark: SparkSession, sf: str) -> DataFrame:
    """A4/V8 exact: mean and population std of cosine over all distinct pairs,
    from sums and the Gram matrix (the SQL check enumerates the pairs)."""
    m = D.pair_moments(V.vectors_of(TB.paper_embeddings(spark, sf), "m1"))
    return m.select("n_pairs", _r6("mean").alias("mean"), _r6("std").alias("std"))


@register("anisotropy_all_pairs", O.with_(O.PE, _UNIT_SQL) + """
, sims AS (SELECT a.paper_id, b.paper_id AS other, sum(a.u * b.u) AS s FROM unit a JOIN unit b
           ON a.i = b.i AND a.paper_id < b.paper_id GROUP BY a.paper_id, b.paper_id)
SELECT count(*) AS n_pairs, round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) + 0.0 AS std,
       round(min(s), 6) + 0.0 AS min, round(max(s), 6) + 0.0 AS max FROM sims""")
def anisotropy_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A4/V8 exact: mean and std from the Gram matrix, extremes tile by tile with
    bounds; no pair leaves a task."""
    vecs = V.vectors_of(TB.paper_embeddings(spark, sf), "m1")
    ends = CE.pair_extremes(vecs).first()  # two numbers
    m = D.pair_moments(vecs).withColumns({c: F.lit(ends[c]).cast("double") for c in ("min", "max")})
    return m.select("n_pairs", *[_r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@register("anisotropy_sampled", O.with_(O.PE, _UNIT_SQL) + """
, nn AS (SELECT count(DISTINCT paper_id) AS n FROM unit),
params AS (SELECT n // 2 AS per_round, (2000 + n // 2 - 1) // (n // 2) AS rounds FROM nn),
keyed AS (SELECT p.paper_id, r.round,
                 ('0x' || substr(md5(p.paper_id || ':0:' || r.round), 1, 8))::BIGINT AS key
          FROM (SELECT DISTINCT paper_id FROM unit) p
          CROSS JOIN (SELECT unnest(range((SELECT rounds FROM params))) AS round) r),
ranked AS (SELECT paper_id, round, row_number() OVER (PARTITION BY round ORDER BY key, paper_id) - 1 AS pos
           FROM keyed),
sel AS (SELECT paper_id, pos, round * (SELECT per_round FROM params) + pos // 2 AS k FROM ranked
        WHERE pos < 2 * least((SELECT per_round FROM params), 2000)),
pairs AS (SELECT a.k, a.paper_id AS id_a, b.paper_id AS id_b FROM sel a JOIN sel b
          ON a.k = b.k AND a.pos % 2 = 0 AND b.pos % 2 = 1 WHERE a.k < 2000),
sims AS (SELECT p.k, sum(ua.u * ub.u) AS s FROM pairs p JOIN unit ua ON ua.paper_id = p.id_a
         JOIN unit ub ON ub.paper_id = p.id_b AND ub.i = ua.i GROUP BY p.k)
SELECT count(*) AS n_pairs, round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) + 0.0 AS std,
       round(min(s), 6) + 0.0 AS min, round(max(s), 6) + 0.0 AS max FROM sims""")
def anisotropy_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """V8: 2,000 seeded random pairs of distinct vectors: mean/std/min/max
    (the sampling operator: the cap on pairs is the feature)."""
    pairs = D.sample_pairs(V.vectors_of(TB.paper_embeddings(spark, sf), "m1"))
    st = D.sampled_pair_stats(pairs)
    return st.select("n_pairs", *[_r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@register("category_exemplars", O.with_(O.ENTRIES, O.PAPERS, O.PE, _UNIT_SQL) + """
, cand AS (SELECT p.arxiv_id, p.title, p.primary_category FROM papers p WHERE p.arxiv_id IN (SELECT paper_id FROM unit)),
a AS (SELECT arxiv_id, title FROM cand WHERE starts_with(primary_category, 'src1') ORDER BY arxiv_id LIMIT 1),
b AS (SELECT arxiv_id, title FROM cand WHERE primary_category = 'src0' ORDER BY arxiv_id LIMIT 1)
SELECT a.arxiv_id AS id_a, a.title AS title_a, b.arxiv_id AS id_b, b.title AS title_b,
       round((SELECT sum(x.u * y.u) FROM unit x JOIN unit y ON x.i = y.i WHERE x.paper_id = a.arxiv_id
              AND y.paper_id = b.arxiv_id), 6) + 0.0 AS similarity
FROM a CROSS JOIN b""")
def category_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    """V9: similarity of the first 'src1*' paper and the first 'src0' paper."""
    out = D.category_exemplars(TB.papers(spark, sf), V.vectors_of(TB.paper_embeddings(spark, sf), "m1"),
                               "src1", "src0")
    return out.withColumn("similarity", _r6("similarity"))


@register("page_by_submitted", """
SELECT o_orderkey, """ + O.iso("o_orderdate") + """ AS o_orderdate FROM orders
ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 20""")
def page_by_submitted(spark: SparkSession, sf: str) -> DataFrame:
    """S3: second page of 20, ascending by date then key."""
    o = TB.table(spark, sf, "orders")
    return LK.page(o, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], 20, 20).select(
        "o_orderkey", _iso("o_orderdate").alias("o_orderdate"))


@register("page_by_updated", """
SELECT o_orderkey, """ + O.iso("o_orderdate") + """ AS o_orderdate FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20""")
def page_by_updated(spark: SparkSession, sf: str) -> DataFrame:
    """S3: second page of 20, descending."""
    o = TB.table(spark, sf, "orders")
    return LK.page(o, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 20, 20).select(
        "o_orderkey", _iso("o_orderdate").alias("o_orderdate"))


@register("bulk_cap", """
SELECT o_orderkey, """ + O.iso("o_orderdate") + """ AS o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 150""")
def bulk_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk read capped at a total of 150 in arrival order."""
    o = TB.table(spark, sf, "orders")
    return LK.page(o, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], 0, 150).select(
        "o_orderkey", _iso("o_orderdate").alias("o_orderdate"))


@register("bulk_cap_files", """
SELECT o_orderkey, """ + O.iso("o_orderdate") + """ AS o_orderdate FROM (SELECT * FROM orders LIMIT 150)""")
def bulk_cap_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first 150 rows in the order of the files, by counts of their splits."""
    o = first_entries(spark.read.parquet(f"{sf}/orders.parquet"), 150)
    return o.select("o_orderkey", _iso("o_orderdate").alias("o_orderdate"))


_HASH_SQL = ("toks AS (SELECT arxiv_id, unnest(regexp_extract_all(lower(title || '[SEP]' || abstract), "
             "'[a-z0-9]+')[1:512]) AS tok FROM {src}), "
             "hv AS (SELECT arxiv_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM toks), "
             "enc AS (SELECT arxiv_id AS paper_id, h % 64 AS pos, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) "
             "AS value FROM hv GROUP BY arxiv_id, h % 64)")


@register("hash_encode", O.with_(O.ENTRIES, _HASH_SQL.format(src="entries")) + """
SELECT paper_id, pos, value::DOUBLE AS value FROM enc WHERE value <> 0""")
def hash_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Encode every paper's title[SEP]abstract (first 512 tokens);
    non-zero elements as rows."""
    e = TB.paper_entries(spark, sf)
    texts = e.select("arxiv_id", TX.document_text("title", "abstract").alias("text"))
    vecs = EM.encode(texts, "text", "arxiv_id")
    return (vecs.select(F.col("arxiv_id").alias("paper_id"), F.posexplode("embedding").alias("pos", "value"))
            .where(F.col("value") != 0)
            .select("paper_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")))


@register("embed_missing", O.with_(O.ENTRIES, O.PAPERS, O.PE,
                                  "todo AS (SELECT * FROM papers WHERE arxiv_id NOT IN (SELECT paper_id FROM pe WHERE model = 'm2'))",
                                  _HASH_SQL.format(src="todo")) + """
SELECT paper_id, model, dim, round(list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, b: a + b), 6) + 0.0
       AS checksum FROM pe WHERE model = 'm2'
UNION ALL
SELECT arxiv_id, 'm2', 64::INTEGER, coalesce((SELECT sum(value) FROM enc WHERE enc.paper_id = todo.arxiv_id), 0)::DOUBLE FROM todo""")
def embed_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Encode only papers lacking an m2 vector, upsert; the m2 table after."""
    nxt = EM.embed_missing(TB.papers(spark, sf), TB.paper_embeddings(spark, sf), "m2", TB.ts(TB.BATCH_TS))
    return nxt.where(F.col("model") == "m2").select("paper_id", "model", "dim",
                                                    _checksum("embedding").alias("checksum"))


@register("ask_listing", O.with_(*_BASE, *O.hybrid_ctes("m1")) + """
, a AS (SELECT h.question_id, h.rrf, p.arxiv_id, p.title, p.abs_url,
               row_number() OVER (PARTITION BY h.question_id ORDER BY h.rank) AS pos
        FROM hyb h JOIN papers p ON p.arxiv_id = h.paper_id WHERE h.rank <= 5)
SELECT question_id, pos AS position,
       printf('%d. [%.3f] %s' || chr(10) || '   %s - %s', pos, rrf, title, arxiv_id, abs_url) AS line FROM a""")
def ask_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered listing of the ask results (position among returned papers)."""
    from pyspark.sql import Window
    a = H.ask(TB.papers(spark, sf), TB.paper_embeddings(spark, sf), TB.questions(spark, sf), "m1")
    pos = F.row_number().over(Window.partitionBy("question_id").orderBy("rank")).cast("long")
    return (a.withColumn("position", pos)
            .select("question_id", "position",
                    TX.result_listing("position", "score", "title", "arxiv_id", "abs_url").alias("line")))


def _dense_hash_sql(src: str, key: str, text: str, out: str) -> str:
    """SQL CTEs: hash-encode ``text`` of ``src`` rows into a dense 64-vector."""
    return (f"{out}_t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')[1:512]) AS tok "
            f"FROM {src}), "
            f"{out}_h AS (SELECT k, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM {out}_t), "
            f"{out}_s AS (SELECT k, h % 64 AS pos, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v "
            f"FROM {out}_h GROUP BY k, h % 64), "
            f"{out} AS (SELECT s.{key} AS k, list(coalesce(x.v, 0)::FLOAT ORDER BY g.pos) AS vec FROM {src} s "
            f"CROSS JOIN range(64) g(pos) LEFT JOIN {out}_s x ON x.k = s.{key} AND x.pos = g.pos GROUP BY s.{key})")


_ENC_PE = ("pe AS (SELECT k AS paper_id, 'hash' AS model, vec AS embedding, 64::INTEGER AS dim, "
           "TIMESTAMP '2024-08-01' AS created_at FROM dvec)")
_ENC_Q = ("questions AS (SELECT b.item_id AS question_id, b.text AS question, q.vec AS qvec FROM benchmark b "
          "JOIN qvec q ON q.k = b.item_id)")


@register("ask_encoded", O.with_(O.ENTRIES, O.PAPERS,
                                 _dense_hash_sql("entries", "arxiv_id", "title || '[SEP]' || abstract", "dvec"),
                                 _dense_hash_sql("benchmark", "item_id", "text", "qvec"),
                                 _ENC_PE, _ENC_Q, *O.hybrid_ctes("hash")) + _ASK_SQL)
def ask_encoded(spark: SparkSession, sf: str) -> DataFrame:
    """E4 + E2 + Q1 end to end: embed every paper lacking a 'hash' vector,
    encode the questions with the same encoder (query mode), then ask."""
    papers = TB.papers(spark, sf)
    pe = EM.embed_missing(papers, TB.paper_embeddings(spark, sf), "hash", TB.ts(TB.BATCH_TS))
    b = TB.table(spark, sf, "benchmark")
    qv = EM.encode(b.select(F.col("item_id").cast("string").alias("qid"), "text"), "text", "qid", mode="query")
    qs = (b.join(qv, b.item_id.cast("string") == qv.qid)
          .select(F.col("item_id").alias("question_id"), F.col("text").alias("question"),
                  F.col("embedding").alias("qvec")))
    return H.ask(papers, pe, qs, "hash").withColumn("score", F.round("score", 9))
