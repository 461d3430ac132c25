"""Lookups, filters, fielded predicates and paging.

Point lookups are written in batch form: a table of ids joined to the corpus,
so a million lookups cost one join, not a million queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import ascii_lower

METADATA_COLS = ("arxiv_id", "title", "abstract", "primary_category", "pdf_url", "abs_url")


def paper_exists(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """(arxiv_id, present) for each distinct requested id."""
    req = ids.select("arxiv_id").distinct()
    known = papers.select("arxiv_id", F.lit(True).alias("_hit"))
    return (req.join(known, "arxiv_id", "left")
            .select("arxiv_id", F.coalesce("_hit", F.lit(False)).alias("present")))


def papers_by_ids(papers: DataFrame, ids: DataFrame, cols=METADATA_COLS) -> DataFrame:
    """Metadata of the requested ids; unknown ids vanish, no bound on the
    number of ids."""
    req = ids.select("arxiv_id").distinct()
    return papers.join(req, "arxiv_id", "left_semi").select(*cols)


def embedding_lookup(paper_embeddings: DataFrame, ids: DataFrame, model: str) -> DataFrame:
    """Vectors of the requested ids for one model (nothing for unknown ids)."""
    req = ids.select(F.col("arxiv_id").alias("paper_id")).distinct()
    return (paper_embeddings.where(F.col("model") == F.lit(model))
            .join(req, "paper_id", "left_semi"))


def papers_missing_embedding(papers: DataFrame, paper_embeddings: DataFrame, model: str) -> DataFrame:
    """Anti join: papers with no vector of ``model`` (a vector of another
    model does not count)."""
    have = (paper_embeddings.where(F.col("model") == F.lit(model))
            .select(F.col("paper_id").alias("arxiv_id")))
    return papers.join(have, "arxiv_id", "left_anti")


class field:
    """Fielded predicates over nested papers (PAPER_SCHEMA rows).  Combine
    with ``&`` (AND), ``|`` (OR) and ``& ~`` (ANDNOT).  Both sides fold A-Z only,
    so terms in any script match themselves."""

    @staticmethod
    def title(term: str) -> Column:
        return F.contains(ascii_lower("title"), ascii_lower(F.lit(term)))

    @staticmethod
    def abstract(term: str) -> Column:
        return F.contains(ascii_lower("abstract"), ascii_lower(F.lit(term)))

    @staticmethod
    def author(name: str) -> Column:
        return F.exists("authors", lambda a: ascii_lower(a) == ascii_lower(F.lit(name)))

    @staticmethod
    def category(code: str) -> Column:
        return F.array_contains("categories", F.lit(code))

    @staticmethod
    def id(arxiv_id: str) -> Column:
        return F.col("arxiv_id") == F.lit(arxiv_id)


def get_by_id(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """At most one paper per requested id."""
    req = ids.select("arxiv_id").distinct()
    return papers.join(req, "arxiv_id", "left_semi").dropDuplicates(["arxiv_id"])


SORT_FIELDS = {"submitted": "published", "updated": "updated"}


def search_papers(papers: DataFrame, predicate: Column, sort_by: str = "submitted", descending: bool = True,
                  start: int = 0, max_results: int = 20) -> DataFrame:
    """Fielded search in one step: the papers that match ``predicate``, by
    submitted or updated time (ties by id, in the same direction), one page of
    them."""
    if sort_by not in SORT_FIELDS:
        raise ValueError(f"sort_by must be one of {sorted(SORT_FIELDS)}")
    order = [F.col(SORT_FIELDS[sort_by]), F.col("arxiv_id")]
    return page(papers.where(predicate), [c.desc() if descending else c.asc() for c in order], start, max_results)


def page(df: DataFrame, order_cols, start: int = 0, max_results: int = 20) -> DataFrame:
    """Offset/limit page of a totally ordered result (each map task keeps
    only its first start + max_results rows)."""
    if start < 0 or max_results < 0:
        raise ValueError("start and max_results must be >= 0")
    return df.orderBy(*order_cols).offset(start).limit(max_results)
