"""Keyword overlap: |tokens(question) & tokens(title + ' ' + abstract)|.

``keyword_overlap`` is the sparse form: distinct document tokens are joined to
the question tokens and pairs are counted; only (question, paper) pairs that
share a token appear.  Spark picks the join from the sizes it measures.  A common
token still makes a pair with every question that has it, so this is for
reports; hybrid search counts overlaps inside its scoring pass instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import tokenize

def paper_texts(universe: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, text): title + ' ' + abstract, or '' when the paper has no
    metadata row."""
    ids = universe.select(F.col("paper_id").alias("arxiv_id"))
    # semi join first: Catalyst pushes it below the paper projection, so only
    # papers that have a vector are read and shaped
    p = (papers.join(ids, "arxiv_id", "left_semi")
         .select(F.col("arxiv_id").alias("paper_id"), F.concat_ws(" ", "title", "abstract").alias("_t")))
    return (universe.select("paper_id").join(p, "paper_id", "left")
            .select("paper_id", F.coalesce("_t", F.lit("")).alias("text")))


def paper_tokens(texts: DataFrame) -> DataFrame:
    return texts.select("paper_id", F.explode(tokenize("text")).alias("token"))


def question_tokens(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode(tokenize("question")).alias("token"))


def keyword_overlap(doc_tokens: DataFrame, q_tokens: DataFrame) -> DataFrame:
    """Sparse (question_id, paper_id, overlap) for pairs with overlap > 0."""
    return (doc_tokens.join(q_tokens, "token")
            .groupBy("question_id", "paper_id")
            .agg(F.count(F.lit(1)).alias("overlap")))
