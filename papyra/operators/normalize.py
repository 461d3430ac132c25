"""Feed entry -> paper projection and validation.

One ``select`` of built-in expressions (all whole-stage codegen), applied to
entries as read by ``papyra.sources.atom`` (Spark's XML source, rowTag=entry).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import normalize_whitespace

# Required (non-null) paper fields; empty strings are valid, NULLs are not.
REQUIRED = ("arxiv_id", "title", "abstract", "authors", "categories", "primary_category",
            "published", "updated", "pdf_url", "abs_url")


def entry_id(id_col) -> F.Column:
    """Text after the last '/abs/'; the whole id when absent."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.element_at(F.split(c, "/abs/"), -1)


def pdf_url(id_col: str = "id", link_col: str = "link") -> F.Column:
    """First link titled 'pdf', else the id with /abs/ -> /pdf/."""
    titled = F.transform(F.filter(F.col(link_col), lambda l: l["_title"] == F.lit("pdf")),
                         lambda l: l["_href"])
    first = F.when(F.size(titled) > 0, F.element_at(titled, 1))
    return F.coalesce(first, F.replace(F.col(id_col), F.lit("/abs/"), F.lit("/pdf/")))


def category_terms(category_col: str = "category") -> F.Column:
    """Category terms in feed order, duplicates kept, [] when absent."""
    return F.coalesce(F.transform(F.col(category_col), lambda c: c["_term"]),
                      F.array().cast("array<string>"))


def primary_category(primary_col: str = "`arxiv:primary_category`", categories: F.Column | None = None) -> F.Column:
    """Own element's term, else the first category, else ''."""
    cats = categories if categories is not None else category_terms()
    first = F.when(F.size(cats) > 0, F.element_at(cats, 1))
    return F.coalesce(F.col(primary_col)["_term"], first, F.lit(""))


def to_seconds(text_col) -> F.Column:
    """Feed timestamp text -> naive UTC, truncated to whole seconds; NULL for a
    text that is no time (validation then quarantines the entry)."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.date_trunc("second", F.try_to_timestamp(c)).cast("timestamp_ntz")


def truncate_seconds(ts_col) -> F.Column:
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    return F.date_trunc("second", c).cast("timestamp_ntz")


def normalize_entries(entries: DataFrame, keep=()) -> DataFrame:
    """Atom entries -> PAPER_SCHEMA columns (+ ``keep`` passthrough columns)."""
    cats = category_terms()
    return entries.select(
        entry_id("id").alias("arxiv_id"),
        normalize_whitespace("title").alias("title"),
        normalize_whitespace("summary").alias("abstract"),
        F.coalesce(F.transform("author", lambda a: a["name"]), F.array().cast("array<string>")).alias("authors"),
        cats.alias("categories"),
        primary_category(categories=cats).alias("primary_category"),
        to_seconds("published").alias("published"),
        to_seconds("updated").alias("updated"),
        pdf_url().alias("pdf_url"),
        F.col("id").alias("abs_url"),
        F.col("`arxiv:comment`").alias("comment"),
        F.col("`arxiv:journal_ref`").alias("journal_ref"),
        F.lit(None).cast("string").alias("doi"),
        *keep,
    )


def validate_papers(papers: DataFrame, required=REQUIRED, extra_required=()) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejects).  Rejects carry ``reasons``: one text per
    violated rule.  Nothing is raised; bad rows are quarantined."""
    checks = []
    for c in (*required, *extra_required):
        checks.append(F.when(F.col(c).isNull(), F.lit(f"{c} is null")))
    for c in ("authors", "categories"):
        if c in papers.columns:
            checks.append(F.when(F.exists(F.col(c), lambda x: x.isNull()), F.lit(f"{c} has a null element")))
    reasons = F.filter(F.array(*checks), lambda x: x.isNotNull())
    tagged = papers.withColumn("reasons", reasons)
    valid = tagged.where(F.size("reasons") == 0).drop("reasons")
    rejects = tagged.where(F.size("reasons") > 0)
    return valid, rejects
