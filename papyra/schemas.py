"""Hand-written schemas.  Nothing in the engine is schema-inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
TS = T.TimestampNTZType()

# A paper as normalised from one feed entry, before it is split into tables.
PAPER_SCHEMA = T.StructType([
    T.StructField("arxiv_id", S, False),
    T.StructField("title", S, False),
    T.StructField("abstract", S, False),
    T.StructField("authors", T.ArrayType(S, False), False),
    T.StructField("categories", T.ArrayType(S, False), False),
    T.StructField("primary_category", S, False),
    T.StructField("published", TS, False),
    T.StructField("updated", TS, False),
    T.StructField("pdf_url", S, False),
    T.StructField("abs_url", S, False),
    T.StructField("comment", S, True),
    T.StructField("journal_ref", S, True),
    T.StructField("doi", S, True),
])

# Stored tables.
PAPERS = T.StructType([
    T.StructField("arxiv_id", S, False),
    T.StructField("title", S, False),
    T.StructField("abstract", S, False),
    T.StructField("primary_category", S, False),
    T.StructField("published", TS, False),
    T.StructField("updated", TS, False),
    T.StructField("pdf_url", S, False),
    T.StructField("abs_url", S, False),
    T.StructField("comment", S, True),
    T.StructField("journal_ref", S, True),
    T.StructField("doi", S, True),
    T.StructField("ingested_at", TS, False),
])

AUTHORS = T.StructType([
    T.StructField("author_id", T.LongType(), False),
    T.StructField("name", S, False),
])

PAPER_AUTHORS = T.StructType([
    T.StructField("paper_id", S, False),
    T.StructField("author_id", T.LongType(), False),
    T.StructField("author_order", T.IntegerType(), False),
])

CATEGORIES = T.StructType([T.StructField("code", S, False)])

PAPER_CATEGORIES = T.StructType([
    T.StructField("paper_id", S, False),
    T.StructField("category_code", S, False),
])

PAPER_EMBEDDINGS = T.StructType([
    T.StructField("paper_id", S, False),
    T.StructField("model", S, False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    T.StructField("dim", T.IntegerType(), False),
    T.StructField("created_at", TS, False),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.LongType(), False),
    T.StructField("question", S, False),
    T.StructField("qvec", T.ArrayType(T.FloatType(), False), True),
])

TABLE_SCHEMAS = {
    "papers": PAPERS,
    "authors": AUTHORS,
    "paper_authors": PAPER_AUTHORS,
    "categories": CATEGORIES,
    "paper_categories": PAPER_CATEGORIES,
    "paper_embeddings": PAPER_EMBEDDINGS,
}

# Atom entry as read by Spark's XML source with rowTag=entry.  Attributes come
# in with a leading underscore; namespaced elements keep their prefix.
_LINK = T.StructType([
    T.StructField("_href", S, True),
    T.StructField("_rel", S, True),
    T.StructField("_title", S, True),
    T.StructField("_type", S, True),
])
_TERM = T.StructType([T.StructField("_term", S, True), T.StructField("_scheme", S, True)])
ATOM_ENTRY = T.StructType([
    T.StructField("id", S, True),
    T.StructField("updated", S, True),
    T.StructField("published", S, True),
    T.StructField("title", S, True),
    T.StructField("summary", S, True),
    T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", S, True)])), True),
    T.StructField("arxiv:comment", S, True),
    T.StructField("arxiv:journal_ref", S, True),
    T.StructField("link", T.ArrayType(_LINK), True),
    T.StructField("arxiv:primary_category", _TERM, True),
    T.StructField("category", T.ArrayType(_TERM), True),
])
