"""Logical tables derived from the driver's parquet tables.

The driver ships generic tables (``documents``, ``embeddings``, ``benchmark``,
``lineitem`` ...).  This module maps them, with plain column expressions, onto
the engine's data model: feed entries / papers, paper vectors and questions.
Every mapping reads the whole table; the same mapping is written in SQL in
``papyra.plans.oracle`` so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import first_line, normalize_whitespace

# Fixed values of the fixture mapping.
ID_WIDTH = 19  # digits of any bigint: padding never cuts
BASE_URL = "http://x"
EPOCH = "2024-01-01 00:00:00"
CREATED_AT = "2024-06-01 00:00:00"
INGESTED_AT = "2024-07-01 00:00:00"
BATCH_TS = "2024-08-01 00:00:00"
DAYS = 100000  # entry dates repeat after so many documents
LATER = 1 << 40  # arrival numbers of second arrivals come after all first ones


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def padded_id(x) -> F.Column:
    return F.lpad(F.col(x).cast("string"), ID_WIDTH, "0")


def ts(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def author_names() -> F.Column:
    """Three names with a repeat (first position must win); every fifth
    document has a fourth author (labels then end in 'et al.')."""
    d = F.col("doc_id")
    base = F.array(F.concat(F.lit("a"), (d % 97).cast("string")),
                   F.concat(F.lit("b"), (d % 53).cast("string")),
                   F.concat(F.lit("a"), (d % 97).cast("string")))
    extra = F.when(d % 5 == 0, F.array(F.concat(F.lit("c"), (d % 29).cast("string")))).otherwise(
        F.array().cast("array<string>"))
    return F.concat(base, extra)


def paper_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normalised paper (PAPER_SCHEMA) per document."""
    d = table(spark, sf_dir, "documents")
    pid = padded_id("doc_id")
    return d.select(
        pid.alias("arxiv_id"),
        normalize_whitespace(first_line("text")).alias("title"),
        normalize_whitespace("text").alias("abstract"),
        author_names().alias("authors"),
        F.array(F.col("source"), F.col("lang"), F.col("source")).alias("categories"),
        F.col("source").alias("primary_category"),
        F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(cast(doc_id % {DAYS} as int))").alias("published"),
        F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(cast(doc_id % {DAYS} as int) + 1)").alias("updated"),
        F.concat(F.lit(BASE_URL + "/pdf/"), pid).alias("pdf_url"),
        F.concat(F.lit(BASE_URL + "/abs/"), pid).alias("abs_url"),
        F.lit(None).cast("string").alias("comment"),
        F.lit(None).cast("string").alias("journal_ref"),
        F.lit(None).cast("string").alias("doi"),
        F.col("doc_id"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ``papers`` table for the whole corpus."""
    return paper_entries(spark, sf_dir).select(
        "arxiv_id", "title", "abstract", "primary_category", "published", "updated",
        "pdf_url", "abs_url", "comment", "journal_ref", "doi",
        ts(INGESTED_AT).alias("ingested_at"))


def paper_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors: every vector under model ``m1``; every fourth vector
    is also stored under a second model ``m2`` (two vector spaces)."""
    e = table(spark, sf_dir, "embeddings")
    base = e.select(padded_id("vec_id").alias("paper_id"), F.col("embedding").cast("array<float>").alias("embedding"),
                    F.col("vec_id"))
    m1 = base.withColumn("model", F.lit("m1"))
    m2 = base.where(F.col("vec_id") % 4 == 0).withColumn("model", F.lit("m2"))
    both = m1.unionByName(m2)
    return both.select("paper_id", "model", "embedding", F.size("embedding").alias("dim"),
                       ts(CREATED_AT).alias("created_at"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a question; its query vector is the stored
    vector with the same number (NULL where there is none: such a question finds
    nothing)."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings")
    return (b.join(e, b.item_id == e.vec_id, "left")
            .select(F.col("item_id").alias("question_id"), F.col("text").alias("question"),
                    F.col("embedding").cast("array<float>").alias("qvec")))


def incoming_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingest batch over the corpus: documents divisible by two or three
    arrive with a new title (seq = doc_id; those divisible by three are not stored
    yet), documents divisible by ten arrive a second time later in the same batch
    (seq = doc_id + LATER) with another title.  ``doi`` is
    NULL in the batch, as in a real re-ingest."""
    e = paper_entries(spark, sf_dir)
    v2 = (e.where((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0))
          .withColumn("title", F.concat("title", F.lit(" v2")))
          .withColumn("seq", F.col("doc_id")))
    v3 = (e.where(F.col("doc_id") % 10 == 0)
          .withColumn("title", F.concat("title", F.lit(" v3")))
          .withColumn("authors", F.reverse("authors"))
          .withColumn("seq", F.col("doc_id") + LATER))
    return v2.unionByName(v3)


def current_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The already-stored part of the corpus before the batch: documents not
    divisible by three."""
    e = paper_entries(spark, sf_dir)
    return (e.where(F.col("doc_id") % 3 != 0)
            .withColumn("doi", F.concat(F.lit("10.1/"), F.col("arxiv_id")))
            .withColumn("seq", F.col("doc_id")))


def papers_without_labelled(spark: SparkSession, sf_dir: str, predicate: str) -> DataFrame:
    """``papers`` after removing the documents whose label row matches
    ``predicate`` (e.g. ``toxic = 1``): a corpus state in which some stored
    vectors have lost their paper row."""
    flagged = table(spark, sf_dir, "labels").where(predicate).select("doc_id")
    kept = paper_entries(spark, sf_dir).join(flagged, "doc_id", "left_anti")
    return kept.select(
        "arxiv_id", "title", "abstract", "primary_category", "published", "updated",
        "pdf_url", "abs_url", "comment", "journal_ref", "doi",
        ts(INGESTED_AT).alias("ingested_at"))


def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents shaped as Atom entries (ATOM_ENTRY), one per document, with
    the feed's irregularities: every third entry has a titled pdf link, every
    fourth lacks its primary-category element, every eighth has no category
    elements, every seventh has an old-style id with a slash, every eleventh an
    id without '/abs/', every fiftieth a missing title, every 45th a date that
    is none; times carry fractions of a second.  Title and summary keep the raw whitespace."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    pid = padded_id("doc_id")
    ident = (F.when(doc % 11 == 0, F.concat(F.lit("urn:x:"), pid))
             .when(doc % 7 == 0, F.concat(F.lit(BASE_URL + "/abs/cs/"), pid))
             .otherwise(F.concat(F.lit(BASE_URL + "/abs/"), pid)))
    null = F.lit(None).cast("string")
    alt = F.struct(ident.alias("_href"), F.lit("alternate").alias("_rel"), null.alias("_title"),
                   F.lit("text/html").alias("_type"))
    pdf = F.struct(F.concat(F.lit(BASE_URL + "/files/"), pid, F.lit(".pdf")).alias("_href"),
                   F.lit("related").alias("_rel"), F.lit("pdf").alias("_title"),
                   F.lit("application/pdf").alias("_type"))
    when_ts = F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(cast(doc_id % {DAYS} as int), 0, 0, "
                     f"cast(doc_id % 60 as decimal(8,2)) + 0.75)")
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SS'Z'"
    term = lambda c: F.struct(c.alias("_term"), null.alias("_scheme"))
    return d.select(
        ident.alias("id"),
        F.date_format(when_ts + F.expr("INTERVAL 1 DAY"), fmt).alias("updated"),
        F.when(doc % 45 == 0, F.lit("soon")).otherwise(F.date_format(when_ts, fmt)).alias("published"),
        F.when(doc % 50 != 0, first_line("text")).alias("title"),
        F.col("text").alias("summary"),
        F.transform(author_names(), lambda n: F.struct(n.alias("name"))).alias("author"),
        F.when(doc % 6 == 0, F.concat(F.lit("pages: "), (doc % 40).cast("string"))).alias("arxiv:comment"),
        null.alias("arxiv:journal_ref"),
        F.when(doc % 3 == 0, F.array(alt, pdf)).otherwise(F.array(alt)).alias("link"),
        F.when(doc % 4 != 0, term(F.col("source"))).alias("arxiv:primary_category"),
        F.when(doc % 8 != 0, F.array(term(F.col("source")), term(F.col("lang")))).alias("category"),
        doc.alias("doc_id"),
    )


def incoming_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector batch: every third vector re-encoded under m1 (doubled),
    vectors 1 mod 3 newly encoded under m2 (negated); later in the batch,
    broken re-encodings (a NaN element every 25th, a truncated vector every
    35th) that must be quarantined, leaving the earlier write in force."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", padded_id("vec_id").alias("paper_id"), F.col("embedding").cast("array<float>").alias("emb"))
    v = F.col("vec_id")
    twice = e.where(v % 3 == 0).select("paper_id", F.lit("m1").alias("model"),
                                       F.transform("emb", lambda x: x * 2).alias("embedding"), v.alias("seq"))
    neg = e.where(v % 3 == 1).select("paper_id", F.lit("m2").alias("model"),
                                     F.transform("emb", lambda x: -x).alias("embedding"), v.alias("seq"))
    nan = e.where(v % 25 == 0).select(
        "paper_id", F.lit("m1").alias("model"),
        F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("emb", 2, 1 << 20)).alias("embedding"),
        (v + LATER).alias("seq"))
    short = e.where(v % 35 == 0).select("paper_id", F.lit("m1").alias("model"),
                                        F.slice("emb", 1, 10).alias("embedding"), (v + 2 * LATER).alias("seq"))
    return twice.unionByName(neg).unionByName(nan).unionByName(short)
