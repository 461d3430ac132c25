"""Set-based upserts: (current tables, incoming batch) -> next tables.

Rules reproduced:
  * papers: last write (largest ``seq``) wins for every scalar, NULLs included;
    ``ingested_at`` of an existing paper is kept forever.
  * categories / paper_categories / authors / paper_authors: insert if absent;
    links only accumulate, and an existing (paper, author) link keeps its first
    order.  Within a batch the earliest (seq, position) wins.
  * author ids: new names are numbered on from the largest id in the order of
    their first appearance (seq, then position); existing ids never change.
  * vectors: keyed by (paper, model); last write wins, ``created_at`` and
    ``dim`` are refreshed; NULL, non-finite and wrong-length vectors are
    quarantined first.

"Latest per key" is a grouped max over a struct led by ``seq``: it aggregates
partially on the map side, so a key repeated in a third of a batch still
ships one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.schemas import TABLE_SCHEMAS
from papyra.session import checkpoint_dir

RANK_BINS = 4096  # of each of the two levels that number new names

PAPER_COLS = ("arxiv_id", "title", "abstract", "primary_category", "published", "updated",
              "pdf_url", "abs_url", "comment", "journal_ref", "doi")


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Create-if-absent: empty frames with the stored schemas."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLE_SCHEMAS.items()}


def latest_per_key(incoming: DataFrame, keys, cols, seq_col: str = "seq") -> DataFrame:
    """The row with the largest seq per key.  Only keys and seqs are aggregated
    (by hash); the rows themselves are joined to the winners, not sorted.  Of rows
    equal in key and seq, one stays."""
    keys = list(keys)
    last = incoming.groupBy(*keys).agg(F.max(seq_col).alias(seq_col))
    return (incoming.select(*keys, seq_col, *cols).join(last, [*keys, seq_col], "left_semi")
            .dropDuplicates([*keys, seq_col]).select(*keys, *cols))


def upsert_papers(current: DataFrame, incoming: DataFrame, batch_ts) -> DataFrame:
    """Next ``papers`` table."""
    cols = [c for c in PAPER_COLS if c != "arxiv_id"]
    last = latest_per_key(incoming, ["arxiv_id"], cols)
    kept = current.join(last.select("arxiv_id"), "arxiv_id", "left_anti")
    first_seen = current.select("arxiv_id", F.col("ingested_at").alias("_first"))
    written = (last.join(first_seen, "arxiv_id", "left")
               .withColumn("ingested_at", F.coalesce(F.col("_first"), F.lit(batch_ts).cast("timestamp_ntz")))
               .drop("_first"))
    return kept.unionByName(written.select(*PAPER_COLS, "ingested_at"))


def upsert_counts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(new_count, updated_count): a second arrival of an id inside the
    batch counts as an update."""
    known = current.select("arxiv_id", F.lit(True).alias("_known"))
    tagged = incoming.select("arxiv_id").join(known, "arxiv_id", "left")
    return tagged.agg(
        F.countDistinct(F.when(F.col("_known").isNull(), F.col("arxiv_id"))).cast("long").alias("new_count"),
        (F.count(F.lit(1)) - F.countDistinct(F.when(F.col("_known").isNull(), F.col("arxiv_id"))))
        .cast("long").alias("updated_count"))


def upsert_categories(current: DataFrame, incoming: DataFrame) -> DataFrame:
    codes = incoming.select(F.explode("categories").alias("code")).distinct()
    return current.unionByName(codes.join(current, "code", "left_anti"))


def upsert_paper_categories(current: DataFrame, incoming: DataFrame) -> DataFrame:
    links = (incoming.select(F.col("arxiv_id").alias("paper_id"), F.explode("categories").alias("category_code"))
             .dropDuplicates(["paper_id", "category_code"]))
    return current.unionByName(links.join(current, ["paper_id", "category_code"], "left_anti"))


def _author_mentions(incoming: DataFrame) -> DataFrame:
    return incoming.select(F.col("arxiv_id").alias("paper_id"), "seq",
                           F.posexplode("authors").alias("pos", "name"))


def upsert_authors(current: DataFrame, incoming: DataFrame, id_base=None) -> DataFrame:
    """Next ``authors`` table (author_id, name).

    ``id_base``: the largest id ever given out, when the caller tracks it
    (then ``current`` may hold only the name buckets the batch touches);
    by default the largest id in ``current``.  The new names are checkpointed
    before they are numbered: numbering reads them several times."""
    checkpoint_dir(incoming.sparkSession)
    m = _author_mentions(incoming)
    first = m.groupBy("name").agg(F.min(F.struct("seq", "pos")).alias("_f"))
    fresh = first.join(current.select("name"), "name", "left_anti").select("name", "_f.seq", "_f.pos").checkpoint()
    base = (F.lit(int(id_base)).cast("long") if id_base is not None else
            current.agg(F.coalesce(F.max("author_id"), F.lit(0)).cast("long")).scalar())
    ids = _numbered(fresh).select((base + F.col("_rank")).cast("long").alias("author_id"), "name").checkpoint()
    return current.unionByName(ids)


def _numbered(fresh: DataFrame) -> DataFrame:
    """``fresh`` (name, seq, pos) with _rank from 1 by (seq, pos, name).

    No task sorts the whole batch: seqs are cut into RANK_BINS equal ranges, each
    of which is cut again between its own least and largest seq (so a few far
    seqs do not empty the rest); counts of the pieces give each its offset and
    rows are numbered inside their piece."""
    def cut(lo, hi):
        span = F.greatest(F.col(hi).cast("double") - F.col(lo).cast("double"), F.lit(1.0))
        return F.least(F.floor((F.col("seq").cast("double") - F.col(lo).cast("double")) / span * RANK_BINS), F.lit(RANK_BINS))

    ends = fresh.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    d = fresh.withColumn("_lo", ends.select("lo").scalar()).withColumn("_hi", ends.select("hi").scalar())
    d = d.withColumn("_a", cut("_lo", "_hi")).drop("_lo", "_hi")
    inner = d.groupBy("_a").agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    d = d.join(inner, "_a").withColumn("_b", cut("_lo", "_hi")).drop("_lo", "_hi")
    n = d.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    rest = Window.unboundedPreceding
    within = n.withColumn("_ob", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_a").orderBy("_b").rowsBetween(rest, -1)), F.lit(0)))
    whole = n.groupBy("_a").agg(F.sum("_n").alias("_n")).withColumn("_oa", F.coalesce(F.sum("_n").over(
        Window.orderBy("_a").rowsBetween(rest, -1)), F.lit(0)))
    row = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("seq", "pos", "name"))
    return d.withColumn("_row", row).join(within.select("_a", "_b", "_ob"), ["_a", "_b"]).join(
        whole.select("_a", "_oa"), "_a").withColumn("_rank", F.col("_oa") + F.col("_ob") + F.col("_row"))


def upsert_paper_authors(current: DataFrame, authors: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next ``paper_authors``: the earliest (seq, position) of each new link
    gives its order; existing links are never touched."""
    m = _author_mentions(incoming)
    first = (m.groupBy("paper_id", "name").agg(F.min(F.struct("seq", "pos")).alias("_f"))
             .join(authors, "name")
             .select("paper_id", "author_id", F.col("_f.pos").cast("int").alias("author_order")))
    return current.unionByName(first.join(current, ["paper_id", "author_id"], "left_anti"))


def apply_batch(tables: dict[str, DataFrame], incoming: DataFrame, batch_ts,
                author_id_base=None, authors: bool = True) -> dict[str, DataFrame]:
    """All paper-side tables after one ingest batch (U1, U3-U6).  ``authors``: False
    leaves authors and their bridge as they are, for callers that do not read them."""
    out = {
        **tables,
        "papers": upsert_papers(tables["papers"], incoming, batch_ts),
        "categories": upsert_categories(tables["categories"], incoming),
        "paper_categories": upsert_paper_categories(tables["paper_categories"], incoming),
    }
    if authors:
        out["authors"] = upsert_authors(tables["authors"], incoming, author_id_base)
        out["paper_authors"] = upsert_paper_authors(tables["paper_authors"], out["authors"], incoming)
    return out


def first_order_bridge(links: DataFrame, parent: str, child: str, order: str, seq: str | None = None) -> DataFrame:
    """(parent, child, order) keeping the first order per pair: the smallest
    (seq, order) when a seq is given, else the smallest order."""
    if seq is None:
        return links.groupBy(parent, child).agg(F.min(order).alias(order))
    return (links.groupBy(parent, child).agg(F.min(F.struct(seq, order)).alias("_f"))
            .select(parent, child, F.col(f"_f.{order}").alias(order)))


# --- vectors ----------------------------------------------------------------------

def check_vectors(incoming: DataFrame, expected_dim: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of incoming vectors.  A vector is rejected when NULL,
    when any element is NULL/NaN/infinite, or when its length differs from the
    model's dimension: the stored one (``expected_dim``: model, dim), or for a
    new model that of its first sound vector in the batch."""
    v = incoming.withColumn("embedding", F.col("embedding").cast("array<float>"))
    bad_elem = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    reason = (F.when(F.col("embedding").isNull(), F.lit("vector is null"))
              .when(bad_elem, F.lit("vector has a non-finite element")))
    if expected_dim is not None:
        v = v.withColumn("reason", reason)
        fresh = (v.where(F.col("reason").isNull()).groupBy("model")
                 .agg(F.min(F.struct("seq", "paper_id", F.size("embedding").alias("d"))).alias("_x"))
                 .select("model", F.col("_x.d").alias("_new")))
        # one row a model, so the joins are small whatever the batch
        v = (v.join(expected_dim.select("model", F.col("dim").alias("_old")), "model", "left").join(fresh, "model", "left")
             .withColumn("_dim", F.coalesce("_old", "_new")).drop("_old", "_new"))
        reason = F.coalesce("reason", F.when(F.col("_dim").isNotNull() & (F.size("embedding") != F.col("_dim")),
                                             F.lit("vector length differs from the model's dimension")))
    v = v.withColumn("reason", reason)
    cols = [c for c in v.columns if c not in ("reason", "_dim")]
    return v.where(F.col("reason").isNull()).select(*cols), v.where(F.col("reason").isNotNull()).select(*cols, "reason")


def upsert_embeddings(current: DataFrame, incoming: DataFrame, batch_ts,
                      papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Next ``paper_embeddings`` and the quarantined incoming rows.
    incoming: (paper_id, model, embedding, seq).  With ``papers``, vectors of
    unknown papers are quarantined too (the foreign-key rule)."""
    dims = current.groupBy("model").agg(F.max("dim").alias("dim"))
    valid, rejects = check_vectors(incoming, dims)
    if papers is not None:
        lost = orphans(valid, papers).select(*valid.columns).withColumn("reason", F.lit("paper is missing"))
        valid, rejects = with_parent(valid, papers).select(*valid.columns), rejects.unionByName(lost)
    last = latest_per_key(valid, ["paper_id", "model"], ["embedding"])
    written = last.select("paper_id", "model", "embedding", F.size("embedding").cast("int").alias("dim"),
                          F.lit(batch_ts).cast("timestamp_ntz").alias("created_at"))
    kept = current.join(last.select("paper_id", "model"), ["paper_id", "model"], "left_anti")
    return kept.unionByName(written), rejects


# --- integrity ----------------------------------------------------------------------

def orphans(child: DataFrame, papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """Rows of a child table whose paper is missing (FK violations)."""
    return child.join(papers.select(F.col("arxiv_id").alias(key)), key, "left_anti")


def with_parent(child: DataFrame, papers: DataFrame, key: str = "paper_id") -> DataFrame:
    return child.join(papers.select(F.col("arxiv_id").alias(key)), key, "left_semi")


#: Parent table -> its key, and the child tables with their column for it.
CASCADES = {
    "papers": ("arxiv_id", {"paper_authors": "paper_id", "paper_categories": "paper_id", "paper_embeddings": "paper_id"}),
    "authors": ("author_id", {"paper_authors": "author_id"}),
    "categories": ("code", {"paper_categories": "category_code"}),
}


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, parent: str = "papers") -> dict[str, DataFrame]:
    """Delete rows of a parent table and what refers to them: papers with both bridges
    and the vectors, authors or categories with their bridge; other parents stay.
    ``keys``: the parent's key column (``arxiv_id``, ``author_id`` or ``code``)."""
    key, children = CASCADES[parent]
    gone = keys.select(key).distinct()
    out = dict(tables)
    out[parent] = tables[parent].join(gone, key, "left_anti")
    for child, column in children.items():
        out[child] = tables[child].join(gone.withColumnRenamed(key, column), column, "left_anti")
    return out
