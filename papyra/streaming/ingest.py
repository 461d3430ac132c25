"""Incremental ingest: landed Atom files -> validated papers -> tables.

A file stream (Spark's XML source) delivers at most ``files_per_trigger`` new
files per micro-batch; each is normalised, validated (bad entries go to the
rejects of the batch) and appended to the store as one batch.  The stream's
checkpoint records which files were consumed, the store which batches of which
stream were applied, so a restart neither loses nor repeats a batch, and several
streams may feed one store.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.text import document_text
from papyra.operators import embed as E
from papyra.operators.keyword_index import KeywordIndex
from papyra.operators import lookup
from papyra.operators import normalize as N
from papyra.operators import upsert as U
from papyra.sources.atom import read_atom, stream_atom
from papyra.sources.store import BatchStore


#: Vectors that an encoder got wrong, kept beside the tables.
VECTOR_REJECTS = T.StructType([T.StructField(c, T.StringType()) for c in ("paper_id", "model", "reason")])


def _utc_now() -> str:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds")


def apply_entries(store: BatchStore, entries: DataFrame, feed: str, batch: int, batch_ts: str,
                  embed_model: str | None = None, encoder_factory=E.HashingEncoder, keyword_index: str | None = None) -> dict | None:
    """Normalise, validate and append one batch of raw entries; its counts
    (new_count, updated_count, rejected), or None if it was applied before.

    ``embed_model``: papers of the batch without a vector of the model are encoded, and
    those whose vector was rejected in an earlier batch once more; rejected vectors
    are kept under ``_vector_rejects`` and count as rejected.  ``keyword_index``: root
    of an index that gets the batch's papers as a segment numbered as the batch
    (open it with ``last``, the last committed batch_no)."""
    if store.applied(feed, batch):
        return None
    spark = entries.sparkSession
    # arrival order inside the batch, fixed once: every table below reads the same rows
    papers = N.normalize_entries(entries, keep=(F.monotonically_increasing_id().alias("seq"),))
    staged = store.path("_staged", feed, batch)
    papers.write.mode("overwrite").parquet(staged)
    valid, rejects = N.validate_papers(spark.read.schema(papers.schema).parquet(staged), extra_required=("seq",))
    rejects.write.mode("overwrite").parquet(store.path("_rejects", feed, batch))
    ts = F.lit(batch_ts).cast("timestamp_ntz")
    none = U.empty_tables(spark)
    counts = U.upsert_counts(store.rows("papers", (feed, batch)).select("arxiv_id").distinct(), valid).first()

    store.write("papers", U.upsert_papers(none["papers"], valid, ts), feed, batch)
    store.write("categories", U.upsert_categories(none["categories"], valid), feed, batch)
    store.write("paper_categories", U.upsert_paper_categories(none["paper_categories"], valid), feed, batch)
    # the batch's names: those known keep their ids, new ones are numbered on
    names = valid.select(F.explode("authors").alias("name")).distinct()
    known = store.rows("authors", (feed, batch)).select("author_id", "name").join(names, "name", "left_semi").select("author_id", "name")
    base = store.batches().agg(F.max("max_author_id")).first()[0] or 0
    store.write("authors", U.upsert_authors(known, valid, base).join(known, "name", "left_anti"), feed, batch)
    fresh = store.written("authors", feed, batch)
    store.write("paper_authors", U.upsert_paper_authors(none["paper_authors"], known.unionByName(fresh), valid), feed, batch)
    rejected = rejects.count()
    if embed_model is not None:
        rejected += _embed(store, feed, batch, ts, embed_model, encoder_factory)
    if keyword_index is not None:
        number = (store.batches().agg(F.max("batch_no")).first()[0] or 0) + 1
        KeywordIndex.add(keyword_index, store.written("papers", feed, batch), number)
    top = fresh.agg(F.max("author_id")).first()[0]
    return store.commit(feed, batch, counts["new_count"], counts["updated_count"], rejected, max(base, top or 0))


def _embed(store: BatchStore, feed: str, batch: int, ts, model: str, encoder_factory) -> int:
    """Write the batch's vectors and rejects; the number of rejects."""
    texts = ["arxiv_id", "title", "abstract"]
    now = store.written("papers", feed, batch).select(*texts)
    failed = store.rows("_vector_rejects", (feed, batch), VECTOR_REJECTS).where(F.col("model") == model)
    failed = failed.select(F.col("paper_id").alias("arxiv_id")).distinct().join(now, "arxiv_id", "left_anti")
    again = store.rows("papers", (feed, batch)).join(failed, "arxiv_id", "left_semi")
    papers = now.unionByName(U.latest_per_key(again, ["arxiv_id"], texts[1:], "batch_no"))
    todo = lookup.papers_missing_embedding(papers, store.rows("paper_embeddings", (feed, batch)), model)
    vecs = E.encode(todo.select("arxiv_id", document_text("title", "abstract").alias("text")), "text", "arxiv_id", encoder_factory)
    rows = vecs.select(F.col("arxiv_id").alias("paper_id"), F.lit(model).alias("model"), "embedding", F.lit(0).cast("long").alias("seq"))
    staged = store.path("_staged_vectors", feed, batch)  # encoded once
    rows.write.mode("overwrite").parquet(staged)
    rows = store.spark.read.schema(rows.schema).parquet(staged)
    known = store.rows("paper_embeddings", (feed, batch)).where(F.col("model") == model)  # for the model's dimension
    dims = known.select("paper_id", "model", "embedding", "dim", "created_at").limit(1)
    made, bad = U.upsert_embeddings(dims, rows, ts, papers=papers)
    store.write("paper_embeddings", made.join(rows.select("paper_id"), "paper_id", "left_semi"), feed, batch)
    at = store.path("_vector_rejects", feed, batch)
    bad.select(*VECTOR_REJECTS.fieldNames()).write.mode("overwrite").parquet(at)
    return store.spark.read.schema(VECTOR_REJECTS).parquet(at).count()


def first_entries(entries: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of a file read, in the order of file name and place.

    Rows are counted per split (a piece of a file that one task reads), and the
    counts, one small row a split, are added up in order.  All rows before the
    split in which the total falls stay as they are; only the rows of that split
    are sorted and cut.  No rows, or none asked for, give none; nulls in the rows
    do not matter.
    """
    spot = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    splits = entries.select(spot.alias("_spot")).groupBy("_spot").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1))
    last = (splits.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most)
            .orderBy(F.desc("_spot")).first())
    if last is None:
        return entries.limit(0)
    file, start = last["_spot"]
    path = F.col("_metadata.file_path")
    ahead = entries.where((path < file) | ((path == file) & (F.col("_metadata.file_block_start") < start)))
    cut = entries.where((path == file) & (F.col("_metadata.file_block_start") == start))
    if last["_before"] + last["_rows"] > most:
        cut = (cut.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at")
               .limit(most - last["_before"]).drop("_at"))
    return ahead.unionByName(cut)


def ingest_files(spark: SparkSession, landing_dir: str, store_root: str, feed: str, batch: int,
                 max_total: int | None = None, clock=_utc_now, **how) -> dict | None:
    """One bulk ingest of the files landed so far, of at most ``max_total``
    entries in the order of file and place."""
    entries = read_atom(spark, landing_dir)
    if max_total is not None:
        entries = first_entries(entries, max_total)
    return apply_entries(BatchStore(spark, store_root), entries, feed, batch, clock(), **how)


def stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The id that Spark gave this checkpoint's stream, for good."""
    return json.loads(spark.read.text(f"{checkpoint_location}/metadata").first()[0])["id"]


def ingest_stream(spark: SparkSession, landing_dir: str, store_root: str, checkpoint_location: str,
                  files_per_trigger: int = 100, embed_model: str | None = None, encoder_factory=E.HashingEncoder,
                  clock=_utc_now):
    """Run the ingest stream over everything landed so far, then stop
    (availableNow).  Returns the finished StreamingQuery."""
    store = BatchStore(spark, store_root)

    def each(batch_df: DataFrame, batch_id: int) -> None:
        if not batch_df.isEmpty():
            apply_entries(store, batch_df, stream_id(spark, checkpoint_location), batch_id, clock(), embed_model, encoder_factory)

    q = (stream_atom(spark, landing_dir, files_per_trigger).writeStream
         .foreachBatch(each)
         .option("checkpointLocation", checkpoint_location)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return q
