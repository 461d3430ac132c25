"""The six tables as plain Parquet, one directory per ingest batch.

A batch writes only its own rows, under ``<root>/<table>/feed=<f>/batch=<n>/``,
and last a one-row marker under ``<root>/_batches``.  Readers join the markers,
so a batch is seen whole or not at all; a crash between any two writes leaves
the earlier batches as they were, and the retry overwrites its own directories.
A batch is known by its feed and number: feeds never shadow each other, and a
replay at any later time is a no-op.  Nothing is rewritten: reading resolves the
latest (or first) row per key by the order of the markers.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.operators import upsert as U
from papyra.schemas import TABLE_SCHEMAS

BATCHES = "feed string, batch long, batch_no long, new_count long, updated_count long, rejected long, max_author_id long"


class BatchStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, feed: str, batch: int) -> str:
        return f"{self.root}/{table}/feed={feed}/batch={int(batch)}"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def batches(self) -> DataFrame:
        """One row per committed batch, with its counts."""
        at = f"{self.root}/_batches"
        if not self._exists(at):
            return self.spark.createDataFrame([], BATCHES)
        return self.spark.read.schema(BATCHES).option("basePath", at).parquet(at)

    def applied(self, feed: str, batch: int) -> bool:
        return not self.batches().where((F.col("feed") == feed) & (F.col("batch") == int(batch))).isEmpty()

    def rows(self, table: str, but: tuple[str, int] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """All committed rows of a table, with their batch_no.  ``but``: a batch that is
        being written; leftovers of an earlier attempt are then not even listed.
        ``schema``: of what is kept beside the tables."""
        schema, at = schema or TABLE_SCHEMAS[table], f"{self.root}/{table}"
        done = self.batches().select("feed", "batch", "batch_no")
        if not self._exists(at):
            return self.spark.createDataFrame([], schema).withColumn("batch_no", F.lit(0).cast("long"))
        full = T.StructType([*schema.fields, T.StructField("feed", T.StringType()), T.StructField("batch", T.LongType())])
        raw = self.spark.read.schema(full).option("basePath", at).parquet(at)
        if but is not None:
            raw = raw.where((F.col("feed") != but[0]) | (F.col("batch") != int(but[1])))
        return raw.join(done, ["feed", "batch"]).select(*schema.fieldNames(), "batch_no")

    def tables(self) -> dict[str, DataFrame]:
        """The current tables; empty where nothing was written yet."""
        papers, links = self.rows("papers"), self.rows("paper_authors")
        cols = [c for c in U.PAPER_COLS if c != "arxiv_id"]
        first = papers.groupBy("arxiv_id").agg(F.min_by("ingested_at", "batch_no").alias("ingested_at"))
        last = U.latest_per_key(papers, ["arxiv_id"], cols, "batch_no").join(first, "arxiv_id")
        vectors = U.latest_per_key(self.rows("paper_embeddings"), ["paper_id", "model"], ["embedding", "dim", "created_at"], "batch_no")
        found = {
            "papers": last,
            "categories": self.rows("categories").select("code").distinct(),
            "paper_categories": self.rows("paper_categories").select("paper_id", "category_code").distinct(),
            "authors": self.rows("authors"),
            "paper_authors": links.groupBy("paper_id", "author_id").agg(F.min_by("author_order", "batch_no").alias("author_order")),
            "paper_embeddings": vectors,
        }
        return {name: found[name].select(*schema.fieldNames()) for name, schema in TABLE_SCHEMAS.items()}

    def write(self, table: str, rows: DataFrame, feed: str, batch: int) -> None:
        """Rows of a batch not yet committed; vectors in a directory per model."""
        out = rows.select(*TABLE_SCHEMAS[table].fieldNames()).write.mode("overwrite")
        (out.partitionBy("model") if table == "paper_embeddings" else out).parquet(self.path(table, feed, batch))

    def written(self, table: str, feed: str, batch: int) -> DataFrame:
        return self.spark.read.schema(TABLE_SCHEMAS[table]).parquet(self.path(table, feed, batch))

    def commit(self, feed: str, batch: int, new_count: int = 0, updated_count: int = 0, rejected: int = 0,
               max_author_id: int = 0) -> dict:
        """Publish the batch's rows; returns its counts."""
        number = (self.batches().agg(F.max("batch_no")).first()[0] or 0) + 1
        row = {"batch_no": number, "new_count": new_count, "updated_count": updated_count, "rejected": rejected,
               "max_author_id": max_author_id}
        kind = T.StructType([T.StructField(c, T.LongType()) for c in row])
        self.spark.createDataFrame([tuple(row.values())], kind).coalesce(1).write.mode("overwrite").parquet(
            self.path("_batches", feed, batch))
        return row
