"""The corpus pipeline: toxicity filter, line dedup, near-duplicate join, mixing, encoding.

Each stage takes all documents that the one before kept, written as Parquet in
the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import line_dedup, mixing, ngram_join, piece_dropout, toxicity
from papyra.llm._common import scratch_path, table
from papyra.session import ship_package

#: ``copy`` tells the rows apart that the mix makes of one document; it is 1 before.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "copy"]

#: The score from which op8 predicts a document as toxic.
TOXIC = 0.3


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from ``labels``, scores at 0.3 or more (the cut of op8) go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.keep_clean(docs.withColumn("copy", F.lit(1)).select(*COLUMNS), model, cut=TOXIC)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 or more documents go; ``n_chars`` follows the text."""
    return line_dedup.drop_common_lines(docs.select(*COLUMNS)).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    ship_package(spark)
    return ngram_join.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows, numbered in ``copy``."""
    return mixing.mix(docs.select(*COLUMNS), copy_col="copy")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The merge-dropout ids of every row, drawn anew for each copy."""
    ship_package(spark)
    ids = piece_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1, seed=1, copy_col="copy")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", filter_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_duplicates),
          ("mixing", mix_sources), ("SentencePiece encoding", encode_pieces)]

#: A learned filter, an iterative solver and a tokenizer: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
