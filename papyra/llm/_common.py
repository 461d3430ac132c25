"""Helpers the operators share: row keys, shared scratch tables, word pattern."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.arrow_tokens import give_back
from papyra.session import ship_package

#: White space of the word and line rules, and what a word is (fixed values).
WHITE = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the row, never null, as __k1 and __k2."""
    return [F.xxhash64(*cols).alias("__k1"), F.xxhash64(F.lit("k2"), *cols).alias("__k2")]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="papyra-llm-", dir=os.environ.get("TMPDIR", "/tmp"))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/papyra-llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; operators run Python code on executors, so the package goes along."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A ``mapInArrow`` kernel that gives its memory back when its task ends."""
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            give_back()
    return run
