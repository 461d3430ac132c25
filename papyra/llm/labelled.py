"""A bounded, documented sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import written


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __text, __label, __part) of at most ``most`` labelled ids, taken by
    hash of the id; __part is a second hash from 0 to 5.

    The sampled ids are broadcast: ``most`` bounds them, whatever the labels'
    number.  An id with several labels counts with its largest; rows without id
    or label are left out.
    """
    ids = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
           .where("__id is not null and __label is not null").groupBy("__id").agg(F.max("__label").alias("__label"))
           .orderBy(F.xxhash64("__id"), "__id").limit(most))
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    found = texts.join(F.broadcast(ids), "__id")
    return written(found.withColumn("__part", F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(6)).cast("int")), "sample")
