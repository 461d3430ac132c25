"""Corpus diagnostics: coverage, category counts, anisotropy, exemplars.

Pairwise statistics never enumerate pairs.  With unit vectors u_i, s = sum u_i
and Gram matrix G = sum u_i u_i^T (dim x dim, one aggregation):

  sum over ordered pairs i != j of u_i . u_j      = |s|^2 - sum |u_i|^2
  sum over ordered pairs i != j of (u_i . u_j)^2  = |G|_F^2 - sum |u_i|^4

which give the exact mean and population standard deviation over all
N(N-1)/2 distinct pairs.  Extremes (min/max) need pairs: they come from a
seeded sample of pairs chosen by hash keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.vectors import l2_normalize, second_moments

SAMPLE_PAIRS = 2000
SAMPLE_SEED = 0
BROADCAST_PAIRS = 100_000


def corpus_coverage(papers: DataFrame, paper_embeddings: DataFrame, model: str) -> DataFrame:
    """(papers, embedded) in one aggregation over both tables."""
    p = papers.select(F.lit(1).alias("_p"), F.lit(0).alias("_e"))
    e = paper_embeddings.where(F.col("model") == F.lit(model)).select(F.lit(0).alias("_p"), F.lit(1).alias("_e"))
    return p.unionByName(e).agg(F.coalesce(F.sum("_p"), F.lit(0)).cast("long").alias("papers"),
                                F.coalesce(F.sum("_e"), F.lit(0)).cast("long").alias("embedded"))


def category_counts(papers: DataFrame) -> DataFrame:
    return (papers.groupBy("primary_category").agg(F.count(F.lit(1)).cast("long").alias("n"))
            .orderBy(F.col("n").desc(), F.col("primary_category")))


def pair_moments(vecs: DataFrame) -> DataFrame:
    """(n_pairs, mean, std) of cosine similarity over all distinct pairs,
    exact, from tiles of partial sums (no pairs materialised; what
    reaches the driver is dim + dim^2 / 2 numbers)."""
    spark = vecs.sparkSession
    n, dim, sums, g = second_moments(vecs.select(l2_normalize("embedding").alias("u")), "u")
    if n < 2:
        return spark.createDataFrame([(0, None, None)], "n_pairs long, mean double, std double")
    s, (sq, sq2) = sums[:dim], sums[dim:]
    ordered = n * (n - 1)
    mean = (float(s @ s) - sq) / ordered
    meansq = (float((g * g).sum()) - sq2) / ordered
    std = float(np.sqrt(max(meansq - mean * mean, 0.0)))
    return spark.createDataFrame([(n * (n - 1) // 2, float(mean), std)],
                                 "n_pairs long, mean double, std double")


def _hash_int(*parts) -> F.Column:
    """First 8 hex digits of md5 of the ':'-joined parts, as an integer."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10) \
        .cast("long")


def sample_pairs(vecs: DataFrame, n_pairs: int = SAMPLE_PAIRS, seed: int = SAMPLE_SEED) -> DataFrame:
    """Seeded random pairs of distinct vectors: (k, id_a, id_b, similarity).

    Round r gives every vector the key md5(id:seed:r); the 2m smallest keys
    (m = min(remaining pairs, n // 2)) are paired in key order, so pairs in a
    round are disjoint and rounds are independent.  Selecting the smallest
    keys is a partial top-k (each task keeps 2m rows), and rounds are only
    needed while the corpus is smaller than 2 x n_pairs, so the rows touched
    are about n + 2 x n_pairs whatever the corpus size.  Nothing is addressed
    by a global ordinal."""
    from pyspark.sql import Window

    spark = vecs.sparkSession
    n = vecs.count()
    schema = "k long, id_a string, id_b string, similarity double"
    if n < 2 or n_pairs <= 0:
        return spark.createDataFrame([], schema)
    per_round = n // 2
    rounds = -(-n_pairs // per_round)
    keyed = (vecs.select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
             .withColumn("key", _hash_int(F.col("paper_id"), F.lit(seed), F.col("round"))))
    w = Window.partitionBy("round").orderBy("key", "paper_id")
    take = 2 * min(per_round, n_pairs)
    # filter on the raw row_number so the plan keeps a per-task partial limit
    ranked = (keyed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= take)
              .withColumn("pos", F.col("rn") - 1))
    ranked = ranked.withColumn("k", F.col("round") * per_round + F.floor(F.col("pos") / 2)).where(
        F.col("k") < n_pairs).select("paper_id", "k", "pos")
    if n_pairs <= BROADCAST_PAIRS:  # 2 x n_pairs ids at most, so the vectors stay where they are
        ranked = F.broadcast(ranked)
    ranked = vecs.select("paper_id", l2_normalize("embedding").alias("u")).join(ranked, "paper_id")
    a = ranked.where(F.col("pos") % 2 == 0).select("k", F.col("paper_id").alias("id_a"), F.col("u").alias("ua"))
    b = ranked.where(F.col("pos") % 2 == 1).select("k", F.col("paper_id").alias("id_b"), F.col("u").alias("ub"))
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, "k").select(F.col("k").cast("long"), "id_a", "id_b", dot.alias("similarity"))


def sampled_pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).cast("long").alias("n_pairs"), F.avg("similarity").alias("mean"),
                     F.stddev_pop("similarity").alias("std"), F.min("similarity").alias("min"),
                     F.max("similarity").alias("max"))


def category_exemplars(papers: DataFrame, vecs: DataFrame, prefix: str, equals: str) -> DataFrame:
    """Cosine of the first (smallest id) embedded paper whose primary
    category starts with ``prefix`` and the first whose category equals
    ``equals``; no row when either is missing."""
    embedded = vecs.select(F.col("paper_id").alias("arxiv_id"))
    cand = papers.select("arxiv_id", "title", "primary_category").join(embedded, "arxiv_id", "left_semi")
    packed = F.struct("arxiv_id", "title")
    firsts = cand.agg(
        F.min(F.when(F.col("primary_category").startswith(prefix), packed)).alias("a"),
        F.min(F.when(F.col("primary_category") == F.lit(equals), packed)).alias("b"))
    # one row by its global aggregate: its two ids go to the vectors, no vector is shuffled to them
    ids = firsts.where("a is not null and b is not null").select(F.explode(F.map_from_arrays(
        F.array(F.lit("a"), F.lit("b")), F.array("a", "b"))).alias("end", "paper"))
    found = vecs.join(F.broadcast(ids), F.col("paper_id") == F.col("paper.arxiv_id")).groupBy("end", "paper").agg(
        F.min(F.struct(l2_normalize("embedding").alias("u"))).alias("x"))
    ends = found.agg(*[F.first(F.when(F.col("end") == e, F.struct("paper", "x.u")), ignorenulls=True).alias(e) for e in "ab"])
    dot = F.aggregate(F.zip_with("a.u", "b.u", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return (ends.where(F.col("a").isNotNull() & F.col("b").isNotNull())
            .select(F.col("a.paper.arxiv_id").alias("id_a"), F.col("a.paper.title").alias("title_a"),
                    F.col("b.paper.arxiv_id").alias("id_b"), F.col("b.paper.title").alias("title_b"),
                    dot.alias("similarity")))
