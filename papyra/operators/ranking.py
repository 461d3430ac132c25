"""Ranking operators: top-k, exact full ranks, reciprocal rank fusion.

Every order is total: score descending (NULL/NaN last), then id ascending.

``exact_rank`` gives each row its 0-based position inside its group without
ever sorting a whole group in one task.  A window ``row_number() OVER
(PARTITION BY question ORDER BY score)`` would put every corpus row of one
question into a single task; here rows are cut into buckets whose order is
consistent with the total order, bucket sizes are counted (a small aggregate),
their running offsets are summed, and rows are numbered inside buckets only:

  coarse bucket  cb  = monotone function of the score (e.g. 2^20 score bins)
  tie groups         = (cb, exact score, outer id range), then inner id range --
                       a hot exact tie is split by id range, twice
  rank = offset(cb) + offset(score, outer range within cb) + offset(inner range
         within that) + row number in the finest group

Each offset table has one row per group and is windowed within the next
coarser group only, so no task ever holds more than one group's rows.  The id
ranges are cut where a sample of the ids says they are of equal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE_BINS = 1 << 19      # bins per unit of a bounded similarity score
SPLITS = 16                # id ranges per tie-splitting level
RRF_K = 60                 # fixed: reciprocal-rank-fusion constant


def similarity_bucket(score: Column) -> Column:
    """Coarse bucket for a score in [-1, 1]; better scores get smaller
    buckets, NULL goes last."""
    b = F.floor((F.lit(1.0) - score) * F.lit(COARSE_BINS)).cast("long")
    return F.when(score.isNull(), F.lit(4 * COARSE_BINS)).otherwise(
        F.greatest(F.lit(0).cast("long"), F.least(b, F.lit(3 * COARSE_BINS).cast("long"))))


def integer_bucket(score: Column) -> Column:
    """Coarse bucket for an integer score (each value its own bucket)."""
    return F.coalesce(-score.cast("long"), F.lit(1 << 62).cast("long"))


def split_levels(df: DataFrame, id_col: str, splits: int = SPLITS) -> list[list[str]]:
    """Cut points that part the ids into ``splits`` x ``splits`` ranges of about
    equal numbers: one list per outer range, its first entry being the outer
    cut.  They come from a fixed number of ids drawn by hash, so a few odd ids
    cannot leave the rest in one range; uneven cuts cost time, never order."""
    drawn = df.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(4 * splits * splits).collect()
    ids = sorted(r[0] for r in drawn if r[0] is not None)
    cut = [ids[i * len(ids) // (splits * splits)] if ids else "" for i in range(splits * splits)]
    return [cut[i:i + splits] for i in range(0, len(cut), splits)]


def _range_of(id_col: str, levels: list[list[str]]) -> tuple[Column, Column]:
    """Outer and inner range number of an id; both follow the order of the ids."""
    ident = F.col(id_col)

    def passed(cuts: list[Column]) -> Column:
        return sum(((c <= ident).cast("int") for c in cuts), F.lit(0))

    outer = passed([F.lit(part[0]) for part in levels[1:]])
    return outer, passed([F.get(F.lit([part[k] for part in levels]), outer) for k in range(1, len(levels[0]))])


def exact_rank(df: DataFrame, group_cols, score_col: str, id_col: str,
               bucket_fn=similarity_bucket, rank_col: str = "rank",
               levels: list[list[str]] | None = None) -> DataFrame:
    """Add a 0-based rank by (score desc nulls last, id asc) within groups.

    Offsets come from three small count tables, each windowed over a bounded
    partition: coarse buckets per group, (exact score, outer id range) inside a
    coarse bucket, and inner id range inside one of those; rows are numbered
    only inside their finest group.  ``levels``: the cut points, when the caller
    can draw them from a cheaper frame holding the same ids (see
    ``split_levels``)."""
    group_cols = list(group_cols)
    i1, i2 = _range_of(id_col, levels if levels is not None else split_levels(df, id_col))
    score = F.col(score_col)
    d = (df.withColumn("_sk", F.coalesce(score.cast("double"), F.lit(float("-inf"))))
         .withColumn("_cb", bucket_fn(score))
         .withColumn("_i1", F.coalesce(i1, F.lit(0))).withColumn("_i2", F.coalesce(i2, F.lit(0))))
    k1 = [*group_cols, "_cb"]
    k2 = [*k1, "_sk", "_i1"]
    k3 = [*k2, "_i2"]
    before = Window.unboundedPreceding
    g3 = d.groupBy(*k3).agg(F.count(F.lit(1)).alias("_n3"))
    g3 = g3.withColumn("_o3", F.coalesce(F.sum("_n3").over(
        Window.partitionBy(*k2).orderBy("_i2").rowsBetween(before, -1)), F.lit(0)))
    g2 = g3.groupBy(*k2).agg(F.sum("_n3").alias("_n2"))
    g2 = g2.withColumn("_o2", F.coalesce(F.sum("_n2").over(
        Window.partitionBy(*k1).orderBy(F.col("_sk").desc(), F.col("_i1").asc()).rowsBetween(before, -1)),
        F.lit(0)))
    g1 = g2.groupBy(*k1).agg(F.sum("_n2").alias("_n1"))
    g1 = g1.withColumn("_o1", F.coalesce(F.sum("_n1").over(
        Window.partitionBy(*group_cols).orderBy("_cb").rowsBetween(before, -1)), F.lit(0)))
    off = (g3.join(g2.select(*k2, "_o2"), k2).join(g1.select(*k1, "_o1"), k1)
           .select(*k3, (F.col("_o1") + F.col("_o2") + F.col("_o3")).alias("_off")))
    w = Window.partitionBy(*k3).orderBy(F.col(id_col).asc())
    return (d.join(off, k3)
            .withColumn(rank_col, (F.col("_off") + F.row_number().over(w) - 1).cast("long"))
            .drop("_sk", "_cb", "_i1", "_i2", "_off"))


def top_k(df: DataFrame, k: int, group_cols, score_col: str, id_col: str,
          rank_col: str = "rank") -> DataFrame:
    """1-based top-k per group.  Planned as WindowGroupLimit, so each map task
    keeps only its own top-k per group before the shuffle."""
    if k < 0:
        raise ValueError("top_k must be >= 0")
    w = Window.partitionBy(*group_cols).orderBy(F.col(score_col).desc_nulls_last(), F.col(id_col).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k) \
             .withColumn(rank_col, F.col(rank_col).cast("long"))


def rrf(rank_a: Column, rank_b: Column, k: int = RRF_K, missing: Column | None = None) -> Column:
    """Reciprocal rank fusion of two 0-based ranks; a missing rank counts as
    ``missing`` (the corpus size)."""
    if missing is not None:
        rank_a = F.coalesce(rank_a, missing)
        rank_b = F.coalesce(rank_b, missing)
    return F.lit(1.0) / (F.lit(k) + rank_a) + F.lit(1.0) / (F.lit(k) + rank_b)
