"""Embedding near-dedup by randomised-rotation binary codes."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import partitions, written
from papyra.llm.components import components, smallest_ids
from papyra.llm.vectors import by_length, unit, usable


class Plan(NamedTuple):
    bits: int  # of a bucket key
    tables: int
    length: int  # of a code
    seed: int


def plan(n: int, threshold: float, seed: int, miss: float = 1e-4) -> Plan:
    """Key bits grow with the logarithm of the largest label, so buckets of
    unrelated vectors stay small; tables are as many as a pair just at the
    threshold needs to share one with probability 1 - ``miss``."""
    bits = min(24, max(6, math.ceil(math.log2(max(2, n) / 16))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(miss) / math.log(1 - same))
    return Plan(bits, tables, max(512, -(-bits * tables // 64) * 64), seed)


_rotations: dict[tuple[int, int, int], np.ndarray] = {}


def rotation(p: Plan, dim: int) -> np.ndarray:
    """dim x length with orthonormal rows: a random rotation of padded vectors."""
    length = max(p.length, dim)
    key = (length, dim, p.seed)
    if key not in _rotations:
        g = np.random.default_rng([p.seed, dim]).normal(size=(length, dim))
        _rotations[key] = np.linalg.qr(g)[0].T.astype(np.float32)
    return _rotations[key]


class Coded(NamedTuple):
    exact: np.ndarray  # unit vectors, double
    turned: np.ndarray  # rotated
    sign: np.ndarray  # code / sqrt(length), +-
    factor: np.ndarray  # inner product of code and vector
    keys: np.ndarray  # bucket key in each table


def code(p: Plan, x: np.ndarray) -> Coded:
    exact = unit(x)
    turned = exact.astype(np.float32) @ rotation(p, x.shape[1])
    length = turned.shape[1]
    up = turned > 0
    sign = np.where(up, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(length))
    weights = 1 << np.arange(p.bits, dtype=np.int64)
    keys = (up[:, :p.bits * p.tables].reshape(len(x), p.tables, p.bits) * weights).sum(axis=2)
    return Coded(exact, turned, sign, (turned * sign).sum(axis=1), keys)


def linked(a: Coded, b: Coded, t: int, threshold: float, sure: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with an exact cosine of ``threshold`` or more that share no
    earlier table than ``t``.

    The estimate code(a) . b / factor(a) of the inner product is unbiased over
    rotations; its error stays under ``sure`` standard deviations' bound.  Pairs
    whose bound reaches the threshold are computed from the original vectors.
    """
    length = a.turned.shape[1]
    estimate = (a.sign @ b.turned.T) / a.factor[:, None]
    bound = sure * np.sqrt(np.maximum(0, 1 - a.factor**2)) / a.factor / math.sqrt(length - 1)
    near = estimate >= (threshold - bound)[:, None]
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    for at in range(0, t, 8):  # counted in the first table that a pair shares
        if len(i):
            fresh = ~(a.keys[i, at:min(t, at + 8)] == b.keys[j, at:min(t, at + 8)]).any(axis=1)
            i, j = i[fresh], j[fresh]
    cos = np.einsum("ij,ij->i", a.exact[i], b.exact[j])
    return i[cos >= threshold], j[cos >= threshold]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(vectors: DataFrame, threshold: float = 0.93, seed: int = 11, block: int = 2048, sure: float = 4.0,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors of one label and length link at a cosine of ``threshold`` or more.

    1. Equal vectors of a label collapse into one with a multiplicity.
    2. The signs of a random rotation are the code; runs of its bits are bucket
       keys.  Each vector goes to one bucket per table; candidates share a bucket.
    3. In a bucket, code estimates with their confidence bound choose the pairs
       that are computed exactly, in double precision, from the given vectors.
       A pair counts in the first table that it shares.
    4. A bucket returns each vector's number of links and one link to the
       smallest vector of its part there, not its pairs.
    Buckets of more than ``block`` vectors are cut into blocks by hash, and each
    pair of blocks is a task of its own, so all their pairs are still judged.

    Defined cases: null labels, null or zero vectors and vectors with null or
    non-finite components link with nothing, and so do rows with a null id (kept);
    rows that repeat an id count as vectors of their own; other columns are not
    read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("__v"), F.col(label_col).alias("__l"))
    good = usable(F.col("__v")) & F.col("__l").isNotNull() & F.col("__id").isNotNull()
    key = [F.xxhash64("__l", "__v").alias("__k1"), F.xxhash64(F.lit("v"), "__l", "__v").alias("__k2")]
    classes = written(x.where(good).select("*", *key).groupBy("__k1", "__k2").agg(
        F.min("__id").alias("__low"), F.count("*").alias("__m"), F.first("__v").alias("__v"), F.first("__l").alias("__l"))
        .withColumn("__rep", F.monotonically_increasing_id()), "vectors")  # unique, and fixed by the write
    # one number a label, of which the largest comes here
    most = classes.groupBy("__l").count().agg(F.max("count")).first()[0] or 0
    p = plan(most, threshold, seed)

    def place(batches):
        for b in batches:
            for rows, m in by_length(b["__v"]):
                for at in range(0, len(rows), 4096):
                    some = rows[at:at + 4096]
                    keys = code(p, m[at:at + 4096]).keys
                    yield pa.RecordBatch.from_arrays([b["__rep"].take(pa.array(some)), pa.array(list(keys), pa.list_(pa.int64()))], ["__rep", "__keys"])

    keys = written(classes.select("__rep", "__v").mapInArrow(place, "__rep long, __keys array<long>"), "keys")
    spread = (classes.select("__rep", "__m", "__l", F.size("__v").alias("__d")).join(keys, "__rep")
              .select("__rep", "__m", "__l", "__d", F.posexplode("__keys").alias("__t", "__b")))
    spread = spread.withColumn("__bucket", F.xxhash64("__l", "__d", "__t", "__b"))
    sizes = spread.groupBy("__bucket").count().where("count > 1").withColumn("__n", F.ceil(F.col("count") / F.lit(block)))
    spread = spread.join(sizes.select("__bucket", "__n"), "__bucket").withColumn("__i", F.pmod(F.xxhash64("__rep"), F.col("__n")))
    spread = spread.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    n = partitions(spark)
    spread = spread.select("__rep", "__m", "__t", F.xxhash64("__bucket", F.least("__i", "__j"), F.greatest("__i", "__j")).alias("__g"),
                           (F.col("__i") > F.col("__j")).alias("__second"), (F.col("__i") != F.col("__j")).alias("__two"))
    spread = spread.withColumn("__p", F.pmod("__g", F.lit(4 * n))).join(classes.select("__rep", "__v"), "__rep")

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("__g", "ascending"), ("__rep", "ascending")]).combine_chunks()
        group, rep, mult = t["__g"].to_numpy(), t["__rep"].to_numpy(), t["__m"].to_numpy()
        table_, two, second = t["__t"].to_numpy(), t["__two"].to_numpy(zero_copy_only=False), t["__second"].to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1)) if len(group) else np.zeros(1, int)
        out = ([], [], [])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            (_, m), = by_length(t["__v"].slice(a, b - a))
            c = code(p, m)
            size = b - a
            if two[a]:
                left, right = np.flatnonzero(~second[a:b]), np.flatnonzero(second[a:b])
                if not len(left) or not len(right):
                    continue
                i, j = linked(Coded(*(y[left] for y in c)), Coded(*(y[right] for y in c)), int(table_[a]), threshold, sure, False)
                i, j = left[i], right[j]
            else:
                i, j = linked(c, c, int(table_[a]), threshold, sure, True)
            if not len(i):
                continue
            w = mult[a:b].astype(np.float64)
            links = np.bincount(i, weights=w[j], minlength=size) + np.bincount(j, weights=w[i], minlength=size)
            hit = np.flatnonzero(links)
            out[0].append(rep[a:b][hit])
            out[1].append(links[hit].astype(np.int64))
            out[2].append(rep[a:b][roots(size, i, j)[hit]])
        cols = [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]
        return pa.table({"a": cols[0], "n": cols[1], "b": cols[2]})

    found = written(spread.groupBy("__p").applyInArrow(judge, "a long, n long, b long"), "links")
    parts = components(found.where("a <> b").select("a", "b").distinct())
    links = found.groupBy(F.col("a").alias("__rep")).agg(F.sum("n").alias("__links"))
    known = classes.select("__k1", "__k2", "__rep", "__m").join(links, "__rep", "left").join(
        smallest_ids(parts, classes), "__rep").select(
        "__k1", "__k2", (F.coalesce("__links", F.lit(0)) + F.col("__m") - 1).alias("__links"), F.col("__low").alias("__comp"))
    none = F.lit(None).cast("long")
    rows = x.select("__id", *[F.when(good, k).otherwise(none).alias(c) for k, c in zip(key, ("__k1", "__k2"), strict=True)])
    out = rows.join(known, ["__k1", "__k2"], "left")
    comp = F.coalesce("__comp", "__id")
    return out.select(F.col("__id").alias(id_col), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"), F.col("__id").eqNullSafe(comp).alias("kept"))
