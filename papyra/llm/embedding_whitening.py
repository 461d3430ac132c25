"""Whitening of quantised embeddings with a covariance weighted by multiplicity.

Each component c becomes the integer x = floor(1024 c) + 100000.  Identical x
vectors are grouped and counted; a group counts in the fit as often as it occurs
(or once).  Sums are exact integers; the covariance is a weighted matrix product of
vectors centred beforehand, summed over partitions by matrix row; each distinct
vector is projected once and joined back to its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import row_key, written

SCALE, SHIFT = 1024, 100000
LARGEST = float(1 << 52)  # larger components count as this
HOT_KEYS = 1024  # at most so many vectors can each have this share of all rows
SAFE = 1 << 62


def complete(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def quantised(vector: Column) -> Column:
    bounded = lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v * SCALE))
    return F.transform(vector.cast("array<double>"), lambda v: F.floor(bounded(v)).cast("long") + F.lit(SHIFT))


def _times(x: np.ndarray, most: int) -> np.ndarray:
    """``x`` in integers that hold products with ``most``."""
    return x if not x.size or int(np.abs(x).max()) * most < SAFE else x.astype(object)


def _sums(batches):
    """Per partition and position: sum of the weights and exact weighted sum."""
    total, held = 0, None
    for batch in batches:
        w = batch["__w"].to_numpy()
        for rows, x in _matrices(batch["__x"]):
            n = int(w[rows].sum())
            s = (_times(x, n) * w[rows][:, None]).sum(axis=0)
            total, held = total + n, [int(v) + h for v, h in zip(s.tolist(), held or [0] * len(s))]
    if held:
        # two halves, so that no sum leaves 64 bits
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(len(held)), pa.int32()), "n": pa.array([total] * len(held), pa.int64()),
                                          "high": pa.array([v >> 31 for v in held], pa.int64()), "low": pa.array([v & 0x7FFFFFFF for v in held], pa.int64())})


def _matrices(column):
    """(rows, integer matrix) per length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    at = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, flat[at[rows][:, None] + np.arange(n)[None, :]]


@dataclass
class Centre:
    n: int
    sums: list[int]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        s = np.array(self.sums, dtype=object)
        small = int(np.abs(x).max(initial=0)) * self.n < SAFE >> 1 and max(map(abs, self.sums), default=0) < SAFE >> 1
        return x * self.n - s.astype(np.int64) if small else x.astype(object) * self.n - s


def _scatter(centre: Centre):
    """Per partition, a row for each row of the weighted scatter matrix."""
    def run(batches):
        g = None
        for batch in batches:
            w = batch["__w"].to_numpy().astype(np.float64)
            for rows, x in _matrices(batch["__x"]):
                c = centre(x).astype(np.float64) / centre.n
                part = (c * w[rows][:, None]).T @ c
                g = part if g is None else g + part
        if g is not None:
            yield pa.RecordBatch.from_pydict({"pos": pa.array(range(len(g)), pa.int32()), "g": pa.array(g.tolist(), pa.list_(pa.float64()))})
    return run


def _whitened(centre: Centre, axes: np.ndarray, scale: np.ndarray):
    """Deviation and projections of each distinct vector."""
    def run(batches):
        for batch in batches:
            deviation, out = np.full(batch.num_rows, None, object), np.zeros((batch.num_rows, len(axes)))
            for rows, x in _matrices(batch["__x"]):
                z = centre(x)
                out[rows] = (z.astype(np.float64) / centre.n) @ axes.T
                most = max((abs(int(v)) for v in (z.min(initial=0), z.max(initial=0))), default=0)
                z = z if most * most * z.shape[1] < SAFE else z.astype(object)
                deviation[rows] = (z * z).sum(axis=1).tolist()
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(scale > 0, out / np.where(scale > 0, scale, 1), np.nan)
            values = pa.array(out.ravel(), mask=np.isnan(out).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch["__k1"], batch["__k2"], batch["__m"], batch["__w"], pa.array([v if v is not None and v < 1 << 63 else None for v in deviation], pa.int64()),
                 pa.ListArray.from_arrays(np.arange(0, len(values) + 1, max(1, len(axes)), dtype=np.int32), values)],
                ["__k1", "__k2", "__m", "__w", "deviation", "whitened"])
    return run


def _identity_error(white: DataFrame, n: int, used: list[int]) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    if not used:
        return None
    w, x = F.col("__w"), {i: F.col("whitened")[i] for i in used}
    mean = white.agg(*[(F.sum(w * x[i]) / n).alias(f"m{i}") for i in used]).first()
    pairs = [(i, j) for i in used for j in used if i <= j]
    cov = white.agg(*[(F.sum(w * (x[i] - mean[f"m{i}"]) * (x[j] - mean[f"m{j}"])) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def _of_length(distinct: DataFrame, components: int) -> DataFrame | None:
    """Distinct vectors of one length with their projections and the report's numbers."""
    at = sorted(distinct.mapInArrow(_sums, "pos int, n long, high long, low long").groupBy("pos").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect())
    centre = Centre(int(at[0]["n"]), [(int(r["high"]) << 31) + int(r["low"]) for r in at])
    rows = distinct.mapInArrow(_scatter(centre), "pos int, g array<double>").groupBy("pos").agg(
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).orderBy("pos").collect()
    v = np.array([r["g"] for r in rows]) / centre.n
    e, axes = np.linalg.eigh((v + v.T) / 2)
    e, axes = e[::-1][:components], axes.T[::-1][:components]
    trace = float(np.trace(v))
    # what is zero but for rounding is no direction
    real = e > max(trace, 0.0) * len(v) * np.finfo(float).eps
    white = written(distinct.select("__k1", "__k2", "__m", "__w", "__x").mapInArrow(
        _whitened(centre, axes, np.sqrt(np.where(real, e, 0.0))), "__k1 long, __k2 long, __m long, __w long, deviation long, whitened array<double>"), "whitened")
    explained = [float(x / trace) if r else 0.0 for x, r in zip(e, real)]
    error = _identity_error(white, centre.n, np.flatnonzero(real).tolist())
    return white.withColumns({"n": F.lit(centre.n).cast("long"), "explained": F.array(*map(F.lit, explained)),
                              "identity_error": F.lit(error).cast("double")})


def whiten(vectors: DataFrame, components: int = 8, weights: str = "count", id_col: str = "vec_id", vector_col: str = "embedding",
           hot_keys: int = HOT_KEYS) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of every complete vector.

    ``weights``: a distinct vector counts in the fit as often as it occurs
    ("count") or once ("one"); ``n`` is the sum of the weights.  deviation: the sum
    over positions of (n x - S)^2, exact, null where it does not fit into 64 bits;
    whitened: x - S/n projected on the leading unit eigenvectors of the covariance
    (divisor n), over the root of the eigenvalue; explained: eigenvalue
    over trace; identity_error: one number.

    Vectors that ``hot_keys``-th parts of all rows share go back to their rows by
    broadcast (there are at most ``hot_keys`` of them), all others by a shuffle, in
    which no key is frequent.  The driver holds dim^2 numbers.

    Defined cases: vectors that are null or hold null or non-finite components are
    dropped; vectors of different lengths are fitted apart, each length with its own
    n (one set of passes a length); empty vectors give no rows; null and repeated
    ids keep their rows; components beyond 2^42 count as 2^42; directions without
    variance (fewer distinct vectors than components) are null in whitened and 0 in
    explained, and identity_error is null when there is no other; an empty table
    gives no rows; other columns are not read.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights are 'count' or 'one'")
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")).where(complete(F.col("__v")))
    rows = rows.select("__id", quantised(F.col("__v")).alias("__x")).where(F.size("__x") > 0)
    keyed = rows.select("__id", *row_key(F.col("__x")))
    distinct = rows.groupBy("__x").agg(F.count(F.lit(1)).alias("__m"))
    weight = F.col("__m") if weights == "count" else F.lit(1).cast("long")
    distinct = written(distinct.select(*row_key(F.col("__x")), "__m", weight.alias("__w"), "__x"), "distinct")
    found = distinct.groupBy(F.size("__x").alias("d")).agg(F.sum("__m").alias("m")).collect()
    out = None
    for d in sorted(r["d"] for r in found):
        one = _of_length(distinct.where(F.size("__x") == d), components)
        out = one if out is None else out.unionByName(one)
    report = ["n", "deviation", "whitened", "explained", "identity_error"]
    if out is None:
        return rows.select(F.col("__id").alias(id_col), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                           F.array(F.lit(0.0)).alias("whitened"), F.array(F.lit(0.0)).alias("explained"), F.lit(0.0).alias("identity_error"))
    hot = F.col("__m") * hot_keys >= sum(r["m"] for r in found)
    key = ["__k1", "__k2"]
    few = out.where(hot)
    often = keyed.join(F.broadcast(few), key)
    rest = keyed.join(F.broadcast(few.select(*key)), key, "left_anti").join(out.where(~hot), key)
    return often.select("__id", *report).unionByName(rest.select("__id", *report)).withColumnRenamed("__id", id_col)
