"""Balanced cells of vectors, and exact search and extremes that skip whole cells.

Vectors are dealt into cells by a tree of halving planes (cut at the medians of a
bounded sample); a leaf that holds more than a cell is dealt out by hash, so every
cell has about ``CELL_ROWS`` rows.  A cell keeps the mean direction of its vectors,
the largest angle to it, and their number.  Two directions in cells whose means
are phi apart lie between phi - a - b and phi + a + b apart (a, b: the cells' largest
angles; 0 for a single direction).  A cell or a pair of cells whose bound cannot
change the result is not read; everything else is computed, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators import vectors as V
from papyra.session import checkpoint_dir, ship_package

CELL_ROWS = 4096
MOST_LEAVES = 1024     # of the tree; larger leaves are dealt out by hash
SAMPLE = 1 << 14       # vectors that the tree's cuts are drawn from
GROUP_CELLS = 1024     # cells (or questions) that one task compares bounds of
SLACK = 1e-9           # of bounds, for rounding

Kernel = Callable[[np.ndarray], np.ndarray]  # vectors -> directions (rows of length 1, or 0)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def residual(basis: V.Basis, k: int) -> Kernel:
    """Directions left after centring and removing the first ``k`` directions."""
    def run(x):
        c = x - basis.mean
        return unit(c - (c @ basis.directions[:k].T) @ basis.directions[:k])
    return run


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def halving_tree(u: np.ndarray, leaves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the planes (nodes x dim) and cuts of a balanced tree over ``u``."""
    levels, parts = [], [np.arange(len(u))]
    while len(parts) < leaves:
        planes, cuts, nxt = [], [], []
        for part in parts:
            x = u[part]
            if len(x) < 2:
                plane, cut, side = np.zeros(u.shape[1]), 0.0, np.zeros(len(x), bool)
            else:
                a = x[np.argmin(x @ x[0])]
                plane = a - x[np.argmin(x @ a)]
                along = x @ plane
                cut = float(np.median(along))
                side = along > cut
            planes.append(plane)
            cuts.append(cut)
            nxt += [part[~side], part[side]]
        levels.append((np.array(planes), np.array(cuts)))
        parts = nxt
    return levels


def leaf_of(levels: list, u: np.ndarray) -> np.ndarray:
    node = np.zeros(len(u), np.int64)
    for planes, cuts in levels:
        node = 2 * node + (np.einsum("ij,ij->i", u, planes[node]) > cuts[node])
    return node


class Cells:
    """``rows`` (cell, paper_id, embedding) and ``summary`` (cell, n, angle, centre, norm)."""

    def __init__(self, vecs: DataFrame, directions: Kernel, cell_rows: int = CELL_ROWS):
        spark = vecs.sparkSession
        ship_package(spark)
        checkpoint_dir(spark)
        self.directions = directions
        n = vecs.count()
        leaves = min(MOST_LEAVES, 1 << max(0, (max(1, -(-n // cell_rows)) - 1).bit_length()))
        drawn = vecs.orderBy(F.xxhash64("paper_id"), "paper_id").limit(SAMPLE if leaves > 1 else 1).select("embedding").collect()
        levels = halving_tree(directions(np.array([r[0] for r in drawn], np.float64)), leaves) if drawn else []

        def place(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(leaf_of(levels, directions(_matrix(b["embedding"])))), b["paper_id"], b["embedding"]],
                                                     ["_leaf", "paper_id", "embedding"])

        placed = vecs.select("paper_id", "embedding").mapInArrow(place, "_leaf long, paper_id string, embedding array<float>")
        size = placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n"))  # at most MOST_LEAVES rows
        cell = F.col("_leaf") * (1 << 32) + F.pmod(F.xxhash64("paper_id"), F.ceil(F.col("_n") / F.lit(cell_rows)))
        self.rows = placed.join(size, "_leaf").select(cell.alias("cell"), "paper_id", "embedding").checkpoint()

        def describe(part: pa.Table) -> pa.Table:
            u = directions(_matrix(part["embedding"]))
            centre = unit(u.sum(axis=0, keepdims=True))[0]
            some = u.any(axis=1) & bool(centre.any())  # what has no direction may lie anywhere
            angle = float(np.arccos(np.clip(u @ centre, -1, 1)).max()) if some.all() else np.pi
            return pa.table({"cell": part["cell"].slice(0, 1), "n": pa.array([len(u)]), "angle": pa.array([angle]),
                             "centre": pa.array([centre.tolist()], pa.list_(pa.float64()))})

        self.summary = self.rows.groupBy("cell").applyInArrow(describe, "cell long, n long, angle double, centre array<double>").checkpoint()


def _grid(left: DataFrame, right: DataFrame, key_left: str, key_right: str, run, schema: str) -> DataFrame:
    """``run`` on every pair of a group of left rows and a group of right rows."""
    a, b = (max(1, -(-x.count() // GROUP_CELLS)) for x in (left, right))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = left.withColumn("_i", spot(key_left, a)).withColumn("_j", each(b))
    y = right.withColumn("_k", each(a)).withColumn("_l", spot(key_right, b))
    return x.groupBy("_i", "_j").cogroup(y.groupBy("_k", "_l")).applyInArrow(run, schema)


def _limits(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest cosine of directions of each left cell with each right one."""
    phi = np.arccos(np.clip(_matrix(left["centre"]) @ _matrix(right["centre"]).T, -1, 1))
    spread = left["angle"].to_numpy()[:, None] + right["angle"].to_numpy()[None, :]
    return np.cos(np.minimum(np.pi, phi + spread)) - SLACK, np.cos(np.maximum(0, phi - spread)) + SLACK


# --- exact top-k ---------------------------------------------------------------------

def _as_points(questions: DataFrame, basis: V.Basis, k: int) -> DataFrame:
    """(question_id, qvec, centre, angle 0): unit residuals of the questions."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                u = unit(V.query_residuals(_matrix(b["qvec"]), basis, k))
                yield pa.RecordBatch.from_arrays([b["question_id"], b["qvec"], pa.array(u.tolist(), pa.list_(pa.float64())), pa.array(np.zeros(len(u)))],
                                                 ["question_id", "qvec", "centre", "angle"])
    return (questions.where(F.col("qvec").isNotNull()).select("question_id", F.col("qvec").cast("array<double>").alias("qvec"))
            .mapInArrow(run, "question_id long, qvec array<double>, centre array<double>, angle double"))


def search_cells(vecs: DataFrame, questions: DataFrame, basis: V.Basis, top_k: int = 5, n_components: int = V.DEFAULT_COMPONENTS,
                 cell_rows: int = CELL_ROWS, cells: Cells | None = None, watch=None) -> DataFrame:
    """Debiased cosine top-k: (question_id, rank, paper_id, score), equal to ``search_similar``.

    For each question the cells with the nearest means are read first, as many as hold
    ``top_k`` rows; the k-th best score found is what any other cell's bound must
    reach.  ``watch`` is shown the (question_id, cell) that were read."""
    if top_k < 1:
        raise ValueError("top_k must be >= 1")
    k = min(V.capped_components(n_components, basis.n, basis.dim), basis.k)
    cells = cells or Cells(vecs, residual(basis, k), cell_rows)
    points = _as_points(questions, basis, k).checkpoint()

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"question_id": pa.array([], pa.int64()), "cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        near = _matrix(right["centre"]) @ _matrix(left["centre"]).T
        best = np.argsort(-near, axis=1, kind="stable")[:, :top_k]  # every cell has a row, so these hold enough
        q = np.repeat(np.arange(len(near)), best.shape[1])
        return pa.table({"question_id": right["question_id"].take(pa.array(q)), "cell": left["cell"].take(pa.array(best.ravel())),
                         "n": left["n"].take(pa.array(best.ravel())), "near": pa.array(near[q, best.ravel()])})

    close = _grid(cells.summary, points, "cell", "question_id", nearest, "question_id long, cell long, n long, near double")
    w = Window.partitionBy("question_id").orderBy(F.desc("near"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    first = close.withColumn("_held", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("_held") < top_k).select("question_id", "cell").checkpoint()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("paper_id")
        ids = np.asarray(left["paper_id"].to_pylist(), dtype=object)
        out = ([], [], [])
        if len(ids) and right.num_rows:
            c = _matrix(left["embedding"]) - basis.mean
            cum = np.cumsum((c @ basis.directions.T) ** 2, axis=1) if basis.k else None
            for at in range(0, right.num_rows, 256):
                some = right.slice(at, 256)
                s = V._block_scores(c, np.einsum("ij,ij->i", c, c), cum, k, V.query_residuals(_matrix(some["qvec"]), basis, k))
                for j, q in enumerate(some["question_id"].to_pylist()):
                    best = V._topk_positions(s[:, j], ids, top_k)
                    for col, v in zip(out, ([q] * len(best), ids[best].tolist(), s[best, j].tolist()), strict=True):
                        col.extend(v)
        return pa.table({"question_id": pa.array(out[0], pa.int64()), "paper_id": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64(), from_pandas=True)})

    def read(pairs: DataFrame) -> DataFrame:
        asked = pairs.join(points.select("question_id", "qvec"), "question_id").withColumn("_cell", F.col("cell") + 0).drop("cell")
        wanted = cells.rows.join(pairs.select("cell").distinct(), "cell", "left_semi")
        return wanted.groupBy("cell").cogroup(asked.groupBy("_cell")).applyInArrow(score, "question_id long, paper_id string, score double")

    found = read(first).checkpoint()
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc_nulls_last(), F.col("paper_id").asc())
    held = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k)
    limit = held.groupBy("question_id").agg(F.count("score").alias("_n"), F.min("score").alias("_t"))
    bar = points.join(limit, "question_id", "left").withColumn("least", F.when(F.col("_n") >= top_k, F.col("_t")).otherwise(F.lit(-2.0))).drop("_n", "_t")

    def reaching(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"question_id": pa.array([], pa.int64()), "cell": pa.array([], pa.int64())})
        _, high = _limits(left, right)
        # the small numbers added to lengths only draw scores towards 0
        cell, q = np.nonzero(np.maximum(high, np.where(high < 0, 0.0, high)) >= right["least"].to_numpy()[None, :] - SLACK)
        return pa.table({"question_id": right["question_id"].take(pa.array(q)), "cell": left["cell"].take(pa.array(cell))})

    more = _grid(cells.summary, bar, "cell", "question_id", reaching, "question_id long, cell long").join(first, ["question_id", "cell"], "left_anti").checkpoint()
    if watch is not None:
        watch(first.unionByName(more))
    top = V.top_k_per_question(found.unionByName(read(more)), top_k)
    return top.select("question_id", F.col("rank").cast("long").alias("rank"), "paper_id", "score")


# --- exact extremes of all pairs -----------------------------------------------------

def pair_extremes(vecs: DataFrame, cell_rows: int = CELL_ROWS, watch=None) -> DataFrame:
    """One row (min, max): the least and the largest cosine (v / (|v| + eps)) of
    all pairs of vectors, nulls for fewer than two.

    Tiles are pairs of cells; a tile is one task and returns two numbers.  Each cell
    is first compared with itself, with the cell it may be nearest to and with the one
    it may be farthest from; then only tiles follow whose bounds go beyond what
    these gave.  ``watch`` is shown the tiles (cell, other) that were read."""
    cells = Cells(vecs, unit, cell_rows)
    other = cells.summary.select(*[F.col(c).alias(c) for c in cells.summary.columns])

    def partners(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [[], [], [], []]
        if left.num_rows and right.num_rows:
            low, high = _limits(left, right)
            a, b = left["cell"].to_numpy(), right["cell"].to_numpy()
            same = a[:, None] == b[None, :]
            low, high = np.where(same, 9.0, low), np.where(same, -9.0, high)
            for kind, best, value in ((0, low.argmin(axis=1), low.min(axis=1)), (1, high.argmax(axis=1), -high.max(axis=1))):
                for col, v in zip(rows, (a, b[best], np.full(len(a), kind), value), strict=True):
                    col.append(v)
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(rows, (np.int64, np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("cell", "other", "kind", "value"), cols, strict=True)))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        low, high = [], []
        if left.num_rows and right.num_rows:
            own = left["cell"][0].as_py() == right["_cell"][0].as_py()
            a, b = (x / (np.linalg.norm(x, axis=1, keepdims=True) + V.EPS) for x in (_matrix(left["embedding"]), _matrix(right["_v"])))
            b = a if own else b  # in one order
            for at in range(0, len(a), 1024):
                s = a[at:at + 1024] @ b.T
                if own:  # one cell with itself: each pair once
                    s = s[np.arange(at, at + len(s))[:, None] < np.arange(len(b))[None, :]]
                if s.size:
                    low.append(float(s.min()))
                    high.append(float(s.max()))
        return pa.table({"low": pa.array(low, pa.float64()), "high": pa.array(high, pa.float64())})

    def read(tiles: DataFrame) -> DataFrame:
        rows = cells.rows.select("cell", "embedding")
        x = tiles.join(rows, "cell").select("cell", "other", "embedding")
        y = tiles.join(rows.withColumnRenamed("cell", "other"), "other").select(
            (F.col("cell") + 0).alias("_a"), (F.col("other") + 0).alias("_b"), (F.col("other") + 0).alias("_cell"), F.col("embedding").alias("_v"))
        return x.groupBy("cell", "other").cogroup(y.groupBy("_a", "_b")).applyInArrow(tile, "low double, high double")

    def once(tiles: DataFrame) -> DataFrame:
        return tiles.select(F.least("cell", "other").alias("cell"), F.greatest("cell", "other").alias("other")).distinct()

    ends = _grid(cells.summary, other, "cell", "cell", partners, "cell long, other long, kind long, value double")
    ends = ends.groupBy("cell", "kind").agg(F.min_by("other", "value").alias("other")).select("cell", "other")
    first = once(ends.unionByName(cells.summary.select("cell", F.col("cell").alias("other")))).checkpoint()
    seen = read(first).agg(F.min("low").alias("low"), F.max("high").alias("high")).first()

    def beyond(left: pa.Table, right: pa.Table) -> pa.Table:
        a = b = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows and seen["low"] is not None:
            low, high = _limits(left, right)
            i, j = np.nonzero((low < seen["low"]) | (high > seen["high"]))
            a, b = left["cell"].to_numpy()[i], right["cell"].to_numpy()[j]
        return pa.table({"cell": a[a < b], "other": b[a < b]})

    more = _grid(cells.summary, other, "cell", "cell", beyond, "cell long, other long").join(first, ["cell", "other"], "left_anti").checkpoint()
    if watch is not None:
        watch(first.unionByName(more))
    known = vecs.sparkSession.createDataFrame([(seen["low"], seen["high"])], "low double, high double")
    return known.unionByName(read(more)).agg(F.min("low").alias("min"), F.max("high").alias("max"))
