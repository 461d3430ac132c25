"""Vector operators: corpus mean, top-variance directions, debiased cosine.

Scoring uses an algebraic identity so that projected corpus vectors are never
materialised.  With mean mu, orthonormal directions D (k x d), centred row
c = x - mu and query residual r = (q - mu) - sum_j ((q - mu) . d_j) d_j:

    q'       = r / (|r| + eps)
    score(x) = c . q' / ( sqrt(max(0, |c|^2 - sum_j (c . d_j)^2)) + eps )

Only mu, D and at most QUESTIONS_PER_BLOCK query residuals are shipped to tasks;
each corpus row yields Q doubles.  The corpus itself is then scanned as Arrow
batches and never leaves its partition except as per-partition top-k candidates
or, for full rankings, as (question, id, score) rows.  More questions than that
never pass through the driver: they are dealt to chunks of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the scoring rule.
EPS = 1e-8                 # added to every norm before dividing
COMPONENTS_PER_ROWS = 10   # at most one removed direction per 10 corpus vectors
DEFAULT_COMPONENTS = 3
SWEEP_COMPONENTS = (0, 1, 2, 3, 5, 8, 15)
SCORE_DECIMALS = 10        # ranking key precision; absorbs last-bit noise

QUESTIONS_PER_BLOCK = 1024  # at most so many travel to tasks as one dense matrix
CHUNK_ROWS = 16_384         # corpus vectors that one task holds when questions are dealt
CHUNK_QUESTIONS = 16_384    # that one task answers, SCORE_CELLS scores at a time
SCORE_CELLS = 1 << 22
MOST_TASKS = 50_000         # of one search; beyond it a task takes several chunks in turn
EMIT_ROWS = 1 << 17  # of one Arrow batch of full scores
TILE = 64  # rows and columns of a piece of a dim x dim matrix
LANES = 32  # groups of partitions whose sums are added first


@dataclass
class Basis:
    """Corpus statistics a debiased score needs: fitted once per snapshot."""
    n: int
    dim: int
    mean: np.ndarray = field(repr=False)
    directions: np.ndarray = field(repr=False)  # (k, dim), orthonormal rows

    @property
    def k(self) -> int:
        return int(self.directions.shape[0])


def vectors_of(paper_embeddings: DataFrame, model: str) -> DataFrame:
    """All vectors of one model: (paper_id, embedding).  The model column is
    the partition key of the stored table, so this prunes files.  NULL vectors
    belong to no vector space and are left out."""
    return (paper_embeddings.where((F.col("model") == F.lit(model)) & F.col("embedding").isNotNull())
            .select("paper_id", F.col("embedding").cast("array<float>").alias("embedding")))


def capped_components(n_requested: int, n_rows: int, dim: int) -> int:
    """Directions actually removed: never more than one per ten vectors."""
    return max(0, min(int(n_requested), int(n_rows) // COMPONENTS_PER_ROWS, int(dim)))


def _dense(col: pa.Array) -> tuple[list[int], np.ndarray | None]:
    """The lengths that occur among the vectors of ``col`` and, if there is one, the matrix."""
    if col.null_count:
        col = col.filter(col.is_valid())
    dims = np.unique(np.diff(col.offsets.to_numpy())).tolist() if len(col) else []
    if len(dims) != 1:
        return dims, None
    return dims, col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dims[0])


def _partials(dims: set[int], n: int, sums: np.ndarray | None, cells: dict[tuple[int, int], np.ndarray]):
    """What one partition found: a row of sums per length, a row per tile."""
    rows = [(-1, -1, d, n if sums is not None else 0, np.zeros(d + 2) if sums is None else sums) for d in sorted(dims)]
    rows += [(i, j, max(dims), 0, m.ravel()) for (i, j), m in cells.items()]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)],
        ["ti", "tj", "dim", "n", "v"])


_PARTIALS = "ti int, tj int, dim int, n long, v array<double>"


def _moments_kernel():
    """mapInArrow over (vector): n, sum x with sum |x|^2 and sum |x|^4 behind
    it, and the tiles of the upper half of sum x x^T, per partition."""
    def fn(batches):
        n, dims, sums, g = 0, set(), None, None
        for rb in batches:
            found, x = _dense(rb.column(0))
            dims.update(found)
            if x is None or len(dims) > 1:
                continue  # mixed lengths are reported, not summed
            if g is None:
                sums, g = np.zeros(x.shape[1] + 2), np.zeros((x.shape[1], x.shape[1]))
            sq = np.einsum("ij,ij->i", x, x)
            sums += np.concatenate([x.sum(axis=0), [sq.sum(), (sq * sq).sum()]])
            g += x.T @ x
            n += len(x)
        if len(dims) > 1:
            yield _partials(dims, 0, None, {})
        elif n:
            at = range(0, len(g), TILE)
            yield _partials(dims, n, sums, {(i // TILE, j // TILE): g[i:i + TILE, j:j + TILE] for i in at for j in at if j >= i})
    return fn


def sum_tiles(parts: DataFrame) -> tuple[int, int, dict[tuple[int, int], np.ndarray]]:
    """(n, dim, sums by tile) of the partial sums of partitions.

    Tiles are added apart from each other, and each first in LANES groups of
    partitions: a task reads about partitions / LANES tiles, never whole
    matrices.  Vectors of more than one length raise."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    key = ["dim", "ti", "tj"]
    lanes = parts.select(*key, "n", array_to_vector("v").alias("v"), (F.spark_partition_id() % LANES).alias("lane"))
    some = lanes.groupBy(*key, "lane").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("v")).alias("v"))
    rows = some.groupBy(*key).agg(F.sum("n").alias("n"), Summarizer.sum(F.col("v")).alias("v")).collect()
    dims = sorted({r["dim"] for r in rows})
    if len(dims) > 1:
        raise ValueError(f"vectors of one model must share one dimension, got {dims[0]}..{dims[-1]}")
    return (sum(r["n"] for r in rows), dims[0] if dims else 0, {(r["ti"], r["tj"]): r["v"].toArray() for r in rows})


def second_moments(vecs: DataFrame, column: str = "embedding") -> tuple[int, int, np.ndarray, np.ndarray]:
    """(n, dim, sums, sum x x^T) in one distributed pass; ``sums`` is sum x,
    then sum |x|^2 and sum |x|^4.  The driver gets dim^2 / 2 numbers and a few."""
    from papyra.session import ship_package
    ship_package(vecs.sparkSession)
    n, dim, found = sum_tiles(vecs.select(column).mapInArrow(_moments_kernel(), _PARTIALS))
    g = np.zeros((dim, dim))
    for (i, j), v in found.items():
        if i >= 0:
            cell = g[i * TILE:(i + 1) * TILE, j * TILE:(j + 1) * TILE]
            cell[:] = v.reshape(cell.shape)
            g[j * TILE:(j + 1) * TILE, i * TILE:(i + 1) * TILE] = cell.T
    return n, dim, found.get((-1, -1), np.zeros(2)), g


def corpus_moments(vecs: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(n, dim, mean, covariance-times-n) in one distributed pass."""
    n, dim, sums, g = second_moments(vecs)
    if n == 0:
        return 0, dim, np.zeros(0), np.zeros((0, 0))
    mean = sums[:dim] / n
    scatter = g - n * np.outer(mean, mean)
    return n, dim, mean, (scatter + scatter.T) / 2


def _product_kernel(mean: np.ndarray, q: np.ndarray):
    """mapInArrow: sum (x - mean) ((x - mean) q), in tiles of rows, per partition."""
    def fn(batches):
        y, n = np.zeros_like(q), 0
        for rb in batches:
            _, x = _dense(rb.column(0))
            if x is not None and len(x):
                x = x - mean
                y += x.T @ (x @ q)
                n += len(x)
        if n:
            yield _partials({len(q)}, n, np.zeros(len(q) + 2), {(i // TILE, 0): y[i:i + TILE] for i in range(0, len(q), TILE)})
    return fn


def fit_basis_iterative(vecs: DataFrame, n_components: int = DEFAULT_COMPONENTS, extra: int = 10, tol: float = 1e-10,
                        passes: int = 60, blocks: int = 8, seed: int = 0) -> Basis:
    """``fit_basis`` for long vectors, by randomised block Krylov iteration.

    Every pass multiplies the scatter matrix, which is never built, with
    k + ``extra`` orthonormal columns: a partition returns dim x (k + extra)
    numbers in tiles, and so does the whole pass to the driver, which keeps at
    most ``blocks`` such blocks and then goes on from the best directions in
    them.  It ends when the k leading directions turn by less than ``tol``
    (largest sine), when the blocks span the whole space or after ``passes`` passes.  Defined cases as in ``fit_basis``: no vectors or fewer than ten per
    direction give fewer or no directions, mixed lengths raise."""
    from papyra.session import ship_package
    ship_package(vecs.sparkSession)
    x = vecs.select("embedding").where(F.col("embedding").isNotNull())
    dims = [r["d"] for r in x.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    if len(dims) > 1:
        raise ValueError(f"vectors of one model must share one dimension, got {dims[0]}..{dims[-1]}")
    dim = dims[0] if dims else 0
    n, mean = 0, np.zeros(dim)
    if dim:
        n, _, found = sum_tiles(x.mapInArrow(_sums_kernel(), _PARTIALS))
        mean = found[(-1, -1)][:dim] / n
    k = capped_components(n_components, n, dim)
    if k == 0:
        return Basis(n, dim, mean, np.zeros((0, dim)))
    q = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, min(dim, k + extra))))[0]
    last, width = None, q.shape[1]
    space, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for _ in range(passes):
        _, _, found = sum_tiles(x.mapInArrow(_product_kernel(mean, q), _PARTIALS))
        y = np.concatenate([found[(i, 0)].reshape(-1, q.shape[1]) for i in range(-(-dim // TILE))])
        space, image = np.hstack([space, q]), np.hstack([image, y])
        inner = space.T @ image
        w, turn = np.linalg.eigh((inner + inner.T) / 2)  # Ritz directions, best last
        d = space @ turn[:, ::-1][:, :k]
        if space.shape[1] == dim or (last is not None and np.linalg.norm(d - last @ (last.T @ d), 2) < tol):
            break
        last = d
        if space.shape[1] >= blocks * width:
            space, image = space @ turn[:, -width:], image @ turn[:, -width:]
            y = image
        for _ in range(2):
            y = y - space @ (space.T @ y)
        left, size, _ = np.linalg.svd(y, full_matrices=False)
        q = left[:, size > 1e-13 * max(abs(w[-1]), 1e-300)][:, :dim - space.shape[1]]
        if q.shape[1] == 0:  # the scatter matrix keeps the space: its directions are exact
            break
        q = np.linalg.qr(q - space @ (space.T @ q))[0]
    return Basis(n, dim, mean, np.ascontiguousarray(d.T))


def _sums_kernel():
    """mapInArrow: n and sum x per partition."""
    def fn(batches):
        n, s = 0, None
        for rb in batches:
            _, x = _dense(rb.column(0))
            if x is not None:
                s = (0 if s is None else s) + x.sum(axis=0)
                n += len(x)
        if n:
            yield _partials({len(s)}, n, np.concatenate([s, [0.0, 0.0]]), {})
    return fn


def fit_basis(vecs: DataFrame, n_components: int = DEFAULT_COMPONENTS, center: bool = True) -> Basis:
    """Mean and top-variance directions of a corpus (never of the queries).

    One pass gives the mean and the scatter matrix (dim x dim); its leading
    eigenvectors span the same subspace as the top right singular vectors
    of the centred corpus.  Every call fits anew, so an answer never rests on an
    older corpus; pass the basis on to share it between searches."""
    n, dim, mean, scatter = corpus_moments(vecs)
    if not center:
        mean = np.zeros(dim)
    k = capped_components(n_components, n, dim) if (n and center) else 0
    if k == 0:
        return Basis(n, dim, mean, np.zeros((0, dim)))
    w, v = np.linalg.eigh(scatter)
    order = np.argsort(w)[::-1][:k]
    d = v[:, order].T
    return Basis(n, dim, mean, d / np.linalg.norm(d, axis=1, keepdims=True))


def query_residuals(qvecs: np.ndarray, basis: Basis, k: int) -> np.ndarray:
    """Unit query residuals q' (Q x dim) after centring and removing the
    first k directions."""
    qc = qvecs.astype(np.float64) - basis.mean
    if k:
        dk = basis.directions[:k]
        qc = qc - (qc @ dk.T) @ dk
    return qc / (np.linalg.norm(qc, axis=1, keepdims=True) + EPS)


# ---------------------------------------------------------------------------
# Arrow kernel
# ---------------------------------------------------------------------------

def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions sorted by (score desc, NaN last, id asc)."""
    nan = np.isnan(scores)
    key = np.where(nan, 0.0, -scores)
    return np.array(sorted(range(len(scores)), key=lambda t: (bool(nan[t]), key[t], ids[t])),
                    dtype=np.int64)


def _topk_positions(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Exact top-k positions under (score desc, NaN last, id asc).

    argpartition narrows to the rows at or above the k-th value (ties at the
    boundary all kept), then an exact sort of that small set decides."""
    n = len(scores)
    if n > k:
        key = np.where(np.isnan(scores), -np.inf, scores)
        kth = np.partition(key, n - k)[n - k]
        cand = np.nonzero(key >= kth)[0]
    else:
        cand = np.arange(n)
    return cand[_order(scores[cand], ids[cand])[:k]]


def _centred_block(rb, mean, directions, dim):
    """(ids, centred rows, |c|^2, cumulative squared projections) of one
    Arrow batch; the one place corpus rows are prepared for scoring."""
    b = rb.num_rows
    ids = np.asarray(rb.column(0).to_pylist(), dtype=object)
    x = rb.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b, dim)
    c = x - mean
    sq = np.einsum("ij,ij->i", c, c)
    cum = np.cumsum((c @ directions.T) ** 2, axis=1) if directions.shape[0] else None
    return ids, c, sq, cum


def _block_scores(c, sq, cum, k, qp) -> np.ndarray:
    """Rounded debiased cosine of prepared rows against unit query residuals
    (b x Q); every kernel scores through this function."""
    resid = sq - cum[:, k - 1] if k else sq
    den = np.sqrt(np.maximum(resid, 0.0)) + EPS
    return np.round((c @ qp.T) / den[:, None], SCORE_DECIMALS)


def _scored(label, qids, ids, scores) -> pa.RecordBatch:
    """Rows of KERNEL_SCHEMA; a NaN score becomes NULL."""
    return pa.RecordBatch.from_pydict({
        "question_id": pa.array(qids, pa.int64()),
        "paper_id": pa.array(ids, pa.string()),
        "score": pa.array(scores, pa.float64(), mask=np.isnan(scores)),
        "n_components": pa.array(np.full(len(ids), label, dtype=np.int32), pa.int32()),
    })


def _all_scored(label, qids, ids, scores):
    """Every score of a (rows x questions) matrix, EMIT_ROWS at a time."""
    step = max(1, EMIT_ROWS // len(qids))
    for at in range(0, len(ids), step):
        some = ids[at:at + step]
        yield _scored(label, np.tile(qids, len(some)), np.repeat(some, len(qids)), scores[at:at + step].ravel())


def _kernel(mean, directions, variants, qids, top_k, dim):
    """Build the mapInArrow function.

    variants: list of (label, k, Qp) -- Qp (Q x dim) unit query residuals
    for the first k directions removed.
    """
    kmax = directions.shape[0]
    qids = np.asarray(qids, dtype=np.int64)
    nq = len(qids)

    def fn(batches):
        n, dims, sums, g = 0, set(), None, None
        for rb in batches:
            found, x = _dense(rb.column(0))
            dims.update(found)
            if x is None or len(dims) > 1:
                continue  # mixed lengths are reported, not summed
            if g is None:
                sums, g = np.zeros(x.shape[1] + 2), np.zeros((x.shape[1], x.shape[1]))
            sq = np.einsum("ij,ij->i", x, x)
            sums += np.concatenate([x.sum(axis=0), [sq.sum(), (sq * sq).sum()]])
            g += x.T @ x
            n += len(x)
        if len(dims) > 1:
            yield _partials(dims, 0, None, {})
        elif n:
            at = range(0, len(g), TILE)
            yield _partials(dims, n, sums, {(i // TILE, j // TILE): g[i:i + TILE, j:j + TILE] for i in at for j in at if j >= i})
    return fn


def sum_tiles(parts: DataFrame) -> tuple[int, int, dict[tuple[int, int], np.ndarray]]:
    """(n, dim, sums by tile) of the partial sums of partitions.

    Tiles are added apart from each other, and each first in LANES groups of
    partitions: a task reads about partitions / LANES tiles, never whole
    matrices.  Vectors of more than one length raise."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    key = ["dim", "ti", "tj"]
    lanes = parts.select(*key, "n", array_to_vector("v").alias("v"), (F.spark_partition_id() % LANES).alias("lane"))
    some = lanes.groupBy(*key, "lane").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("v")).alias("v"))
    rows = some.groupBy(*key).agg(F.sum("n").alias("n"), Summarizer.sum(F.col("v")).alias("v")).collect()
    dims = sorted({r["dim"] for r in rows})
    if len(dims) > 1:
        raise ValueError(f"vectors of one model must share one dimension, got {dims[0]}..{dims[-1]}")
    return (sum(r["n"] for r in rows), dims[0] if dims else 0, {(r["ti"], r["tj"]): r["v"].toArray() for r in rows})


def second_moments(vecs: DataFrame, column: str = "embedding") -> tuple[int, int, np.ndarray, np.ndarray]:
    """(n, dim, sums, sum x x^T) in one distributed pass; ``sums`` is sum x,
    then sum |x|^2 and sum |x|^4.  The driver gets dim^2 / 2 numbers and a few."""
    from papyra.session import ship_package
    ship_package(vecs.sparkSession)
    n, dim, found = sum_tiles(vecs.select(column).mapInArrow(_moments_kernel(), _PARTIALS))
    g = np.zeros((dim, dim))
    for (i, j), v in found.items():
        if i >= 0:
            cell = g[i * TILE:(i + 1) * TILE, j * TILE:(j + 1) * TILE]
            cell[:] = v.reshape(cell.shape)
            g[j * TILE:(j + 1) * TILE, i * TILE:(i + 1) * TILE] = cell.T
    return n, dim, found.get((-1, -1), np.zeros(2)), g


def corpus_moments(vecs: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(n, dim, mean, covariance-times-n) in one distributed pass."""
    n, dim, sums, g = second_moments(vecs)
    if n == 0:
        return 0, dim, np.zeros(0), np.zeros((0, 0))
    mean = sums[:dim] / n
    scatter = g - n * np.outer(mean, mean)
    return n, dim, mean, (scatter + scatter.T) / 2


def _product_kernel(mean: np.ndarray, q: np.ndarray):
    """mapInArrow: sum (x - mean) ((x - mean) q), in tiles of rows, per partition."""
    def fn(batches):
        y, n = np.zeros_like(q), 0
        for rb in batches:
            _, x = _dense(rb.column(0))
            if x is not None and len(x):
                x = x - mean
                y += x.T @ (x @ q)
                n += len(x)
        if n:
            yield _partials({len(q)}, n, np.zeros(len(q) + 2), {(i // TILE, 0): y[i:i + TILE] for i in range(0, len(q), TILE)})
    return fn


def fit_basis_iterative(vecs: DataFrame, n_components: int = DEFAULT_COMPONENTS, extra: int = 10, tol: float = 1e-10,
                        passes: int = 60, blocks: int = 8, seed: int = 0) -> Basis:
    """``fit_basis`` for long vectors, by randomised block Krylov iteration.

    Every pass multiplies the scatter matrix, which is never built, with
    k + ``extra`` orthonormal columns: a partition returns dim x (k + extra)
    numbers in tiles, and so does the whole pass to the driver, which keeps at
    most ``blocks`` such blocks and then goes on from the best directions in
    them.  It ends when the k leading directions turn by less than ``tol``
    (largest sine), when the blocks span the whole space or after ``passes`` passes.  Defined cases as in ``fit_basis``: no vectors or fewer than ten per
    direction give fewer or no directions, mixed lengths raise."""
    from papyra.session import ship_package
    ship_package(vecs.sparkSession)
    x = vecs.select("embedding").where(F.col("embedding").isNotNull())
    dims = [r["d"] for r in x.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    if len(dims) > 1:
        raise ValueError(f"vectors of one model must share one dimension, got {dims[0]}..{dims[-1]}")
    dim = dims[0] if dims else 0
    n, mean = 0, np.zeros(dim)
    if dim:
        n, _, found = sum_tiles(x.mapInArrow(_sums_kernel(), _PARTIALS))
        mean = found[(-1, -1)][:dim] / n
    k = capped_components(n_components, n, dim)
    if k == 0:
        return Basis(n, dim, mean, np.zeros((0, dim)))
    q = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, min(dim, k + extra))))[0]
    last, width = None, q.shape[1]
    space, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for _ in range(passes):
        _, _, found = sum_tiles(x.mapInArrow(_product_kernel(mean, q), _PARTIALS))
        y = np.concatenate([found[(i, 0)].reshape(-1, q.shape[1]) for i in range(-(-dim // TILE))])
        space, image = np.hstack([space, q]), np.hstack([image, y])
        inner = space.T @ image
        w, turn = np.linalg.eigh((inner + inner.T) / 2)  # Ritz directions, best last
        d = space @ turn[:, ::-1][:, :k]
        if space.shape[1] == dim or (last is not None and np.linalg.norm(d - last @ (last.T @ d), 2) < tol):
            break
        last = d
        if space.shape[1] >= blocks * width:
            space, image = space @ turn[:, -width:], image @ turn[:, -width:]
            y = image
        for _ in range(2):
            y = y - space @ (space.T @ y)
        left, size, _ = np.linalg.svd(y, full_matrices=False)
        q = left[:, size > 1e-13 * max(abs(w[-1]), 1e-300)][:, :dim - space.shape[1]]
        if q.shape[1] == 0:  # the scatter matrix keeps the space: its directions are exact
            break
        q = np.linalg.qr(q - space @ (space.T @ q))[0]
    return Basis(n, dim, mean, np.ascontiguousarray(d.T))


def _sums_kernel():
    """mapInArrow: n and sum x per partition."""
    def fn(batches):
        n, s = 0, None
        for rb in batches:
            _, x = _dense(rb.column(0))
            if x is not None:
                s = (0 if s is None else s) + x.sum(axis=0)
                n += len(x)
        if n:
            yield _partials({len(s)}, n, np.concatenate([s, [0.0, 0.0]]), {})
    return fn


def fit_basis(vecs: DataFrame, n_components: int = DEFAULT_COMPONENTS, center: bool = True) -> Basis:
    """Mean and top-variance directions of a corpus (never of the queries).

    One pass gives the mean and the scatter matrix (dim x dim); its leading
    eigenvectors span the same subspace as the top right singular vectors
    of the centred corpus.  Every call fits anew, so an answer never rests on an
    older corpus; pass the basis on to share it between searches."""
    n, dim, mean, scatter = corpus_moments(vecs)
    if not center:
        mean = np.zeros(dim)
    k = capped_components(n_components, n, dim) if (n and center) else 0
    if k == 0:
        return Basis(n, dim, mean, np.zeros((0, dim)))
    w, v = np.linalg.eigh(scatter)
    order = np.argsort(w)[::-1][:k]
    d = v[:, order].T
    return Basis(n, dim, mean, d / np.linalg.norm(d, axis=1, keepdims=True))


def query_residuals(qvecs: np.ndarray, basis: Basis, k: int) -> np.ndarray:
    """Unit query residuals q' (Q x dim) after centring and removing the
    first k directions."""
    qc = qvecs.astype(np.float64) - basis.mean
    if k:
        dk = basis.directions[:k]
        qc = qc - (qc @ dk.T) @ dk
    return qc / (np.linalg.norm(qc, axis=1, keepdims=True) + EPS)


# ---------------------------------------------------------------------------
# Arrow kernel
# ---------------------------------------------------------------------------

def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions sorted by (score desc, NaN last, id asc)."""
    nan = np.isnan(scores)
    key = np.where(nan, 0.0, -scores)
    return np.array(sorted(range(len(scores)), key=lambda t: (bool(nan[t]), key[t], ids[t])),
                    dtype=np.int64)


def _topk_positions(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Exact top-k positions under (score desc, NaN last, id asc).

    argpartition narrows to the rows at or above the k-th value (ties at the
    boundary all kept), then an exact sort of that small set decides."""
    n = len(scores)
    if n > k:
        key = np.where(np.isnan(scores), -np.inf, scores)
        kth = np.partition(key, n - k)[n - k]
        cand = np.nonzero(key >= kth)[0]
    else:
        cand = np.arange(n)
    return cand[_order(scores[cand], ids[cand])[:k]]


def _centred_block(rb, mean, directions, dim):
    """(ids, centred rows, |c|^2, cumulative squared projections) of one
    Arrow batch; the one place corpus rows are prepared for scoring."""
    b = rb.num_rows
    ids = np.asarray(rb.column(0).to_pylist(), dtype=object)
    x = rb.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b, dim)
    c = x - mean
    sq = np.einsum("ij,ij->i", c, c)
    cum = np.cumsum((c @ directions.T) ** 2, axis=1) if directions.shape[0] else None
    return ids, c, sq, cum


def _block_scores(c, sq, cum, k, qp) -> np.ndarray:
    """Rounded debiased cosine of prepared rows against unit query residuals
    (b x Q); every kernel scores through this function."""
    resid = sq - cum[:, k - 1] if k else sq
    den = np.sqrt(np.maximum(resid, 0.0)) + EPS
    return np.round((c @ qp.T) / den[:, None], SCORE_DECIMALS)


def _scored(label, qids, ids, scores) -> pa.RecordBatch:
    """Rows of KERNEL_SCHEMA; a NaN score becomes NULL."""
    return pa.RecordBatch.from_pydict({
        "question_id": pa.array(qids, pa.int64()),
        "paper_id": pa.array(ids, pa.string()),
        "score": pa.array(scores, pa.float64(), mask=np.isnan(scores)),
        "n_components": pa.array(np.full(len(ids), label, dtype=np.int32), pa.int32()),
    })


def _all_scored(label, qids, ids, scores):
    """Every score of a (rows x questions) matrix, EMIT_ROWS at a time."""
    step = max(1, EMIT_ROWS // len(qids))
    for at in range(0, len(ids), step):
        some = ids[at:at + step]
        yield _scored(label, np.tile(qids, len(some)), np.repeat(some, len(qids)), scores[at:at + step].ravel())


def _kernel(mean, directions, variants, qids, top_k, dim):
    """Build the mapInArrow function.

    variants: list of (label, k, Qp) -- Qp (Q x dim) unit query residuals
    for the first k directions removed.
    """
    kmax = directions.shape[0]
    qids = np.asarray(qids, dtype=np.int64)
    nq = len(qids)

    def emit(label, q_idx, ids, scores):
        mask = np.isnan(scores)
        cols = {
            "question_id": pa.array(qids[q_idx], pa.int64()),
            "paper_id": pa.array(ids, pa.string()),
            "score": pa.array(scores, pa.float64(), mask=mask),
            "n_components": pa.array(np.full(len(ids), label, dtype=np.int32), pa.int32()),
        }
        return pa.RecordBatch.from_pydict(cols)

    def fn(batches):
        running = {}  # (variant index, question index) -> (scores, ids)
        for rb in batches:
            b = rb.num_rows
            if b == 0:
                continue
            ids, c, sq, cum = _centred_block(rb, mean, directions, dim)
            for vi, (label, k, qp) in enumerate(variants):
                s = _block_scores(c, sq, cum, k, qp)  # (b, Q)
                if top_k is None:
                    yield from _all_scored(label, qids, ids, s)
                    continue
                for qi in range(nq):
                    col = s[:, qi]
                    pos = _topk_positions(col, ids, top_k)
                    cs, ci = col[pos], ids[pos]
                    if (vi, qi) in running:
                        ps, pi = running[(vi, qi)]
                        cs, ci = np.concatenate([ps, cs]), np.concatenate([pi, ci])
                        pos = _topk_positions(cs, ci, top_k)
                        cs, ci = cs[pos], ci[pos]
                    running[(vi, qi)] = (cs, ci)
        if top_k is not None and running:
            labels = {vi: v[0] for vi, v in enumerate(variants)}
            by_label = {}
            for (vi, qi), (cs, ci) in running.items():
                by_label.setdefault(vi, []).append((qi, cs, ci))
            for vi, parts in by_label.items():
                q_idx = np.concatenate([np.full(len(cs), qi) for qi, cs, _ in parts]).astype(np.int64)
                yield _scored(labels[vi], qids[q_idx],
                              np.concatenate([ci for _, _, ci in parts]),
                              np.concatenate([cs for _, cs, _ in parts]))

    return fn


KERNEL_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("paper_id", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("n_components", T.IntegerType()),
])


def _few_questions(questions: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of at most QUESTIONS_PER_BLOCK questions; None if there are more."""
    rows = questions.limit(QUESTIONS_PER_BLOCK + 1).collect()
    if len(rows) > QUESTIONS_PER_BLOCK:
        return None
    rows.sort(key=lambda r: r["question_id"])
    return (np.array([r["question_id"] for r in rows], dtype=np.int64),
            np.array([r["qvec"] for r in rows], dtype=np.float64))


def _dealt_kernel(mean, directions, variants_of: Callable, top_k, dim):
    """The mapInArrow function of dealt questions.  Rows come sorted by cell, the
    cell's vectors (tag 0) before its questions (tag 1): one chunk of vectors and one
    batch of questions are held at a time."""

    def matrix(column, rows):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) != rows * dim:
            raise ValueError(f"question vectors must have dimension {dim}")
        return flat.reshape(rows, dim)

    def answer(chunk, batch):
        ids, c, sq, cum = chunk
        qids, qv = batch["question_id"].to_numpy(), matrix(batch["v"], batch.num_rows)
        step = max(1, SCORE_CELLS // max(1, len(ids)))
        for at in range(0, len(qids), step):
            some = qids[at:at + step]
            for label, k, qp in variants_of(qv[at:at + step]):
                s = _block_scores(c, sq, cum, k, qp)
                if top_k is None:
                    yield from _all_scored(label, some, ids, s)
                    continue
                best = [_topk_positions(s[:, j], ids, top_k) for j in range(len(some))]
                pos = np.concatenate(best)
                col = np.repeat(np.arange(len(some)), [len(x) for x in best])
                yield _scored(label, some[col], ids[pos], s[pos, col])

    def fn(batches):
        cell, parts, chunk = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key, tag = batch["cell"].to_numpy(), batch["tag"].to_numpy()
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(tag) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(key)], strict=True):
                if a == b:
                    continue
                if key[a] != cell:
                    cell, parts, chunk = key[a], [], None
                piece = table.slice(a, b - a)
                if tag[a] == 0:
                    parts.append(piece.select(["paper_id", "v"]))
                    continue
                if parts:
                    whole = pa.concat_tables(parts).combine_chunks().to_batches()[0]
                    chunk, parts = _centred_block(whole, mean, directions, dim), []
                if chunk is not None:
                    yield from answer(chunk, piece)

    return fn


def _deal_questions(vecs: DataFrame, questions: DataFrame, fn: Callable) -> DataFrame:
    """Chunks of vectors meet blocks of questions in cells: each vector moves once for
    every CHUNK_QUESTIONS questions, each question once for every CHUNK_ROWS vectors."""
    nb = max(1, math.ceil(vecs.count() / CHUNK_ROWS))
    nq = max(1, math.ceil(questions.count() / CHUNK_QUESTIONS))
    tasks = min(nb * nq, MOST_TASKS)

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def rows(df, tag, paper, question, v):
        return df.select((F.col("__b") * nq + F.col("__q")).alias("cell"), F.lit(tag).alias("tag"), paper.cast("string").alias("paper_id"),
                         question.cast("long").alias("question_id"), v.cast("array<double>").alias("v"))

    none = F.lit(None)
    data = vecs.withColumn("__b", F.pmod(F.xxhash64("paper_id", "embedding"), F.lit(nb))).withColumn("__q", each(nq))
    asked = questions.withColumn("__q", F.pmod(F.xxhash64("question_id"), F.lit(nq))).withColumn("__b", each(nb))
    cells = rows(data, 0, F.col("paper_id"), none, F.col("embedding")).unionByName(
        rows(asked, 1, none, F.col("question_id"), F.col("qvec")))
    return (cells.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "tag")
            .mapInArrow(fn, KERNEL_SCHEMA))


def score_corpus(vecs: DataFrame, questions: DataFrame, basis: Basis,
                 components=(DEFAULT_COMPONENTS,), top_k: int | None = None,
                 raw: bool = False) -> DataFrame:
    """Debiased cosine of every question against every corpus vector.

    components: the numbers of directions to remove (each capped as in
    ``capped_components``); one output variant per entry, labelled by the
    requested number.  top_k: when set, each partition emits only its exact
    top-k per (question, variant); the global top-k is a subset of their
    union.  raw: plain cosine, no centring or removal.

    Up to QUESTIONS_PER_BLOCK questions go to the vectors, which stay where they
    are; beyond that both are dealt into cells by a shuffle.  Questions without a
    vector are left out.
    """
    from papyra.session import ship_package
    ship_package(vecs.sparkSession)
    spark = vecs.sparkSession
    if basis.n == 0:
        return spark.createDataFrame([], KERNEL_SCHEMA)
    dim = basis.dim
    mean = np.zeros(dim) if raw else basis.mean
    directions = np.zeros((0, dim)) if raw else basis.directions
    used = Basis(basis.n, dim, mean, directions)
    removed = [(int(n), 0 if raw else min(capped_components(n, basis.n, dim), len(directions))) for n in components]

    def variants_of(qv):
        if raw:
            return [(n, 0, qv / (np.linalg.norm(qv, axis=1, keepdims=True) + EPS)) for n, _ in removed]
        return [(n, k, query_residuals(qv, used, k)) for n, k in removed]

    vecs = vecs.select("paper_id", "embedding")
    asked = questions.where(F.col("qvec").isNotNull()).select("question_id", "qvec")
    few = _few_questions(asked)
    if few is None:
        return _deal_questions(vecs, asked, _dealt_kernel(mean, directions, variants_of, top_k, dim))
    qids, qv = few
    if not len(qids):
        return spark.createDataFrame([], KERNEL_SCHEMA)
    if qv.ndim != 2 or qv.shape[1] != dim:
        raise ValueError(f"question vectors must have dimension {dim}")
    return vecs.mapInArrow(_kernel(mean, directions, variants_of(qv), qids, top_k, dim), KERNEL_SCHEMA)


def top_k_per_question(scored: DataFrame, k: int, keys=("question_id",)) -> DataFrame:
    """Final top-k over candidates: row_number per question (planned as
    WindowGroupLimit: partial top-k before the shuffle)."""
    from pyspark.sql import Window

    if k < 0:
        raise ValueError("top_k must be >= 0")
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), F.col("paper_id").asc())
    return (scored.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def search_similar(paper_embeddings: DataFrame, questions: DataFrame, model: str,
                   top_k: int = 5, n_components: int = DEFAULT_COMPONENTS,
                   basis: Basis | None = None) -> DataFrame:
    """Debiased cosine top-k per question: (question_id, rank, paper_id, score)."""
    if top_k < 0:
        raise ValueError("top_k must be >= 0")
    vecs = vectors_of(paper_embeddings, model)
    basis = basis or fit_basis(vecs, n_components)
    cand = score_corpus(vecs, questions, basis, components=(n_components,), top_k=max(top_k, 1))
    return (top_k_per_question(cand, top_k)
            .select("question_id", F.col("rank").cast("long").alias("rank"), "paper_id", "score"))


def sweep_components(paper_embeddings: DataFrame, questions: DataFrame, model: str,
                     top_k: int = 5, ns=SWEEP_COMPONENTS) -> DataFrame:
    """Top-k for several numbers of removed directions in one corpus pass.

    Principal directions are nested, so one fit at the largest capped n serves
    every n; each row carries cumulative projection sums."""
    vecs = vectors_of(paper_embeddings, model)
    basis = fit_basis(vecs, max(ns))
    cand = score_corpus(vecs, questions, basis, components=tuple(ns), top_k=max(top_k, 1))
    return top_k_per_question(cand, top_k, keys=("question_id", "n_components"))


def l2_normalize(x) -> F.Column:
    """v / (|v| + eps) as a built-in expression (double precision)."""
    x = F.col(x) if isinstance(x, str) else x
    xd = F.transform(x, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(xd, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.transform(xd, lambda v: v / (norm + F.lit(EPS)))


def corpus_mean(vecs: DataFrame) -> DataFrame:
    """Column-wise mean as rows (pos, mean), computed in one aggregation."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    m = vecs.agg(Summarizer.mean(array_to_vector(F.col("embedding"))).alias("m"))
    return m.select(F.posexplode(vector_to_array("m")).alias("pos", "mean"))


# ---------------------------------------------------------------------------
# Exact ranks of a bounded set of probe rows
# ---------------------------------------------------------------------------

class IdCoder:
    """Order-preserving integer codes relative to a fixed set of probe ids:
    a probe id gets 2i+1, any other id 2i where i is its insertion point, so
    row < probe exactly when code(row) < code(probe).  One vectorised
    searchsorted per batch."""

    def __init__(self, probe_ids: np.ndarray):
        self.p = np.unique(np.asarray(probe_ids).astype(str))
        self.n_codes = 2 * len(self.p) + 1

    def codes(self, ids) -> np.ndarray:
        x = np.asarray(ids).astype(str)
        pos = np.searchsorted(self.p, x)
        if len(self.p) == 0:
            return np.zeros(len(x), dtype=np.int64)
        hit = (pos < len(self.p)) & (self.p[np.minimum(pos, len(self.p) - 1)] == x)
        return 2 * pos.astype(np.int64) + hit


def count_before(keys: np.ndarray, row_codes: np.ndarray, pk: np.ndarray, probe_codes: np.ndarray,
                 n_codes: int) -> np.ndarray:
    """For each probe: rows with key > pk, or key == pk and id < probe id
    (rows ranked before it under key desc, id asc).  Vectorised: each
    (key, id) becomes one integer that grows with rank priority, and a
    single searchsorted counts the larger ones.  NaN keys must be -inf."""
    kun, kinv = np.unique(np.concatenate([keys, pk]), return_inverse=True)
    m = n_codes + 1
    comp = kinv.astype(np.int64) * m + (n_codes - np.concatenate([row_codes, probe_codes]).astype(np.int64))
    rc = np.sort(comp[: len(keys)])
    return (len(rc) - np.searchsorted(rc, comp[len(keys):], side="right")).astype(np.int64)
