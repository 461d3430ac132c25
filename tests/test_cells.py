import numpy as np
import pytest

from papyra.operators import cells as C
from papyra.operators import vectors as V


def frame(spark, x):
    return spark.createDataFrame([(f"p{i:05d}", [float(c) for c in v]) for i, v in enumerate(x)], "paper_id string, embedding array<float>")


def clusters(n=600, dim=6, groups=12, spread=0.02, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    x = centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    x[-1] = x[0]
    return np.float32(x)


@pytest.mark.parametrize("x", [clusters(), np.float32(np.random.default_rng(1).normal(size=(200, 5))), clusters(3), clusters(40, spread=0.0)])
def test_cells_search_equals_scan(spark, x):
    vecs = frame(spark, x)
    q = np.float32(np.random.default_rng(9).normal(size=(5, x.shape[1])))
    q[0] = x[1]
    qs = spark.createDataFrame([(i, [float(c) for c in v] if i != 4 else None) for i, v in enumerate(q)], "question_id long, qvec array<float>")
    basis = V.fit_basis(vecs, 1)
    read = {}
    got = C.search_cells(vecs, qs, basis, 7, 1, cell_rows=30, watch=lambda df: read.update(n=df.count()))
    want = V.top_k_per_question(V.score_corpus(vecs, qs, basis, components=(1,), top_k=7), 7)
    rows = lambda df: sorted((r.question_id, r["rank"], r.paper_id, r.score) for r in df.collect())
    assert rows(got) == rows(want)
    if len(x) == 600:
        assert read["n"] < 0.6 * 4 * 32  # most cells of a clustered corpus are skipped


@pytest.mark.parametrize("x", [clusters(), np.float32(np.random.default_rng(1).normal(size=(150, 5))), clusters(2), clusters(30, spread=0.0)])
def test_extremes_equal_all_pairs(spark, x):
    read = {}
    got = C.pair_extremes(frame(spark, x), cell_rows=30, watch=lambda df: read.update(n=df.count())).first()
    u = x.astype(float) / (np.linalg.norm(x.astype(float), axis=1, keepdims=True) + V.EPS)
    s = (u @ u.T)[np.triu_indices(len(x), 1)]
    assert np.allclose((got["min"], got["max"]), (s.min(), s.max()), atol=1e-12)
    if len(x) == 600:
        assert read["n"] < 0.5 * 32 * 33 / 2


def test_extremes_of_less_than_a_pair(spark):
    for x in (np.zeros((0, 3), np.float32), clusters(1)):
        assert tuple(C.pair_extremes(frame(spark, x)).first()) == (None, None)


def test_cells_are_balanced(spark):
    hot = np.repeat(clusters(1), 400, axis=0)  # one direction holds most rows
    vecs = frame(spark, np.concatenate([clusters(200), hot]))
    c = C.Cells(vecs, C.unit, 50)
    sizes = [r.n for r in c.summary.collect()]
    assert sum(sizes) == 600 and max(sizes) <= 100
