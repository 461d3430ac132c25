import math

import numpy as np
import pytest

from papyra.llm.embedding_whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, deviation string, whitened int, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "x", 3, 4) for i, v in rows], SCHEMA)


def vectors(count=300, dim=12):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(count, dim)) * np.linspace(3, 0.2, dim) + 5).astype(np.float32).tolist()
    return [(i, v[i] if i % 3 else v[0]) for i in range(count)]  # a third of all rows are one vector


def brute(rows, weights="count", components=8):
    """Plain numpy over all rows, integers of Python."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in kept]
    fit = x if weights == "count" else sorted({tuple(r) for r in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array(fit, float) - np.array(s) / n
    e, axes = np.linalg.eigh(z.T @ z / n)
    e, axes, trace = e[::-1][:components], axes.T[::-1][:components], e.sum()
    white = (np.array(x, float) - np.array(s) / n) @ axes.T / np.sqrt(e)
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    return n, [i for i, _ in kept], deviation, white, e / trace


@pytest.mark.parametrize("weights", ["count", "one"])
@pytest.mark.parametrize("hot_keys", [1024, 2])
def test_equals_plain_numpy(spark, weights, hot_keys):
    rows = vectors()
    got = {r.vec_id: r for r in whiten(table(spark, rows), weights=weights, hot_keys=hot_keys).collect()}
    n, ids, deviation, white, explained = brute(rows, weights)
    assert sorted(got) == sorted(ids) and len(ids) == 300
    sign = np.sign(np.array(got[ids[1]].whitened)) * np.sign(white[1])
    for i, dev, w in zip(ids, deviation, white):
        assert (got[i].n, got[i].deviation) == (n, dev)
        assert np.allclose(np.array(got[i].whitened) * sign, w, atol=1e-9)
        assert np.allclose(got[i].explained, explained, rtol=1e-9)
        assert got[i].identity_error < 1e-9


def test_dropped_repeated_and_degenerate_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [nan] * 12), (902, [inf] * 12), (903, [None] * 12), (904, [])]
    rows = vectors(60) + [(None, [0.0] * 12), (5, [1.0] * 12), (5, [1.0] * 12)]
    got = whiten(table(spark, rows + bad)).collect()
    assert len(got) == 63 and {r.n for r in got} == {63} and {r.vec_id for r in got} == {None, *range(60)}
    # one vector only: no direction has variance
    one = whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(2, 0, [None, None], [0.0, 0.0], None)] * 2
    # lengths are fitted apart; sums beyond 64 bits have no deviation
    mixed = {r.vec_id: r for r in whiten(table(spark, [(1, [1.0]), (2, [3.0]), (3, [1.0, 1e30]), (4, [2.0, -1e30])])).collect()}
    assert [abs(mixed[i].whitened[0]) for i in (1, 2)] == [1.0, 1.0]
    assert mixed[1].deviation == 2048 ** 2 and mixed[3].deviation is None and mixed[3].n == 2
    for none in ([], bad):
        empty = whiten(table(spark, none))
        assert empty.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
