import numpy as np
import pytest

from papyra.llm.collision_search import RADII, WIDTH, Index, at_least, bit_counts, nearest
from papyra.llm.embedding_dedup import near_vectors
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"
INF, NAN = float("inf"), float("nan")


def vectors(n, seed=0, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.1, 0.3, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3), None, i))
    rows += [(n + 1, rows[0][1], 0, "x", 1), (n + 2, rows[0][1], 0, "x", 1), (n + 3, rows[0][1], 1, "x", 1), (n + 4, rows[0][1], None, "x", 1)]
    rows += [(n + 5, None, 0, None, None), (n + 6, [0.0] * dim, 0, None, None), (n + 7, [NAN] * dim, 0, None, None),
             (n + 8, [INF, *[1.0] * (dim - 1)], 0, None, None), (n + 9, [None, *[1.0] * (dim - 1)], 0, None, None),
             (n + 10, [], 0, None, None), (n + 11, [1.0, 2.0], 0, None, None), (n + 12, [2.0, 4.0], 0, None, None)]
    return rows


def fit_for_search(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [16, 2048])
def test_near_vectors_equal_brute_force(spark, block):
    rows = vectors(400)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93, block=block).collect()}
    links = []
    for a, (_, v, la, *_) in enumerate(rows):
        for b in range(a):
            w, lb = rows[b][1], rows[b][2]
            if la is not None and la == lb and fit_for_search(v) and fit_for_search(w) and len(v) == len(w):
                if np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                    links.append((a, b))
    comp = brute.components(len(rows), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert n.sum() > 500
    for k, (i, *_) in enumerate(rows):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[k], rows[comp[k]][0], comp[k] == k)


def test_near_vectors_without_ids_or_rows(spark):
    rows = [(None, [1.0, 0.0], 1, None, 1), (None, [1.0, 0.0], 1, None, 1), (4, [1.0, 0.0], 1, None, 1), (4, [1.0, 0.0], 1, None, 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_vectors(d).collect())
    assert got == [("4", 1, 4, True), ("4", 1, 4, True), ("None", 0, None, True), ("None", 0, None, True)]
    assert near_vectors(d.limit(0)).count() == 0


def test_nearest_recall_and_scores(spark):
    rows = vectors(900, seed=2)
    found = nearest(spark.createDataFrame(rows, SCHEMA), every=20, k=20, block=256, query_block=16).collect()
    hit = total = 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    for i, v, *_ in rows:
        if i % 20 or not fit_for_search(v):
            assert i not in by
            continue
        best = sorted(((-float(np.dot(v, w)), j) for j, w, *_ in rows if j != i and fit_for_search(w) and len(w) == len(v)))[:20]
        got = sorted(by[i], key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        exact = {j: -s for s, j in best}
        assert all(abs(exact[r.vec_id] - r.score) < 1e-9 for r in got if r.vec_id in exact)
        hit, total = hit + sum(r.vec_id in exact for r in got), total + len(best)
    assert total > 800 and hit >= 0.9 * total


def test_nearest_with_few_or_no_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0], 1, None, 1), (20, [2.0, 0.0], 1, None, 1), (None, [1.0, 1.0], 1, None, 1),
                               (3, [2.0, 0.0], None, None, 1)], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(d).collect())
    assert got == [(0, 1, 3, 2.0), (0, 2, 20, 2.0), (20, 1, 3, 4.0), (20, 2, 0, 2.0)]
    assert nearest(d.limit(0)).count() == 0


def test_near_vectors_ids_of_several_vectors(spark):
    x, y = [1.0, 0.0, 0.5], [0.0, 1.0, 0.5]
    rows = [(1, x, 0), (1, y, 1), (5, [1.0, 0.01, 0.5], 0), (6, [0.01, 1.0, 0.5], 1), (3, [0.0, -1.0, 0.0], 0)]
    d = spark.createDataFrame([(*r, 9, 9, "q") for r in rows],
                              "vec_id long, embedding array<float>, label int, n_links int, component_id int, __rep string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(d).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (3, 0, 3, True), (5, 1, 1, False), (6, 1, 1, False)]


def test_collisions_filter_unrelated_vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1060] = x[7] + 0.05 * rng.normal(size=(60, 64))  # one query has near vectors, the others none
    ids = np.arange(len(x))
    index = Index(ids, x, projections=200, slack=0.3, seed=5)
    asked = np.array([7, *range(2000, 2040)])
    share, hit = [], 0
    for i, got, score, verified in index.search(x[asked], asked, 20):
        s = x @ x[asked[i]]
        s[asked[i]] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(got.tolist()))
        assert np.allclose(score, s[got])
        share.append(verified / len(x))
    assert hit >= 0.9 * 20 * len(asked)
    assert share[0] < 0.02 and np.mean(share) < 0.2


def test_nearest_several_cells_in_a_task(spark, monkeypatch):
    from papyra.llm import collision_search
    d = spark.createDataFrame(vectors(300, seed=3), SCHEMA)
    want = nearest(d, every=10, block=64, query_block=8).collect()
    monkeypatch.setattr(collision_search, "MOST_TASKS", 3)
    got = nearest(d, every=10, block=64, query_block=8).collect()
    assert len(got) > 500 and sorted(got) == sorted(want)


def test_search_counts_at_few_radii():
    calls = []

    class Counted(Index):
        def _verify(self, *args):
            calls.append(1)
            return super()._verify(*args)

    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64))
    asked = np.arange(0, 1000, 20)
    index = Counted(np.arange(len(x)), x, projections=200, slack=0.3, seed=5)
    got = {i: (ids.tolist(), score.tolist()) for i, ids, score, _ in index.search(x[asked], asked, 20)}
    assert len(calls) <= 4 * len(asked)
    # where the walk over the radii starts changes no result
    for i in (0, 17, 49):
        _, ids, score, _ = next(iter(index.search(x[asked[i:i + 1]], asked[i:i + 1], 20)))
        assert (ids.tolist(), score.tolist()) == got[i]


def test_search_counts_most_queries_once():
    calls = []

    class Counted(Index):
        def _verify(self, *args):
            calls.append(1)
            return super()._verify(*args)

    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    asked = np.arange(0, 2000, 10)
    index = Counted(np.arange(len(x)), x, projections=200, slack=0.3, seed=5)
    assert len(list(index.search(x[asked], asked, 20))) == len(asked)
    assert len(calls) <= 1.8 * len(asked)


def test_search_equals_plain_collision_counting():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, size=(900, 1))
    x[::3] = x[5] + 0.1 * rng.normal(size=(300, 16))
    ids, k = np.arange(900), 20
    index = Index(ids, x, projections=60, slack=0.3, seed=5)
    unit = np.hstack([x / index.scale, np.sqrt(np.maximum(0, 1 - (x ** 2).sum(axis=1, keepdims=True) / index.scale ** 2))])
    values = unit @ index.axes
    for i, got, score, _ in index.search(x[:200], ids[:200], k):
        q = np.append(x[i] / np.linalg.norm(x[i]), 0)
        found, s = ids[ids != i], (x * x[i]).sum(axis=1)
        for r in RADII:
            count = (np.abs(values - q @ index.axes) <= r * WIDTH / 2).sum(axis=1)
            some = ids[(count >= index.need) & (ids != i)]
            if len(some) >= k and np.sqrt(max(0, 2 - 2 * np.sort(s[some])[-k] / index.scale / np.linalg.norm(x[i]))) <= r:
                found = some
                break
        best = found[np.lexsort((found, -s[found]))[:k]]
        assert got.tolist() == best.tolist() and np.array_equal(score, s[best])


def test_bit_counts():
    rng = np.random.default_rng(10)
    for m in (1, 2, 3, 4, 7, 60, 200):
        bits = rng.random((m, 2, 128)) < 0.8
        planes = bit_counts(np.packbits(bits, axis=2, bitorder="little").view(np.uint64))
        for need in (0, 1, m // 2, m, m + 1, 300):
            got = np.unpackbits(at_least(planes, need).view(np.uint8), axis=1, bitorder="little")
            assert np.array_equal(got, bits.sum(axis=0) >= need)
