import math

import pytest

from papyra.llm.mixing import entropy_copies, mix


def targets(sizes):
    """Water filling in plain Python: sizes by source in rank order."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    cap = {s: 2.0 * n for s, n in sizes.items()}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap[s] <= unit * weight[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * 37) % 90)), "big" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_copies(skewed):
    rows = entropy_copies(skewed, block_docs=64).join(skewed.selectExpr("doc_id as __id", "source"), "__id").collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        target[r.source] = r.target
        assert r.copies in (0, 1, 2)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets({s: sizes[s] for s in order})
    for s in order:
        assert math.isclose(want[s], target[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= max(50, 0.01 * target[s])


def test_reruns_agree(skewed):
    a, b = (sorted((r["__id"], r.copies) for r in entropy_copies(skewed.repartition(n)).collect()) for n in (3, 7))
    assert a == b


def test_odd_rows(odd_docs, no_docs):
    rows = entropy_copies(odd_docs).collect()
    assert sum(r["__n"] for r in rows) == odd_docs.count()
    assert all(r.copies == 1 for r in rows if r.size == 0)
    out = mix(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(8) in (0, 2, 4)
    assert entropy_copies(no_docs).count() == 0 and mix(no_docs).count() == 0
