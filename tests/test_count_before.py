"""The vectorised probe-rank counter against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.operators.vectors import IdCoder, count_before

ids = st.text(alphabet="ab01", min_size=0, max_size=4)
keys = st.sampled_from([-np.inf, -1.0, 0.0, 0.5, 0.5000000001, 2.0])


@settings(max_examples=300, deadline=None)
@given(rows=st.lists(st.tuples(keys, ids), max_size=40), probes=st.lists(st.tuples(keys, ids), max_size=10))
def test_count_before_matches_brute_force(rows, probes):
    rk = np.array([k for k, _ in rows], dtype=np.float64)
    ri = np.array([i for _, i in rows], dtype=object)
    pk = np.array([k for k, _ in probes], dtype=np.float64)
    pi = np.array([i for _, i in probes], dtype=object)
    coder = IdCoder(pi)
    got = count_before(rk, coder.codes(ri), pk, coder.codes(pi), coder.n_codes)
    want = [sum(1 for k, i in rows if k > a or (k == a and i < b)) for a, b in probes]
    assert list(got) == want


@settings(max_examples=200, deadline=None)
@given(rows=st.lists(ids, max_size=40), probes=st.lists(ids, max_size=10))
def test_id_codes_preserve_order_against_probes(rows, probes):
    coder = IdCoder(np.array(probes, dtype=object))
    rc, pc = coder.codes(np.array(rows, dtype=object)), coder.codes(np.array(probes, dtype=object))
    for r, a in zip(rows, rc):
        for p, b in zip(probes, pc):
            assert (r < p) == (a < b) and (r == p) == (a == b)
