"""Whitening against numpy, with exact sums in Python integers."""
import math

import numpy as np

from recurra.llm import whitening


def brute(ids, x, components=32):
    q = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in x]
    n = len(q)
    s = [sum(col) for col in zip(*q)]
    apart = [[n * a - b for a, b in zip(v, s)] for v in q]
    c = np.array([[a / n for a in v] for v in apart])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return {i: (sum(a * a for a in d), row) for i, d, row in zip(ids, apart, c @ u / np.sqrt(e))}, e / np.trace(v)


def test_whitening_equals_numpy(vectors):
    r = np.random.default_rng(2)
    x = (r.standard_normal((700, 12)) @ r.standard_normal((12, 12))).astype(np.float32)
    x[300:520] = x[0]                                            # copies
    got = whitening.whiten(vectors([(i, v.tolist()) for i, v in enumerate(x)]), components=5, rows_per_block=64).collect()
    want, share = brute(range(700), x, 5)
    assert len(got) == 700 * 5 and len({(g.vec_id, g.component) for g in got}) == 3500
    sign = {}
    for g in got:
        deviation, row = want[g.vec_id]
        assert g.n == 700 and g.deviation == deviation and g.identity_error < 1e-9
        assert abs(g.explained / share[g.component - 1] - 1) < 1e-9
        a, b = g.whitened, row[g.component - 1]
        s = sign.setdefault(g.component, 1 if a * b > 0 else -1)
        assert abs(a - s * b) < 1e-8
    assert [share[i] >= share[i + 1] for i in range(4)]


def test_whitening_of_odd_input(vectors):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (1, [0.0, 2.0]), (None, [3.0, 1.0]), (1, [0.0, 2.0]), (4, [1.0]), (5, None), (6, [nan, 1.0]), (7, [math.inf, 0.0]), (8, [None, 1.0])]
    got = whitening.whiten(vectors(rows)).collect()
    assert sorted(str(g.vec_id) for g in got) == sorted(2 * ["0", "1", "None", "1", "4"]) and {g.n for g in got} == {5}
    want, _ = brute([0, 1, None, 2, 4], [[1.0, 0.5], [0.0, 2.0], [3.0, 1.0], [0.0, 2.0], [1.0, 0.0]])
    assert {g.deviation for g in got if g.vec_id == 4} == {want[4][0]}
    assert whitening.whiten(vectors(rows[5:])).count() == 0
    assert whitening.whiten(vectors(rows).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(vectors(rows[:1])).collect()             # no variance at all
    assert [(g.deviation, g.whitened, g.explained, g.identity_error) for g in one] == [(0, None, None, None)] * 2
    flat = whitening.whiten(vectors([(i, [float(i), 1.0]) for i in range(6)])).collect()
    assert {g.component for g in flat if g.whitened is None} == {2} and all(g.identity_error < 1e-9 for g in flat)
    big = whitening.whiten(vectors([(0, [3e30, 1.0]), (1, [-3e30, 2.0]), (2, [0.0, 3.0])])).collect()
    assert len(big) == 6 and {g.deviation for g in big if g.vec_id == 0} == {None}
