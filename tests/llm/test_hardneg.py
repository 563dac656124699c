"""Hard negatives, Hilbert keys and bounds against brute force."""
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from recurra.llm import hardneg, queries
from recurra.llm.blocks import integer_scores

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(n, T.StringType()) for n in ("score", "block", "key", "rank", "w", "aq")]])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def brute(rows, every, positives=5, negatives=5, near=80):
    v = [(i, [math.floor(256 * float(c)) for c in e], b) for i, e, b in rows]
    out = []
    for a, x, b in v:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, c) for i, y, c in v if i != a)
        for ps, pid, _ in [s for s in scored if s[2] == b][:positives]:
            fit = [(s, i) for s, i, c in scored if c != b and near * -ps <= 100 * -s <= 100 * -ps][:negatives]
            out += [(a, pid, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(df, every, **kw):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % every == 0, **kw).select(*cols).collect())


@pytest.mark.parametrize("clustered", [False, True])
def test_mining_equals_brute_force(spark, clustered):
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 6))
    rows = []
    for i in range(400):
        v = centres[i % 12] + 0.15 * r.standard_normal(6) if clustered else r.standard_normal(6)
        if 200 <= i < 330:
            v = centres[0]                                           # a third of all rows are one vector, under several labels
        rows.append((i, np.float32(v / np.linalg.norm(v)).tolist(), int(i % 5 if i % 3 else 0)))
    assert mined(frame(spark, rows), 10, anchor_block=16, row_block=32) == brute(rows, 10)


def test_bounds_leave_blocks_out():
    r = np.random.default_rng(0)
    c = np.repeat(10 * r.standard_normal((40, 8)), 50, axis=0) + 0.1 * r.standard_normal((2000, 8))
    lo, hi = c.reshape(40, 50, 8).min(axis=1), c.reshape(40, 50, 8).max(axis=1)
    a = r.standard_normal((30, 8))
    low, high = hardneg.bounds(a, lo, hi)
    s = (a @ c.T).reshape(30, 40, 50)
    assert (low <= s.min(axis=2)).all() and (s.max(axis=2) <= high).all()
    assert (high >= np.sort(s.reshape(30, -1), axis=1)[:, -5][:, None]).mean() < 0.2


@pytest.mark.parametrize("dim,bits", [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_hilbert_curve_steps_to_neighbours(dim, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dim)).reshape(dim, -1).T
    keys = hardneg.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_mining_of_odd_input(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.0], 2), (3, [0.8], 3), (10, None, 1), (20, [nan, 1.0], 1), (30, [None, 1.0], 1), (40, [1.0, 0.0], None),
            (50, [-1.0, 0.0], 4), (51, [1.0, 0.0], 4), (60, [0.0, 0.0], 6), (61, [0.0, 0.0], 6), (None, [1.0, 1.0], 2), (4, [0.88, 0.0], 2), (4, [0.88, 0.0], 2)]
    usable = [(i, [*e, 0.0][:2], b) for i, e, b in rows if i is not None and e is not None and b is not None and all(x is not None and x == x for x in e)]
    df = frame(spark, rows)
    got = mined(df, 10)
    assert got == brute(usable, 10)
    assert [g[3] for g in got if g[0] == 0] == [4, 4, 2, 3] and not [g for g in got if g[0] == 50] and [g for g in got if g[0] == 60]
    assert mined(df.limit(0), 10) == []
    twice = mined(df.union(frame(spark, rows[:1])), 10)
    assert sorted(g for g in twice if g[0] == 0) == sorted(2 * [g for g in got if g[0] == 0])


def test_mining_of_large_components(spark):
    rows = [(i, [float(np.float32(1e12 + 1e9 * i)), float(i)], i % 2) for i in range(12)] + [(i, [1.0, float(i)], i % 2) for i in range(12, 24)]
    got = mined(frame(spark, rows), 6)
    end = (1 << 63) - 1
    want = brute(rows, 6)
    assert [g for g in got if abs(g[4]) < end and g[0] >= 12] == [w for w in want if abs(w[4]) < end and w[0] >= 12]
    assert all(abs(g[4]) <= end for g in got) and {g[0] for g in got} == {0, 6, 12, 18}


def test_integer_scores_of_any_size():
    r = np.random.default_rng(3)
    end = (1 << 63) - 1
    q = np.floor(r.standard_normal((6, 3)) * np.array([[1], [2 ** 20], [2 ** 28], [2 ** 31], [2 ** 40], [1e300]]))
    c = np.floor(r.standard_normal((5, 3)) * np.array([[1], [2 ** 25], [2 ** 31], [2 ** 33], [1e200]]))
    got = integer_scores(q, c)
    for i in range(6):
        for j in range(5):
            assert got[i, j] == max(-end, min(end, sum(int(a) * int(b) for a, b in zip(q[i], c[j]))))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    df = queries.QUERIES["op12_hilbert_hard_negatives"](spark, "/root/testdata/sf0.01")
    cur = con.execute(queries.SQL["op12_hilbert_hard_negatives"])
    cols = [c[0] for c in cur.description]
    got = sorted(tuple(r) for r in df.select(*cols).collect())
    assert got and got == sorted(cur.fetchall()) and sorted(cols) == sorted(df.columns)
