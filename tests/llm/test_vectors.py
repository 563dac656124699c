"""Exact top-k and multi-index hashing against brute force."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.llm import mih, queries, topk
from recurra.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(ids, x, is_query, k, integer):
    m = np.floor(256 * x) if integer else x
    out = []
    for i in np.nonzero(is_query(ids))[0]:
        s = m @ m[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(s[j]) if integer else float(s[j])) for r, j in enumerate(order)]
    return sorted(out)


def clustered(n, seed=0, dim=8):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[n // 2:n // 2 + n // 3] = x[0]                    # a third of all rows are one vector
    return x


@pytest.mark.parametrize("bins", [4, 1024])
def test_topk_with_ties_and_copies(vectors, bins):
    x = clustered(120)
    ids = np.arange(120)
    df = vectors([(int(i), v.tolist()) for i, v in zip(ids, x)])
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 5 == 0, 7, bins=bins, query_block=10, index_block=16).collect())
    assert got == brute(ids, x.astype(np.float64), lambda i: i % 5 == 0, 7, True)


def odd(vectors):
    nan = float("nan")
    return vectors([(0, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.5, 0.5]), (10, None), (15, [nan, 1.0]), (20, [math.inf, 0.0]), (25, [None, 1.0]), (None, [1.0, 1.0]), (30, [0.0, 0.0]), (8, [1.0])])


def test_topk_of_odd_input(vectors):
    df = odd(vectors)
    rows = topk.exact_topk(df, F.col("vec_id") % 5 == 0, 3).collect()
    assert {r.query_id for r in rows} == {0, 5, 30}                       # zero vectors take part
    assert [(r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, 8, 65536), (2, 7, 32768), (3, 5, 0)]
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 5 == 0, 3).count() == 0
    few = topk.exact_topk(df, F.col("vec_id") % 5 == 0, 50).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {4}                               # all other usable rows


def test_topk_of_large_components(vectors):
    df = vectors([(i, [float(2 ** 20 + i), float(i)]) for i in range(12)])
    x = np.array([[2 ** 20 + i, i] for i in range(12)], np.float32).astype(np.float64)
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 5 == 0, 3).collect())
    m = [[int(v) for v in row] for row in np.floor(256 * x)]
    for q, rank, v, s in got:
        assert s == sum(a * b for a, b in zip(m[q], m[v]))
    assert len(got) == 9


def test_topk_of_components_beyond_64_bits(vectors):
    """One vector of 1e12 does not keep the others from being answered; what does not fit is cut to the largest long."""
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(3).astype(np.float32).tolist()) for i in range(60)]
    rows[10], rows[17], rows[31] = (10, [1e12, 0.5, 0.0]), (17, [-2e12, 1.0, 0.0]), (31, [3e30, 0.0, 1.0])
    got = [tuple(x) for x in topk.exact_topk(vectors(rows), F.col("vec_id") % 5 == 0, 4, query_block=8, index_block=16).collect()]
    m = {i: [math.floor(256 * np.float64(np.float32(x))) for x in v] for i, v in rows}
    end = (1 << 63) - 1
    want = []
    for q in range(0, 60, 5):
        scored = sorted((-max(-end, min(end, sum(a * b for a, b in zip(m[q], m[v])))), v) for v in m if v != q)[:4]
        want += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored)]
    assert sorted(got) == sorted(want)


def shapes():
    r = np.random.default_rng(12)
    centres = r.standard_normal((60, 32))
    near = lambda n, noise: np.vstack([centres[i % 60] + noise * r.standard_normal(32) for i in range(n)])           # noqa: E731
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]                                                          # noqa: E731
    yield "clusters and lone rows", unit(np.vstack([near(2900, 0.15), r.standard_normal((100, 32))])), lambda i: (i >= 2900) | (i % 20 == 0)
    yield "norms that differ", unit(near(2500, 0.4)) * np.exp(r.standard_normal(2500))[:, None], lambda i: i % 20 == 0
    yield "no structure", r.standard_normal((2500, 32)), lambda i: i % 20 == 0


@pytest.mark.parametrize("name,x,is_query", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_mih_recall_of_every_kind_of_query(vectors, name, x, is_query):
    x = x.astype(np.float32)
    ids = np.arange(len(x))
    df = vectors([(int(i), v.tolist()) for i, v in zip(ids, x)])
    asked = [int(i) for i in np.nonzero(is_query(ids))[0]]
    want = brute(ids, x.astype(np.float64), is_query, 20, False)
    got = {(g.query_id, g.vec_id) for g in mih.nearest(df, F.col("vec_id").isin(asked), 20, index_block=1024).collect()}
    hits = {q: 0 for q in asked}
    for q, _, v, _ in want:
        hits[q] += (q, v) in got
    recall = np.array(list(hits.values())) / 20
    assert recall.mean() >= 0.9 and np.quantile(recall, 0.05) >= 0.9


def test_settings_stay_as_they_were(spark):
    spark.range(1).write.format("noop").mode("overwrite").save()                   # some settings appear with the first query
    settings = lambda: {r.key: r.value for r in spark.sql("SET -v").select("key", "value").collect() if r.key.startswith("spark.sql.")}          # noqa: E731
    before = settings()
    for name in ("op3_repair_grammar", "op5_line_dedup", "op9_bpe_automaton", "op2_language_id"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
        after = settings()
        assert {k: after[k] for k in before} == before, name                       # more may have been registered


def test_mih_recall(spark):
    df = table(spark, SF, "embeddings")
    rows = df.toPandas()
    x = np.stack(rows["embedding"].to_list()).astype(np.float64)
    want = brute(rows["vec_id"].to_numpy(), x, lambda i: i % 20 == 0, 20, False)
    got = {(r.query_id, r.vec_id): r.score for r in mih.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()}
    hits = sum((q, v) in got for q, _, v, _ in want)
    assert hits / len(want) >= 0.9
    assert all(abs(got[q, v] - s) < 1e-12 for q, _, v, s in want if (q, v) in got)


def test_mih_copies_come_in_order_of_id(vectors):
    x = clustered(90, 3)
    df = vectors([(int(i), v.tolist()) for i, v in enumerate(x)])
    got = sorted(tuple(r) for r in mih.nearest(df, F.col("vec_id") == 0, 10).collect())
    assert [r[2] for r in got] == list(range(45, 55))


def test_mih_of_odd_input(vectors):
    df = odd(vectors)
    rows = mih.nearest(df, F.col("vec_id") % 5 == 0, 3).collect()
    assert {r.query_id for r in rows} <= {0, 5} and all(r.vec_id not in (30, 10, 15, 20, 25) for r in rows)
    assert mih.nearest(df.limit(0), F.col("vec_id") % 5 == 0, 3).count() == 0


def test_mih_fills_every_query(vectors):
    """Lone vectors beside dense clusters: min(k, candidates) rows for each query, whatever radius the dense part teaches."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((20, 32))
    x = np.vstack([centres[i % 20] + 0.1 * r.standard_normal(32) for i in range(1000)] + [r.standard_normal(32) for _ in range(8)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = vectors([(i, v.tolist()) for i, v in enumerate(x)])
    is_query = (F.col("vec_id") >= 1000) | (F.col("vec_id") % 100 == 0)
    rows = mih.nearest(df, is_query, 20, query_block=4, index_block=256).collect()
    got = {}
    for q in rows:
        got.setdefault(q.query_id, []).append((q["rank"], q.vec_id, q.score))
    assert len(got) == 18
    for q, best in got.items():
        best.sort()
        assert [b[0] for b in best] == list(range(1, 21)) and len({b[1] for b in best}) == 20 and q not in {b[1] for b in best}
        assert [b[2] for b in best] == sorted((b[2] for b in best), reverse=True)
    few = mih.nearest(df.filter("vec_id >= 995"), is_query, 50).groupBy("query_id").count().collect()
    assert {(x.query_id, x["count"]) for x in few} == {(q, 12) for q in range(1000, 1008)}


def test_pigeonhole_finds_every_code_within_the_radius():
    r = np.random.default_rng(1)
    for bits, radius in ((64, 9), (64, 28), (20, 5), (5, 2)):
        model = mih.Codes(np.zeros((3, bits)), 1.0, radius)
        codes = r.integers(0, 1 << 63, 3000, dtype=np.uint64) & np.uint64((1 << bits) - 1)
        codes[:500] = codes[0] ^ np.uint64(1) << r.integers(0, bits, 500, dtype=np.uint64)
        q = codes[0]
        assert sum(t + 1 for t in model.thresholds()) == radius + 1
        assert set(mih.Tables(codes, model).within(q)) == set(np.nonzero(np.bitwise_count(codes ^ q) <= radius)[0])
