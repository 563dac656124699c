"""What is moved or held must not grow faster than the input."""
import random

from pyspark.sql import functions as F

from recurra.operators import similarity as S


def _vectors(spark, n):
    rng = random.Random(11)
    vec = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(n)] + [(n + 1, [1.0] * 6, 0), (n, [0.0] * 6, 1), (None, [1.0] * 6, 1)]
    return vec, spark.createDataFrame(vec, "id long, v array<double>, label int")


def test_vectors_travel_a_bounded_number_of_times(spark):
    _, d = _vectors(spark, 200)
    assert S._blocks(d, "id", 1)[1] == S.GRID                      # was 203 blocks, and every vector went to each of them


def test_half_grid_counts_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 7)
    vec, d = _vectors(spark, 90)
    keyed = [x for x in vec if x[0] is not None]
    want = [(a[0], b[0], a[2] == b[2]) for a in keyed for b in keyed if a[0] < b[0]]
    for block in (16, 2048):
        hist = S.cosine_histogram(d, "id", "v", "label", block).collect()
        assert sum(r.n for r in hist) == len(want) and sum(r.n for r in hist if r.match) == sum(m for *_, m in want)
        pairs = [(r.a, r.b) for r in S.cosine_pairs(d, "id", "v", 0.0, block).collect()]
        assert sorted(pairs) == sorted((a, b) for a, b, _ in want)
        top = S.cosine_topk(d.filter("id < 20"), d.filter("id >= 20"), "id", "v", 3, block).orderBy("qid", "rank").collect()
        assert [(r.qid, r.rank, r.mid) for r in top] == _best(keyed, 3)


def _best(keyed, k):
    import numpy as np

    def cos(x, y):
        x, y = np.array(x), np.array(y)
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return min(1, max(0, x @ y / n)) if n else 0
    out = []
    for q in range(20):
        for qid, v, _ in [x for x in keyed if x[0] == q][:1]:
            s = sorted((-round(cos(v, w), 12), m) for m, w, _ in keyed if m >= 20)[:k]
            out += [(qid, i + 1, m) for i, (_, m) in enumerate(s)]
    return out


def test_pairs_meet_once_in_retrieval(spark):
    """A task and a memory meet in one row, not in one for each word they share."""
    from recurra.operators import retrieval as RET
    rng = random.Random(2)
    some = lambda n: sorted(rng.sample("abcdefghijkl", n))
    mem = [(c, f"m{c}-{i}", rng.randint(0, 9), rng.choice([None, 12, 15]), some(rng.randint(0, 5))) for c in range(2) for i in range(40)]
    ask = [(t, t % 2, rng.randint(1, 20), some(rng.randint(0, 6))) for t in range(60)]
    m = spark.createDataFrame(mem, "chain_id long, loc string, promo_tick int, superseded_tick int, w array<string>")
    q = spark.createDataFrame(ask, "task_id long, chain_id long, ord int, words array<string>")
    for tau in (0.0, 0.3, 0.5, 1.0):
        want = []
        for t, c, o, ws in ask:
            found = sorted((-len(set(ws) & set(mw)) / len(set(ws) | set(mw)), loc) for mc, loc, a, b, mw in mem if mc == c and a < o and (b is None or b >= o) and set(ws) & set(mw))
            want += [(t, loc, -s, i + 1) for i, (s, loc) in enumerate(found[:3]) if -s >= tau]
        got = RET.retrieve(q, RET.postings(m, F.col("w")), 3, tau)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [task_id" not in plan                       # was a shuffled sum over every pair that shares a word
