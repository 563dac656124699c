"""What one task holds is bounded, and what is shuffled does not depend on the settings."""
import random
from dataclasses import replace

from pyspark.sql import functions as F
import pytest

from recurra.operators import embedding as E, intervals as I, sequential as Q, similarity as S
from recurra.operators.consolidate import Policy

POLICY = Policy(min_occurrences=2, min_inputs=2, schedule=2, ttl=6, theta=0.45, rho=0.6, cluster=0.6)


def _records(spark, n=240):
    rng = random.Random(5)
    some = lambda: " ".join(rng.sample("a b c d e f g h".split(), rng.randint(0, 4)))
    rows = [(i % 4 if i % 60 else 9, i, f"2024-01-{1 + i // 12:02d} 00:00:00", i // 12, some(), rng.choice(["bad", "bad", "good"]), f"h{rng.randint(0, 5)}", f"a{i % 3}", f"p{i % 2}") for i in range(n)]
    return spark.createDataFrame(rows, "chain_id long, record_id long, ts string, d int, content string, label string, input_hash string, agent_id string, pattern string").withColumn("ts", F.to_timestamp("ts"))


@pytest.mark.parametrize("limit", [1, 50])
def test_long_chains_fold_as_short_ones(spark, monkeypatch, limit):
    r = _records(spark)
    cells = {"x": POLICY, "y": replace(POLICY, ttl=None, schedule=1, theta=0.35, rho=0.8)}
    items = r.withColumn("item_id", F.col("record_id"))
    want = sorted(map(tuple, Q.consolidate(r, cells).collect()), key=repr), sorted(map(tuple, Q.leader_clusters(items, ["ts", "item_id"], 0.5).collect()))
    monkeypatch.setattr(Q, "CHAIN_ROWS", limit)
    assert want == (sorted(map(tuple, Q.consolidate(r, cells).collect()), key=repr), sorted(map(tuple, Q.leader_clusters(items, ["ts", "item_id"], 0.5).collect())))


def test_records_are_shuffled_once_for_all_settings(spark):
    r = _records(spark)
    plan = Q.consolidate(r, {f"c{i}": replace(POLICY, theta=0.3 + i / 20) for i in range(6)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1             # was a join and rounds over its links, and every record once for each setting


def test_settled_ticks_are_not_gone_through(monkeypatch):
    f, calls = Q.Fold(replace(POLICY, ttl=10_000, schedule=1)), []
    clusters = Q.Fold.clusters
    monkeypatch.setattr(Q.Fold, "clusters", lambda self: calls.append(1) or clusters(self))
    f.ingest(0, "a", frozenset("a"), "bad", "h", "x", "p")
    assert f.advance(9_000) == [] and f.now == 9_000 and len(calls) == 1            # was one for every tick
    assert f.advance(10_001) == [] and not f.entries


@pytest.mark.parametrize("rows,sets", [(1024, 8192), (3, 2)])
def test_nearest_over_blocks(spark, monkeypatch, rows, sets):
    monkeypatch.setattr(S, "NEAR_ROWS", rows)
    monkeypatch.setattr(S, "NEAR_SETS", sets)                       # was a shuffled pair for every text and memory with a common word
    rng = random.Random(3)
    some = lambda: rng.choice([None, "", " ".join(rng.sample("a b c d e f".split(), rng.randint(0, 4)))])
    docs = [(i // 2, some()) for i in range(40)]
    mem = [(i, some()) for i in range(9)]
    want = []
    for k, t in docs:
        found = [] if t is None else sorted((-S_sim(t, m), i) for i, m in mem if m is not None and S_sim(t, m) >= 0.3)
        want.append((k, found[0][1] if found else None, -found[0][0] if found else None))
    got = S.jaccard_nearest(spark.createDataFrame(docs, "k long, t string"), "k", spark.createDataFrame(mem, "m long, t string"), "m", "t", 0.3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def S_sim(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_ranges_meet_few_levels(spark):
    spans = spark.createDataFrame([("p", "f", 5, 9), ("p", "g", 3000, 3100), (None, "h", 1, 9)], "path string, qualname string, start_line int, end_line int")
    r = spark.createDataFrame([(1, "p", 8, 12), (2, "p", 2000, 3050), (3, "q", 0, 3), (4, None, 2, 4), (5, "p", 5000, 6000)], "t int, path string, start_line int, end_line int")
    got = I.range_symbols(r, spans, ["t", "path", "start_line", "end_line"])
    assert sorted((x.t, x.symbol, x.first_line, x.pos) for x in got.collect()) == [
        (1, "<module>", 10, 2), (1, "f", 8, 1), (2, "<module>", 2000, 1), (2, "g", 3000, 2), (3, "<module>", 1, 1), (4, "<module>", 2, 1), (5, "<module>", 5000, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rid" not in plan                       # was a shuffle by the range, and one more for the positions
    last = I.symbol_segments(spans.filter("path = 'p'"), last=F.lit(6000)).agg(F.max("end_line")).first()[0]
    assert last == 6000                                             # was 10^9: every range was repeated for the level of that stretch


def test_hash_vectors_add_up_over_batches(spark):
    docs = spark.createDataFrame([(1, "a b a c d e f"), (2, None), (3, "x y z " * 9), (1, "a q"), (None, "u v")], "k long, t string")
    want = sorted(map(tuple, E.sparse_hash_embedding(docs, "k", "t", 16).collect()), key=repr)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = E.sparse_hash_embedding(docs, "k", "t", 16)
        assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == len({w[:2] for w in want})
        assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()       # was a table of all sums of a task's texts
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("floor", [0.1, 0.5, 0.8])
def test_word_set_join_over_blocks(spark, monkeypatch, floor):
    monkeypatch.setattr(S, "SETS", 20)
    monkeypatch.setattr(S, "MATCHES", 30)
    rng = random.Random(4)
    base = [rng.sample("abcdefghijklmnopqrstuv", rng.randint(0, 12)) for _ in range(25)]
    docs = [(i, " ".join(rng.sample(b, max(0, len(b) - rng.randint(0, 3))) + rng.sample("wxyz", rng.randint(0, 2)))) for i, b in enumerate(base * 3)]
    m, s = S.word_sets(spark.createDataFrame(docs, "k long, t string"), "k", "t")
    first = {r.sid: r.k for r in m.groupBy("sid").agg(F.min("k").alias("k")).collect()}
    text = dict(docs)
    ids = sorted(first.values())
    want = sorted((a, b) for a in ids for b in ids if a < b and S_sim(text[a], text[b]) >= floor)
    got = S.jaccard_set_join(s, s, floor, self_join=True).collect()
    assert sorted(tuple(sorted((first[r.sid_l], first[r.sid_r]))) for r in got) == want
    both = S.jaccard_set_join(s, s, floor).collect()
    assert sorted((first[r.sid_l], first[r.sid_r]) for r in both) == sorted([(a, b) for a in ids for b in ids if S_sim(text[a], text[b]) >= floor])


def test_index_of_asked_words(spark):
    from recurra.operators import search as SE
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d d"), (3, None), (4, "e")], "k long, t string")
    asked = spark.createDataFrame([(1, "B d"), (2, None), (3, "zz")], "qid long, text string")
    whole, part = SE.build_index(docs, "k", "t"), SE.build_index(docs, "k", "t", asked)
    assert {r.word for r in part[0].collect()} == {"b", "d"}          # was a posting for every word of every text
    assert sorted(map(tuple, SE.search(asked, part, 2)[0].collect())) == sorted(map(tuple, SE.search(asked, whole, 2)[0].collect()))


@pytest.mark.parametrize("floor", [0.3, 0.5, 1.0])
def test_word_set_join_moves_no_sets(spark, monkeypatch, floor):
    for name, value in (("SETS", 16), ("MATCHES", 50), ("WORDS", 600), ("BUCKETS", 64)):
        monkeypatch.setattr(S, name, value, raising=False)
    rng = random.Random(9)
    base = [rng.sample(range(400), rng.choice([1, 2, 5, 30, 120])) for _ in range(30)]
    sets = [[f"w {w}\0" for w in rng.sample(b, max(1, len(b) - rng.randint(0, len(b) // 2)))] for b in base * 3] + [[], [" "], None]
    rows = [(bytes([i]), ws, 0 if ws is None else len(ws)) for i, ws in enumerate(sets)]
    s = spark.createDataFrame(rows + [(None, ["x"], 1)], "sid binary, ws array<string>, n int")
    got = S.jaccard_set_join(s, s, floor, self_join=True)
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()       # was a grid that sent each prefix to 33 tasks, and sets once a candidate
    full = [(i, set(ws)) for i, ws in enumerate(sets) if ws]
    want = [(i, j, len(a & b), len(a | b)) for i, a in full for j, b in full if i < j and len(a & b) / len(a | b) >= floor]
    found = [(*sorted((r.sid_l[0], r.sid_r[0])), r.inter, r.union) for r in got.collect()]
    assert sorted(found) == want and (want or floor == 1)


def test_task_lines_hold_what_the_views_say(spark):
    from recurra.plans import consolidate as P
    from recurra.plans.bindings import ARMS, Tables
    rng = random.Random(6)
    t = Tables(spark, "/nowhere")
    some = lambda *x: rng.choice(x)
    t._raw = {
        "nation": spark.createDataFrame([(1, "A"), (2, None)], "n_nationkey int, n_name string"),
        "customer": spark.createDataFrame([(1, 1), (2, 2), (3, None)], "c_custkey long, c_nationkey int"),
        "orders": spark.createDataFrame([(i, some(1, 1, 2, 3, 9), some("2024-01-05", "2024-02-07")) for i in range(30)] + [(4, 1, "2024-03-01"), (None, 1, "2024-03-01")], "o_orderkey long, o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_timestamp("o_orderdate")),
        "part": spark.createDataFrame([(i, some("X Y", "Z", None), some("Brand#11", "Brand#21", "Z")) for i in range(8)] + [(3, "W", "Brand#11")], "p_partkey long, p_type string, p_brand string"),
        "lineitem": spark.createDataFrame([(some(*range(28), None), some(*range(9), None), i % 4, i, some(1.0, 2.0), some(3.0, None), some(0.1, 0.2, 0.3), some("R", "N", "N", None)) for i in range(120)],
                                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string")}
    tasks, (parts, names) = P.stored_tasks(t), P.numbered_keys(t)
    whole = P.task_lines(t, tasks, parts)
    text = {r.key: r.fkey for r in names.collect()}
    assert [text[k] for k in sorted(text)] == sorted({r.fkey for r in t.keys.collect()})
    gold = {(r.task_id, r.fkey) for r in t.gold.collect()}
    held = {r.o_orderkey for r in t.tasks.select(F.col("task_id").alias("o_orderkey")).collect()} - {None}
    want = sorted((r.arm, r.task_id, r["rank"], r.fkey, (r.task_id, r.fkey) in gold, any(r.task_id == g for g, _ in gold)) for r in t.pred.collect() if r.task_id in held)
    got = sorted((r.arm, r.task_id, r["rank"], text[r.key], r.ok, r.known) for r in P.arm_flags(whole.filter("copy = 1"), *ARMS).collect())
    assert got == want and len(want) > 100
    word = {w: x for r in names.collect() for w, x in zip((r.w1, r.w2), r.fkey.split("::"))}
    said = {}
    for r in t.ln.filter("l_returnflag <> 'R'").collect():
        said.setdefault(r.task_id, set()).update(r.fkey.split("::"))
    for r in whole.collect():
        assert {word[w] for x in r.lines if x.truth is False for w in (x.w1, x.w2)} == said.get(r.task_id, set())
        assert {(r.task_id, text[k]) for k in r.gold} == {g for g in gold if g[0] == r.task_id}
    assert sorted((r.task_id, r.chain_id or "", r.ord) for r in whole.collect()) == sorted((r.task_id, r.chain_id or "", r.ord) for r in tasks.collect() if r.task_id in {x.task_id for x in t.ln.collect()} - {None})


def test_first_flags_are_shuffled_once(spark):
    from recurra.operators import retrieval as RET
    rng = random.Random(8)
    flags = [(t, r, f"k{rng.randint(0, 5)}", rng.random() < .5) for t in range(20) for r in (1, 2, 3)] + [(3, 4, None, True)]
    marks = lambda: [(t, f"k{rng.randint(0, 5)}") for t in range(20) for _ in range(rng.randint(0, 2))] + [(99, "k1"), (3, None)]
    got, sham = marks(), marks()
    frame = lambda rows: spark.createDataFrame(rows, "task_id long, loc string")
    first = RET.guided_first(spark.createDataFrame(flags, "task_id long, rank int, key string, ok boolean"), frame(got), frame(sham))
    assert first._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1       # marks, flags and joined rows were shuffled one after the other
    by = lambda held, t: min(((t, k) not in held or k is None, r, ok) for u, r, k, ok in flags if u == t)[2]
    assert sorted(map(tuple, first.collect())) == sorted((t, int(by(set(), t)), int(by(set(got), t)), int(by(set(sham), t))) for t in range(20))


def test_a_task_of_two_rows_is_evaluated_by_the_later_one(spark):
    from recurra.plans import consolidate as P
    from recurra.plans.bindings import Tables
    t = Tables(spark, "/nowhere")
    line = "struct<key:long,w1:long,w2:long,truth:boolean,control:int,treatment:int,placebo:int>"
    lines = [(1, 2, 3, True, 1, 2, 1), (4, 2, 5, False, 2, 1, 2)]
    whole = spark.createDataFrame([(7, "A", 1, 1, [1], lines), (7, "A", 2, 2, [1], lines), (8, "A", 3, 1, [], lines[1:])], f"task_id long, chain_id string, ord int, copy int, gold array<long>, lines array<{line}>")
    names = spark.createDataFrame([(1, 2, 3), (4, 2, 5)], "key long, w1 long, w2 long")
    memories = spark.createDataFrame([("A", 4, 1)], "chain_id string, loc long, promo_tick long")
    r = P.evaluated(t, whole, "ord > 1", names, memories).first()
    assert (r.n_eval, r.control_hits, r.injected, r.useful, r.control_top1, r.memory_top1) == (1, 1, 1, 0, 1, 0)
