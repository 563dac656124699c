"""Consolidation against a literal record-at-a-time state machine, skew, and the stream."""
import random
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from recurra.functions.running import asof_latest, position, running
from recurra.operators import consolidate as C, sequential as Q
from recurra.operators.consolidate import Policy
from recurra.streaming import consolidation as S

SCHEMA = "chain_id long, record_id long, ts timestamp, d int, loc string, content string, label string, input_hash string, agent_id string"


def stream(spark, n=400, chains=3, days=20, seed=1):
    import datetime as dt
    rng = random.Random(seed)
    out = []
    for i in range(n):
        d = i * days // n
        loc = f"k{rng.randint(0, 5)}"
        words = [loc, rng.choice("abc"), rng.choice("xy"), "of"]
        out.append((rng.randint(1, chains), i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=i), d, loc, " ".join(words), rng.choice(["bad", "bad", "good", "unknown"]), f"in{rng.randint(0, 3)}-{d // 2}", rng.choice(["a1", "a2"])))
    return spark.createDataFrame(out, SCHEMA), out


def machine(data, p: Policy, last, sim):
    """Every record of a chain against everything buffered or promoted in that chain."""
    outcomes, promos = {}, []
    for chain in sorted({r[0] for r in data}):
        buf, mem, now = [], [], 0

        def tick():
            nonlocal buf, now
            now += 1
            if p.ttl is not None:
                buf = [e for e in buf if now - e["ins"] < p.ttl]
            if now % p.schedule == 0:
                cl = []
                for e in buf:
                    for c in cl:
                        if sim(e["r"], c[0]["r"]) >= p.cluster:
                            c.append(e)
                            break
                    else:
                        cl.append([e])
                for c in cl:
                    el = [r for e in c for r in e["sup"] if r[6] in p.labels]
                    if len(el) >= p.min_occurrences and len({r[7] for r in el}) >= p.min_inputs and p.approver not in {r[8] for r in el}:
                        promos.append((chain, now, c[0]["r"][5], len(el)))
                        mem.append(c[0]["r"])
                        buf = [e for e in buf if e not in c]
        for r in sorted((x for x in data if x[0] == chain), key=lambda x: (x[2], x[1])):
            while now < r[3]:
                tick()
            best, who = 0.0, None
            for e in buf:
                if sim(r, e["r"]) > best:
                    best, who = sim(r, e["r"]), e
            for m in mem:
                if sim(r, m) > best:
                    best, who = sim(r, m), None
            if 1 - best > p.theta:
                buf.append({"r": r, "ins": r[3], "sup": [r]})
                outcomes[r[1]] = "buffered"
            elif who is not None and best >= (p.rho if p.rho is not None else 1 - p.theta):
                who["sup"].append(r)
                outcomes[r[1]] = "reinforced"
            else:
                outcomes[r[1]] = "discarded"
        while now < last:
            tick()
    return outcomes, promos


def keyed(a, b):
    return 1.0 if a[4] == b[4] else 0.0


def words(a, b):
    x, y = set(a[5].split()), set(b[5].split())
    return len(x & y) / len(x | y)


BASE = Policy(min_occurrences=2, min_inputs=2, schedule=1, ttl=None)


@pytest.mark.parametrize("schedule,mi", [(1, 2), (3, 2), (5, 3), (10, 2)])
def test_closed_form_equals_machine(spark, schedule, mi):
    df, data = stream(spark)
    p = replace(BASE, schedule=schedule, min_inputs=mi)
    want, promos = machine(data, p, 20, keyed)
    pm = C.promotion_ticks(df, p, 20)
    assert dict(rows(C.outcomes(df.repartition(7), pm), "record_id", "outcome")) == want
    assert rows(pm, "chain_id", "promo_tick") == sorted(((c, t) for c, t, _, _ in promos), key=repr)


@pytest.mark.parametrize("ttl,schedule", [(3, 1), (5, 3), (2, 2), (10, 10)])
def test_fold_with_expiry_equals_machine(spark, ttl, schedule):
    df, data = stream(spark, n=250, seed=4)
    p = replace(BASE, ttl=ttl, schedule=schedule)
    want, promos = machine(data, p, 20, keyed)
    st = C.ttl_states(df, p, 20)
    assert dict(rows(C.ttl_outcomes(df, st), "record_id", "outcome")) == want
    got = st.filter("promo_tick is not null")
    assert rows(got, "chain_id", "promo_tick") == sorted(((c, t) for c, t, _, _ in promos), key=repr)
    sup = C.support_rows(df, got.select("chain_id", "loc", "promo_tick", "from_tick"), p).groupBy("chain_id", "loc").count()
    assert sorted(r[2] for r in sup.collect()) == sorted(n for *_, n in promos)


def test_separation_of_duties(spark):
    df, data = stream(spark)
    p = replace(BASE, approver="a1")
    want, _ = machine(data, p, 20, keyed)
    assert dict(rows(C.outcomes(df, C.promotion_ticks(df, p, 20)), "record_id", "outcome")) == want


@pytest.mark.parametrize("theta,rho,cluster,ttl,schedule", [(.45, None, .6, None, 1), (.35, .8, .5, 4, 2), (.6, .9, .9, 6, 3)])
def test_word_similarity_equals_machine(spark, theta, rho, cluster, ttl, schedule):
    df, data = stream(spark, n=200, seed=9)
    p = replace(BASE, theta=theta, rho=rho, cluster=cluster, ttl=ttl, schedule=schedule)
    want, promos = machine(data, p, 20, words)
    out = Q.consolidate(df.withColumn("pattern", F.col("loc")), {"x": p}, 20).cache()
    assert dict(rows(out.filter("kind = 'record'"), "record_id", "outcome")) == want
    assert rows(out.filter("kind = 'promotion'"), "chain_id", "tick", "content") == sorted(((c, t, x) for c, t, x, _ in promos), key=repr)


def test_gate_rules(spark):
    def recs(labels, inputs, agent="v"):
        return spark.createDataFrame([(1, i, None, i, "k", "c", lb, inp, agent) for i, (lb, inp) in enumerate(zip(labels, inputs))], SCHEMA)
    p = Policy()
    why = lambda df, pol=p, con=None: C.gate_reasons(df, pol, con).head().reason
    assert why(recs(["bad"] * 3, "abc")) == ""
    assert why(recs(["bad"] * 2, "ab")) == "too_few_records"
    assert why(recs(["bad", "bad", "good", "unknown"], "abcd")) == "too_few_records"
    assert why(recs(["bad"] * 3, "aaa")) == "too_few_inputs"
    assert why(recs(["bad"] * 3, "abc", p.approver)) == "own_approval"
    assert why(recs(["bad"] * 3, "abc"), p, recs(["good"], "z")) == "conflict"


def test_rho_band(spark):
    base = " ".join(f"w{i}" for i in range(10))
    other = " ".join([f"w{i}" for i in range(10)] + ["p", "q", "r"])
    df = spark.createDataFrame([(1, i, None, 0, "k", c, "bad", str(i), "v") for i, c in enumerate([base, base, other])], SCHEMA).withColumn("ts", F.timestamp_seconds("record_id")).withColumn("pattern", F.lit("p"))
    out = Q.consolidate(df, {"x": Policy(theta=.6, rho=.9)}, 1)
    assert rows(out.filter("kind = 'record'"), "record_id", "outcome") == [(0, "buffered"), (1, "reinforced"), (2, "discarded")]


def test_running_equals_plain_window_on_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 50).alias("g"), "id", (F.col("id") % 3).alias("v"))
    w = Window.partitionBy("g").orderBy("id")
    plain = df.select("g", "id", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.row_number().over(w).alias("p"))
    cut = position(running(df, ["g"], ["id"], "id div 256", {"s": F.col("v")}), ["g"], ["id"], "id div 256", "p")
    assert rows(cut, "g", "id", "s", "p") == rows(plain, "g", "id", "s", "p")
    marks = df.withColumn("m", F.when(F.col("id") % 7 == 0, F.col("id")))
    want = marks.select("g", "id", F.max("m").over(w).alias("x"))
    assert rows(asof_latest(marks, ["g"], ["id"], "id div 256", "m", "x"), "g", "id", "x") == rows(want, "g", "id", "x")


def test_stream_equals_batch(spark, tmp_path):
    df, _ = stream(spark, n=240, seed=2)
    p = replace(BASE, ttl=5, schedule=2)
    src = tmp_path / "in"
    closing = df.limit(1).select(F.lit(99).cast("long").alias("chain_id"), F.lit(10_000).cast("long").alias("record_id"), F.lit("2024-02-20").cast("timestamp").alias("ts"), F.lit(50).alias("d"), F.lit("end").alias("loc"), "content", "label", "input_hash", "agent_id")
    for i in range(4):
        df.filter(F.col("d").between(i * 5, i * 5 + 4)).coalesce(1).write.mode("append").parquet(str(src))
    closing.coalesce(1).write.mode("append").parquet(str(src))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = S.consolidate_stream(live, p, "2024-01-01", "0 seconds", 20)
    S.run_available(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("chain_id <> 99")
    st = C.ttl_states(df, p, 20)
    assert rows(got.filter("kind = 'record'"), "record_id", "outcome") == rows(C.ttl_outcomes(df, st), "record_id", "outcome")
    assert rows(got.filter("kind = 'promotion'"), "chain_id", "loc", "tick") == rows(st.filter("promo_tick is not null"), "chain_id", "loc", "promo_tick")


def test_epoch_append_is_idempotent(spark, tmp_path):
    write = S.append_by_epoch(str(tmp_path), lambda b: {"rows": b})
    b = spark.range(3).toDF("id")
    for epoch in (0, 0, 1):
        write(b, epoch)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 6


def test_rows_without_a_location_are_kept(spark):
    df, _ = stream(spark, n=80, seed=5)
    df = df.withColumn("loc", F.when(F.col("record_id") % 4 != 0, F.col("loc")))
    p = replace(BASE, ttl=6)
    assert C.outcomes(df, C.promotion_ticks(df, p)).count() == df.count()
    assert C.ttl_outcomes(df, C.ttl_states(df, p)).count() == df.count()


@pytest.mark.parametrize("conflict", [False, True])
def test_approver_and_conflicts_hold_under_expiry_and_in_streams(spark, tmp_path, conflict):
    df, _ = stream(spark, n=200, seed=6)
    p = replace(BASE, ttl=1000, schedule=2, approver="v")
    against = C.conflicts(df, p) if conflict else None
    closed = C.promotion_ticks(df, p, contradicting=against)
    fold = C.ttl_states(df, p, contradicting=against).filter("promo_tick is not null")
    assert rows(fold, "chain_id", "loc", "promo_tick") == rows(closed, "chain_id", "loc", "promo_tick")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    S.run_available(S.consolidate_stream(live, p, "2024-01-01", "0 seconds", contradictions=conflict), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("kind = 'record'")
    assert rows(got, "record_id", "outcome") == rows(C.ttl_outcomes(df, C.ttl_states(df, p, contradicting=against)), "record_id", "outcome")


def test_calendar_goes_on_beyond_a_month(spark):
    far = spark.createDataFrame([(1, i, None, 400 + i, "k", "c", "bad", f"i{i}", "v") for i in range(3)], SCHEMA).withColumn("ts", F.timestamp_seconds("record_id"))
    assert rows(C.promotion_ticks(far, replace(BASE, min_occurrences=3, min_inputs=3, schedule=1)), "promo_tick") == [(403,)]
    assert rows(C.ttl_states(far, replace(BASE, min_occurrences=3, min_inputs=3, schedule=1, ttl=50)), "promo_tick") == [(403,)]
