"""Small exact cases."""
import pytest
from conftest import rows
from pyspark.sql import functions as F

from recurra.functions import dates, digest, keys, text as X
from recurra.operators import chains as C, consolidate as K, gates as G, intervals as I, ledger as L, memory as MEM, metrics as M, paired as P, recurrence as R, retrieval as RET, sections as D, similarity as S, causal as V
from recurra.sources import memo, records as SRC, state


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


# -- sources and gates ---------------------------------------------------------------------
def test_freshness(spark):
    cut = spark.createDataFrame([("a", "2025-03-01"), ("b", "2025-06-30")], "model string, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    tasks = spark.createDataFrame([("1", "2025-06-30"), ("2", "2025-07-01T10:00:00Z"), ("3", None), ("4", "2025-05-01"), ("5", "2025-07-05")], "instance_id string, created string")
    v = {r.instance_id: (r.admitted, r.reason) for r in G.freshness_verdicts(tasks, cut, "created").collect()}
    assert v["1"] == (False, "2025-06-30 <= cutoff 2025-06-30 (+0d)")
    assert v["2"][0] and v["5"][0] and not v["4"][0]
    assert v["3"] == (False, "missing or unparseable created")
    got = lambda m: {r.instance_id: r.admitted for r in G.freshness_verdicts(tasks, cut, "created", m).collect()}["5"]
    assert got(10) is False and got(4) is True
    with pytest.raises(Exception, match="no cut-offs"):
        G.latest_cutoff(cut.limit(0)).collect()
    with pytest.raises(Exception, match="unreadable"):
        G.latest_cutoff(cut.withColumn("cutoff", F.when(F.col("model") == "a", F.col("cutoff")))).collect()


def test_dedup_and_required(spark):
    d = spark.createDataFrame([("1", 0, "first"), ("1", 1, "second"), ("2", 2, "x")], "id string, ord int, v string")
    assert rows(SRC.keep_first(d, ["id"], ["ord"]), "id", "v", "n_dropped") == [("1", "first", 1), ("2", "x", 0)]
    r = SRC.check_required(spark.createDataFrame([("a", ""), ("b", "t")], "id string, t string"), ["id", "t"])
    assert rows(r, "id", "ok", "reason") == [("a", False, "missing t"), ("b", True, "")]


def test_broken_json_is_kept(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"instance_id": "1", "repo": "r"}\n{broken\n')
    df = SRC.read_records(spark, str(tmp_path / "x.jsonl"), SRC.TASK_SCHEMA).cache()
    assert df.count() == 2 and df.filter(F.col(SRC.CORRUPT).isNotNull()).count() == 1


def test_write_with_verdicts(spark, tmp_path):
    d = spark.createDataFrame([("a", True, "fresh"), ("b", False, "old")], "instance_id string, admitted boolean, reason string")
    SRC.write_with_verdicts(d, ["instance_id", "admitted", "reason"], F.col("admitted"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o/accepted")).count() == 1
    assert spark.read.json(str(tmp_path / "o/verdicts")).count() == 2


def test_version_audit(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(["Old_Pkg==1.0", "new==2.0", "who==3", "# note"])], "task_id int, line string").withColumn("cutoff", F.lit("2024-01-01").cast("date"))
    rel = spark.createDataFrame([("old-pkg", "1.0", "2023-01-01"), ("new", "2.0", "2024-02-01")], "name string, version string, released string").withColumn("released", F.to_date("released"))
    assert rows(G.asof_audit(lines, rel), "name", "reason") == [("new", "released 2024-02-01 > cutoff 2024-01-01"), ("who", "unknown release date")]


def test_memo_second_run_has_no_misses(spark):
    req = spark.createDataFrame([("a",), ("b",), ("a",)], "t string").withColumn("key", memo.memo_key("len", F.col("t")))
    empty = spark.createDataFrame([], "key string, value int")
    first = memo.extend_memo(req, empty, F.length("t"))
    assert rows(first, "status") == [("miss",), ("miss",)]
    assert rows(memo.extend_memo(req, first.select("key", "value"), F.length("t")), "status") == [("hit",), ("hit",)]


# -- text and keys ----------------------------------------------------------------------------
def test_text(spark):
    c = lambda *a: X.record_content(*[F.lit(x) for x in a])
    r = one(spark, c("Totals change after midnight", "shop/billing.py", "", "time zone ignored").alias("a"), c("refund twice", "shop/billing.py", "refund", "retried call").alias("b"))
    assert r.a == "Totals change after midnight => shop / billing :: time zone ignored"
    assert r.b == "refund twice => shop / billing # refund :: retried call"
    r = one(spark, X.location_in(F.lit(r.b)).alias("l"), X.clean_message(F.lit("Round up refunds (#804)"), F.lit("cents were lost\nSigned-off-by: k")).alias("m"), X.coerce_list(F.lit('["a","b"]')).alias("j"), X.coerce_list(F.lit("x")).alias("s"), X.coerce_list(F.lit("")).alias("e"))
    assert (r.l, r.m, r.j, r.s, r.e) == ("shop / billing # refund", "Round up refunds\n\ncents were lost", ["a", "b"], ["x"], [])


def test_keys(spark):
    k = F.lit("shop/cart.py::Cart.total")
    r = one(spark, keys.file_of(k).alias("f"), keys.class_of(k).alias("c"), keys.dir_of(k).alias("d"), keys.dir_of(F.lit("x/y/z.py")).alias("p"), keys.dir_of(F.lit("z.py")).alias("q"), keys.image_name(F.lit("Shop__Web")).alias("i"), keys.group_from_file(F.lit("shop__web__main")).alias("g"))
    assert tuple(r) == ("shop/cart.py", "shop/cart.py::Cart", "shop/cart.py", "x/y", ".", "shop_1776_web", "shop/web__main")


def test_dates(spark):
    r = one(spark, dates.literal_date(F.lit("2024-06-30T23:30:00-05:00")).cast("string").alias("a"), dates.literal_date(F.lit("x")).alias("b"), dates.cutoff_from_epoch(F.lit(1_700_000_000)).cast("string").alias("c"))
    assert tuple(r) == ("2024-06-30", None, "2023-11-14")


def test_set_digest_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("y",)], "v string")
    d = lambda df: df.agg(digest.set_digest(F.col("v")).alias("d")).head().d
    assert d(a) == d(a.orderBy(F.desc("v")).repartition(3)) != d(a.limit(1))


# -- chains and recurrence -----------------------------------------------------------------------
def tasks(spark, ids, repo="r"):
    d = spark.createDataFrame([(i, repo, repo, f"2024-01-{i + 1:02d}") for i in ids], "task_id long, chain_id string, grp string, created_at string").withColumn("created_at", F.to_date("created_at"))
    return C.chain_positions(d, "chain_id", "created_at", "task_id", "trunc(created_at, 'month')")


def test_chains(spark):
    d = spark.createDataFrame([("a3", "a", "2024-01-03"), ("b1", "b", "2024-01-01"), ("a1", "a", "2024-01-01"), ("a2", "a", "2024-01-02")], "task string, chain string, created string").withColumn("created", F.to_date("created"))
    pos = C.chain_positions(d, "chain", "created", "task", "created")
    assert rows(pos, "chain", "ord", "task") == [("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, "a3"), ("b", 1, "b1")]
    assert rows(C.chain_table(d, "chain", "created"), "chain", "span_days") == [("a", 2), ("b", 0)]
    n = spark.createDataFrame([("a", 7), ("b", 1)], "chain string, n long")
    s = C.chain_stats(n, "n", (5,), 6).head()
    assert (s.n_chains, s.ge_5, s.n_eligible, s.median_len) == (2, 1, 1, 4.0)
    assert C.upper_median(n, "n").head().upper_median == 7


def test_prefix_recurrence(spark):
    t = tasks(spark, range(8)).withColumn("n_chain", F.col("chain_len"))
    gold = spark.createDataFrame([(i, "pkg/a.py" if i % 2 == 0 else f"pkg/b{i}.py") for i in range(8)], "task_id long, fkey string")
    r = R.recurrence_by_prefix(t, gold, "chain_id", [4]).head()
    assert (r.keys_ge3, r.keys_ge2, r.dirs_ge3, r.n_eval, r.key_seen1, r.dir_seen3) == (0, 1, 1, 4, 2, 4)


def test_fine_level_recurrence(spark):
    t = tasks(spark, range(6)).withColumn("n_chain", F.col("chain_len"))
    gold = spark.createDataFrame([(i, "m.py::" + ("parse", "dump")[i % 2]) for i in range(6)], "task_id long, fkey string")
    r = R.recurrence_by_prefix(t, gold, "chain_id", [4]).head()
    assert (r.keys_ge2, r.distinct_keys, r.key_seen2, r.dir_seen1, r.distinct_dirs) == (2, 2, 2, 2, 1)


def test_prequential(spark):
    gold = spark.createDataFrame(list(enumerate(["shop/cart.py::" + k for k in ("Cart.add", "Cart.add", "Cart.drop", "Cart.add", "tax", "Cart.drop", "Cart.add")])), "task_id long, fkey string")
    out = {r.level: r for r in R.prequential(tasks(spark, range(7)), gold, 3, 3, "trunc(created_at, 'month')").filter("grp is null").collect()}
    f, c, p = out["function"], out["class"], out["file"]
    assert (f.n_eval, f.seen1_rate, f.seen2_rate, c.seen2_rate, p.seen2_rate) == (4, .75, .5, .75, 1.0)


# -- patches and intervals ---------------------------------------------------------------------------
PATCH = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -10,7 +10,8 @@ def f():
 x
@@ -40 +41 @@
-y
diff --git a/tests/test_a.py b/tests/test_a.py
--- a/tests/test_a.py
+++ b/tests/test_a.py
@@ -0,0 +1,3 @@
+z
diff --git a/old.py b/new.py
--- a/old.py
+++ b/new.py
@@ -1,2 +1,2 @@
"""


def test_patch(spark):
    p = spark.createDataFrame([("t", PATCH), ("u", PATCH[PATCH.index("diff --git a/tests"):PATCH.index("diff --git a/old")])], "id string, patch string")
    h = rows(D.patch_hunks(p.filter("id = 't'"), "id", "patch"), "path", "start_line", "end_line")
    assert h == [("new.py", 1, 2), ("src/a.py", 10, 16), ("src/a.py", 40, 40), ("tests/test_a.py", 0, 0)]
    g = {r.id: r["keys"] for r in D.gold_keys(p, "id", "patch", (".py",)).collect()}
    assert g == {"t": ["new.py", "src/a.py"], "u": None}
    assert {r.id: r["keys"] for r in D.gold_keys(p, "id", "patch").collect()}["u"] == []
    assert D.independent_files(p, "id", "patch").filter("id = 't'").head()["keys"] == ["new.py", "old.py", "src/a.py"]


SPANS = [("load", 3, 7), ("Ledger", 10, 30), ("Ledger.open", 12, 15), ("Ledger.close", 19, 27), ("report", 33, 40)]


def spans(spark):
    return spark.createDataFrame([("store.py", *s) for s in SPANS], "path string, qualname string, start_line int, end_line int")


def test_innermost_and_range(spark):
    pts = spark.createDataFrame([("store.py", x) for x in (5, 17, 8, 20)], "path string, line int")
    assert rows(I.innermost(pts, spans(spark), []), "line", "qualname") == [(17, "Ledger"), (20, "Ledger.close"), (5, "load"), (8, "<module>")]
    r = spark.createDataFrame([(1, "store.py", 6, 13), (2, "store.py", 41, 41), (3, "none.py", 5, 6)], "id int, path string, start_line int, end_line int")
    got = [(x.id, x.symbol) for x in I.range_symbols(r, spans(spark), ["id"]).orderBy("id", "pos").collect()]
    assert got == [(1, "load"), (1, "<module>"), (1, "Ledger"), (1, "Ledger.open"), (2, "<module>"), (3, "<module>")]
    loc = rows(I.symbolise(r, spans(spark), ["id"]).filter("id <> 1"), "id", "path", "start_line", "end_line", "symbol")
    assert loc == [(2, "store.py", 41, 41, "<module>"), (3, "none.py", 5, 6, "<module>")]


def test_overlap_symbols_and_whole_file(spark):
    a = spark.createDataFrame([(1, "p", 1, 5, "f"), (2, "p", 1, 5, "<module>"), (3, "p", 1, 5, ""), (4, "p", 1, 10 ** 9, ""), (5, "q", 1, 5, "g")], "id int, path string, start_line int, end_line int, symbol string")
    b = spark.createDataFrame([("p", 5, 9, "g")], "path string, start_line int, end_line int, symbol string")
    assert rows(I.overlap_join(a, b, symbols=True, bin_width=4), "id") == [(3,), (4,)]
    far = spark.createDataFrame([("p", 7, 9, "")], "path string, start_line int, end_line int, symbol string")
    assert rows(I.overlap_join(a.filter("id = 1"), far, symbols=True), "id") == []
    assert rows(I.overlap_join(a.filter("id = 1"), far, slack=2, symbols=True), "id") == [(1,)]


# -- metrics -------------------------------------------------------------------------------------------
def pred(spark, lists, arm="control"):
    return spark.createDataFrame([(arm, t, i + 1, k) for t, ks in lists.items() for i, k in enumerate(ks)], "arm string, task_id string, rank int, fkey string")


def gold(spark, g):
    return spark.createDataFrame([(t, k) for t, ks in g.items() for k in ks], "task_id string, fkey string")


def test_hit_at_k(spark):
    p = pred(spark, {"a": "qxr", "b": "q", "zz": "w"})
    out = {r.k: r for r in M.hit_at_k(p, gold(spark, {"a": "x", "b": "yz"}), (1, 3), p).collect()}
    assert (out[1].n, out[1].hit) == (2, 0)
    assert (out[3].hit, out[3].hit_at_k, out[3].flags, out[3].false_positive_rate, out[3].missing_gold) == (1, .5, 4, .75, 1)


def test_null_truth_leaves_the_metric(spark):
    p = pred(spark, {"a": "x", "docs": "x"})
    per = M.hits(M.outcomes(p, gold(spark, {"a": "x"}))).withColumn("grp", F.lit("r"))
    r = M.arm_metrics(per).filter("grp is null").head()
    assert (r.n_tasks, r.n_localized) == (1, 1)
    assert rows(M.label_outcomes(p, gold(spark, {"a": "x"})), "task_id", "label") == [("a", "bad"), ("docs", "unknown")]


def test_paired(spark):
    f = pred(spark, {"1": "g", "2": "x", "3": "g", "4": "x"}).unionByName(pred(spark, {"1": "g", "2": "g", "3": "x", "4": "x"}, "treatment"))
    pairs = P.pair_arms(M.outcomes(f, gold(spark, {t: "g" for t in "1234"}))).withColumn("retrieved", F.col("task_id") != "4").withColumn("grp", F.lit("r"))
    r = P.summarise_pairs(P.pair_counts(pairs, ["grp"])).head()
    assert (r.both_hit, r.treatment_only, r.control_only, r.neither_hit, r.lift_pts, r.differed, r.retrieved) == (1, 1, 1, 1, 0.0, 2, 3)


def test_mcnemar_and_wald(spark):
    d = spark.createDataFrame([(0, 0), (5, 5), (0, 5), (10, 17), (15, 19)], "b long, c long")
    p = [round(r[0], 4) for r in d.select(P.mcnemar_p(F.col("b"), F.col("c"))).collect()]
    assert p == [1.0, 1.0, 0.0625, 0.2478, 0.6076]
    big = spark.createDataFrame([(10 ** 7, 10 ** 7 + 9000)], "b long, c long").select(P.mcnemar_p(F.col("b"), F.col("c"))).head()[0]
    assert abs(big - 0.0442) < 1e-3
    lo, hi = P.wald_interval(F.lit(100), F.lit(10), F.lit(14))
    r = one(spark, lo.alias("lo"), hi.alias("hi"))
    assert r.lo < 4.0 < r.hi


def test_bootstrap_brackets_the_lift(spark):
    c = spark.createDataFrame([("g", 400, 40, 80), ("z", 50, 0, 0)], "label string, n long, control_only long, treatment_only long")
    r = {x.label: x for x in P.bootstrap_interval(c, "label", "7", 400, chunk=64).collect()}
    assert r["g"].ci_low < 10 < r["g"].ci_high and abs((r["g"].ci_high - r["g"].ci_low) - 10.6) < 2.5
    assert (r["z"].ci_low, r["z"].ci_high) == (0.0, 0.0)


def test_power(spark):
    r = one(spark, P.n_per_arm(F.lit(.5), F.lit(.15)).alias("n"), P.mde_at(F.lit(.5), F.lit(5)).alias("none"), P.mde_at(F.lit(.5), F.lit(170)).alias("m"), P.mde_paired(F.lit(.5), F.lit(170)).alias("p"))
    assert 165 <= r.n <= 175 and r.none is None and abs(r.m - .15) < .01 and abs(r.m - r.p) < .01


def test_sizing(spark):
    g = spark.createDataFrame([(100, .5, .4)], "n_eval long, p0 double, seen2 double")
    assert P.sizing_report(g).head().ceiling_pts == 20.0


def test_shard_merge_and_conflict(spark):
    p = pred(spark, {str(i): "xy" for i in range(9)})
    per = M.hits(M.outcomes(p, gold(spark, {str(i): "x" if i % 2 else "z" for i in range(9)}))).withColumn("grp", F.col("task_id"))
    parts = [M.metric_counts(per.filter(F.col("task_id").cast("int") % 3 == i), ["arm", "grp"]) for i in range(3)]
    assert rows(M.merge_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["arm"])) == rows(M.metric_counts(per, ["arm"]))
    two = spark.createDataFrame([("g", "s1"), ("g", "s2")], "grp string, shard string")
    with pytest.raises(Exception, match="two shards"):
        M.shard_conflicts(two, "grp", "shard", fail=True).collect()


def hist(spark, pairs):
    return spark.createDataFrame([(int(s * 10000 + .5), m, 1) for s, m in pairs], "s4 long, match boolean, n long").groupBy("s4", "match").agg(F.sum("n").alias("n"))


@pytest.mark.parametrize("pairs,tau", [([(.22, False), (.37, False), (.64, True), (.9, True)], 0.0), ([(.12, False), (.18, False), (.31, False), (.71, True)], .2), ([(.15, False), (.25, False), (.3, False), (.45, False)], .45)])
def test_threshold(spark, pairs, tau):
    assert S.calibrate(hist(spark, pairs)).head().tau == tau


# -- similarity -----------------------------------------------------------------------------------------
def test_similarity(spark):
    w = lambda s: X.words(F.lit(s))
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, S.jaccard(w(""), w("")).alias("a"), S.jaccard(w(""), w("x")).alias("b"), S.jaccard(w("x y"), w("y z")).alias("c"), S.cosine(v(1, 0), v(1, 0)).alias("d"), S.cosine(v(1, 0), v(-1, 0)).alias("e"), S.cosine(v(0, 0), v(1, 0)).alias("f"),
            S.keyed(F.lit("k"), F.lit("k"), F.lit(.3)).alias("g"), S.keyed(F.lit("k"), F.lit("l"), F.lit(.3)).alias("h"), S.keyed(F.lit(None).cast("string"), F.lit("l"), F.lit(.3)).alias("i"))
    assert [round(x, 4) for x in r] == [1.0, 0.0, .3333, 1.0, 0.0, 0.0, 1.0, 0.0, .3]


@pytest.mark.parametrize("floor", [0.2, 0.5, 0.8])
def test_jaccard_join_equals_brute_force(spark, floor):
    import random
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 12)))) for i in range(120)]
    d = spark.createDataFrame(docs, "id long, text string")
    m, s = S.word_sets(d, "id", "text")
    got = {(r.a, r.b) for r in S.jaccard_set_join(s, s, floor).join(m.select(F.col("id").alias("a"), F.col("sid").alias("sid_l")), "sid_l").join(m.select(F.col("id").alias("b"), F.col("sid").alias("sid_r")), "sid_r").select("a", "b").collect()}
    sets = {i: set(x.split()) for i, x in docs}
    sim = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    assert got == {(i, j) for i in sets for j in sets if sim(sets[i], sets[j]) >= floor}


def test_topk_over_several_blocks(spark):
    import random
    rng = random.Random(5)
    vec = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    d = spark.createDataFrame(vec, "id long, v array<double>")
    small = S.cosine_topk(d.filter("id < 20"), d.filter("id >= 20"), "id", "v", 3, block=16)
    assert rows(small, "qid", "rank", "mid", "s4") == rows(S.cosine_topk(d.filter("id < 20"), d.filter("id >= 20"), "id", "v", 3), "qid", "rank", "mid", "s4")


# -- memory, ledger, clocks ----------------------------------------------------------------------------------
def test_supersession_and_snapshots(spark):
    store = spark.createDataFrame([("a",), ("c",)], "memory_id string")
    none = spark.createDataFrame([], "old_id string, new_id string")
    req = spark.createDataFrame([(1, "a", "a", "b"), (2, "a", "a", "d"), (3, "x", "x", "y"), (4, "c", None, "e"), (5, "c", "c", "c")], "seq long, old_id string, declared string, new_id string")
    v = {r.seq: r.reason for r in MEM.check_supersede(req, store, none).collect()}
    assert v == {1: "", 2: "already superseded", 3: "unknown id", 4: "not declared", 5: "not distinct"}
    after = MEM.live_set(store.unionByName(spark.createDataFrame([("b",)], "memory_id string")), req.filter("seq = 1"))
    assert rows(after) == [("b",), ("c",)]
    ver = lambda df: MEM.snapshot(df.withColumn("g", F.lit(1)), ["g"])
    v1, v2 = ver(store), ver(after)
    assert v1.head().version_id != v2.head().version_id
    assert v1.head().version_id == ver(store.repartition(5)).head().version_id
    members = MEM.version_members(store.withColumn("g", F.lit(1)), v1, ["g"])
    assert rows(MEM.at_version(members, store, v1.head().version_id)) == [("a",), ("c",)]
    assert MEM.at_version(members, store, None).count() == 0
    with pytest.raises(KeyError):
        MEM.at_version(members, store, "nope")


def ledger(spark, n=5, segment=4, first=0):
    e = spark.createDataFrame([(1, i, "ev", f"p{i}", f"x:{i}") for i in range(first, n)], "chain_id long, t long, event string, payload string, clock string")
    return e, *L.build(e, "chain_id", ["t"], "t div 4", segment=segment)


def verdict(built, heads, stored, segment=4):
    return rows(L.verify(built, heads, stored, "chain_id", segment), "ok", "first_bad_seq")


def test_ledger(spark):
    _, built, heads = ledger(spark, 11)
    stored = L.chain_heads(built, heads, "chain_id")
    assert verdict(built, heads, stored) == [(True, None)]
    for column in ("payload", "clock"):
        bad = built.withColumn(column, F.when(F.col("seq") == 2, "changed").otherwise(F.col(column)))
        assert verdict(bad, heads, stored) == [(False, 2)]
    assert verdict(built.filter("seq < 10"), heads, stored)[0][0] is False


def test_ledger_of_many_levels(spark):
    """20 entries in segments of two: five levels; every kind of damage is seen."""
    _, built, heads = ledger(spark, 20, 2)
    stored = L.chain_heads(built, heads, "chain_id")
    assert heads.agg(F.max("level")).first()[0] == 4
    assert verdict(built, heads, stored, 2) == [(True, None)]
    without = lambda seg: (built.filter(F.col("seg") != seg), heads.filter(~((F.col("level") == 1) & (F.col("seq") == seg))))          # noqa: E731
    for seg in (0, 4, 9):                             # first, middle and last segment, each with the row above it
        assert verdict(*without(seg), stored, 2)[0][0] is False
    for level in range(1, 5):
        bent = heads.withColumn("payload", F.when((F.col("level") == level) & (F.col("seq") == 0), F.lit("0" * 64)).otherwise(F.col("payload")))
        assert verdict(built, bent, stored, 2)[0][0] is False
    assert verdict(built, heads, stored.withColumn("head", F.lit("0" * 64)), 2)[0][0] is False
    assert verdict(built.limit(0), heads.limit(0), stored, 2) == [(False, 0)]


def test_first_entry_is_under_the_head_of_a_long_chain(spark):
    e, built, heads = ledger(spark, 20, 2)
    other = L.build(e.withColumn("payload", F.when(F.col("t") == 0, "other").otherwise(F.col("payload"))), "chain_id", ["t"], "t div 4", segment=2)
    assert rows(L.chain_heads(built, heads, "chain_id"), "head") != rows(L.chain_heads(*other, "chain_id"), "head")


def test_moved_separator_changes_the_hash(spark):
    df = spark.createDataFrame([("a|b", "c", None), ("a", "b|c", None), ("a", None, "b|c")], "event string, payload string, clock string")
    h = df.select(L.entry_hash(F.lit(0), F.lit(L.GENESIS), F.col("event"), F.col("payload"), F.col("clock")).alias("h"))
    assert h.distinct().count() == 3


def test_appending_gives_the_ledger_built_in_one_go(spark):
    _, built, heads = ledger(spark, 9, 2)
    more, _, _ = ledger(spark, 23, 2, first=9)
    _, whole, top = ledger(spark, 23, 2)
    grown, upper = L.append(built, heads, more, "chain_id", ["t"], "t div 4", 2)
    assert rows(grown, "seq", "prev_hash", "hash") == rows(whole, "seq", "prev_hash", "hash")
    assert rows(upper, "level", "seq", "hash") == rows(top, "level", "seq", "hash")


def test_state_refuses_other_settings_and_broken_ledger(spark, tmp_path):
    _, built, heads = ledger(spark)
    state.save_state({"ledger": built, "ledger_heads": heads}, "cfg", str(tmp_path / "s"))
    assert state.load_state(spark, ["ledger"], "cfg", str(tmp_path / "s"), segment=4)["ledger"].count() == 5
    with pytest.raises(ValueError, match="settings"):
        state.load_state(spark, ["ledger"], "other", str(tmp_path / "s"), segment=4)
    state.save_state({"ledger": built.withColumn("event", F.lit("x")), "ledger_heads": heads}, "cfg", str(tmp_path / "b"))
    with pytest.raises(ValueError, match="entry 0"):
        state.load_state(spark, ["ledger"], "cfg", str(tmp_path / "b"), segment=4)


def test_clocks(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv]).cast("map<string,bigint>")
    M_, B, Cc = m(A=1), m(A=1, B=1), m(C=1)
    r = one(spark, V.leq(M_, B).alias("knew"), V.leq(M_, Cc).alias("not"), V.relation(M_, B).alias("r"), V.relation(M_, Cc).alias("c"), V.relation(B, M_).alias("a"), V.relation(M_, m(A=1, Z=0)).alias("e"),
            V.canonical(V.merge(B, Cc)).alias("m"), V.canonical(V.tick(B, F.lit("B"))).alias("t"))
    assert tuple(r) == (True, False, "before", "concurrent", "after", "equal", "A:1,B:1,C:1", "A:1,B:2")
    pairs = spark.range(1).select(M_.alias("m_clock"), B.alias("a_clock"), F.lit(1000).alias("m_wall"), F.lit(885).alias("a_wall")).unionByName(
        spark.range(1).select(M_.alias("m_clock"), Cc.alias("a_clock"), F.lit(1000).alias("m_wall"), F.lit(1125).alias("a_wall")))
    assert rows(V.skew_disagreement(pairs)) == [(False, True, 1), (True, False, 1)]


def test_veto(spark):
    f = spark.createDataFrame([("t1", 1, False, 1), ("t2", 1, False, 1), ("t3", 1, False, 1), ("t4", 1, True, 1), ("t5", 2, False, 1)], "task_id string, rank int, ok boolean, chain int").withColumn("key", F.lit("k"))
    got = rows(G.veto_marks(f, 2, "chain", "key", ["task_id", "rank"], "1"), "task_id", "removed")
    assert got == [("t1", False), ("t2", False), ("t3", True), ("t4", True), ("t5", False)]
    assert rows(G.veto_marks(f, 2, "chain", "key", ["task_id", "rank"], "1", True).filter("removed"), "task_id") == []


# -- what the second round mended ------------------------------------------------------------------------------
def test_diff_without_header_lines(spark):
    df = spark.createDataFrame([("t", "--- a/m/x.py\n+++ b/m/x.py\n@@ -4,3 +4,3 @@\n-a\n+b\n--- a/m/y.py\n+++ b/m/y.py\n@@ -9 +9 @@\n-a\n+b\n")], "task string, patch string")
    assert rows(D.patch_files(df, "task", "patch"), "path") == [("m/x.py",), ("m/y.py",)]
    assert rows(D.patch_hunks(df, "task", "patch"), "path", "start_line", "end_line") == [("m/x.py", 4, 6), ("m/y.py", 9, 9)]


def test_interval_join_of_short_long_and_endless_ranges(spark):
    import itertools
    import random
    r = random.Random(4)
    side = lambda n: [("p" if r.random() < 0.8 else "q", i, a, a + r.choice([0, 3, 70, 900, 40_000, 10 ** 9])) for i in range(n) for a in [r.randrange(5000)]]
    left, right = side(60), side(60)
    schema = "path string, id long, start_line long, end_line long"
    got = rows(I.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), slack=2), "id", "r_id")
    want = sorted((a[1], b[1]) for a, b in itertools.product(left, right) if a[0] == b[0] and a[2] - 2 <= b[3] and b[2] - 2 <= a[3])
    assert sorted(got) == want


def test_words_split_at_every_unicode_space(spark):
    df = spark.createDataFrame([("a b　c a \x1cd",)], "t string")
    assert sorted(df.select(X.words(F.col("t")).alias("w")).head().w) == ["a", "b", "c", "d"]


def test_order_is_by_the_unrounded_score(spark):
    import math
    at = lambda c: [float(c), math.sqrt(1 - c * c)]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    m = spark.createDataFrame([(10, at(0.50001)), (11, at(0.50004)), (12, at(0.49996))], "vec_id long, embedding array<double>")
    top = S.cosine_topk(q, m, "vec_id", "embedding", 3)
    assert [x.mid for x in top.orderBy("rank").collect()] == [11, 10, 12]
    assert rows(MEM.gate_retrieval(top, 0.5), "mid", "injected") == [(10, True), (11, True), (12, False)]


def test_nothing_is_novel_enough_for_theta_one(spark):
    c = spark.createDataFrame([(1, "never seen words")], "k long, text string")
    m = spark.createDataFrame([(7, "other text")], "item long, text string")
    assert rows(S.novelty_gate(c, "k", m, "item", "text", 1.0), "admitted") == [(False,)]
    assert rows(S.novelty_gate(c, "k", m, "item", "text", 0.9), "admitted") == [(True,)]


def test_memories_far_apart_meet_and_are_counted(spark):
    turns = spark.createDataFrame([(1, t, r) for t, r in [(10, "user"), (12, "assistant"), (90, "user"), (200, "assistant"), (300, "user")]], "conv_id long, turn long, role string")
    c = V.turn_clocks(turns, ("assistant", "user"))
    pairs = V.with_memories(c, c.filter("turn = 10"), "conv_id", ["turn", "clock"])
    assert {x.a_turn for x in V.causal_join(pairs).collect()} == {10, 12, 90, 200, 300}
    known = {x.turn: x.known for x in V.known_before(c, F.col("turn") < 100, ("assistant", "user")).collect()}
    assert known == {10: 1, 12: 2, 90: 3, 200: 3, 300: 3}


def test_bootstrap_draws_are_even_beyond_a_million_tasks(spark):
    counts = spark.createDataFrame([("a", (1 << 20) + 7, 300_000, 320_000)], "label string, n long, control_only long, treatment_only long")
    got = P.bootstrap_interval(counts, "label", "7", 20).head()
    lift = 100 * 20_000 / ((1 << 20) + 7)
    assert got.ci_low < lift < got.ci_high and got.ci_high - got.ci_low < 0.4


# -- retrieval as of a point in time ---------------------------------------------------------------------------
def index(spark):
    m = spark.createDataFrame([("c", "p q", 3, None), ("c", "p r s", 1, 6), ("c", "q", 9, None), ("other", "p q", 1, None)], "chain_id string, loc string, promo_tick int, superseded_tick int")
    return RET.postings(m, F.split("loc", " "))


def asked(spark, tasks):
    return spark.createDataFrame([(t, "c", o, w.split()) for t, o, w in tasks], "task_id long, chain_id string, ord int, words array<string>")


def test_retrieval_sees_memory_of_the_task_before(spark):
    q = asked(spark, [(1, 3, "p q"), (2, 4, "p q"), (3, 6, "p r"), (4, 7, "p r"), (5, 10, "q"), (6, 10, "z"), (7, 10, "")])
    got = [(r.task_id, r["rank"], r["loc"], round(r.score, 4)) for r in RET.retrieve(q, index(spark), 2, 0.2).orderBy("task_id", "rank").collect()]
    assert got == [(1, 1, "p r s", .25), (2, 1, "p q", 1.0), (2, 2, "p r s", .25), (3, 1, "p r s", .6667), (3, 2, "p q", .3333), (4, 1, "p q", .3333), (5, 1, "q", 1.0), (5, 2, "p q", .5)]
    assert RET.retrieve(q, index(spark), 2, 1.01).count() == 0 and RET.retrieve(q, index(spark).limit(0), 2, 0.0).count() == 0


def test_guided_flags_and_matched_placebos(spark):
    got = spark.createDataFrame([(1, "b"), (1, "c"), (2, "x")], "task_id long, loc string")
    pool = spark.createDataFrame([(0, "a"), (1, "b"), (2, "d")], "idx long, loc string")
    sham = RET.matched_placebo(got, pool, 3, "s")
    assert {r.task_id: r["count"] for r in sham.groupBy("task_id").count().collect()} == {1: 2, 2: 1}
    assert sham.distinct().count() == 3
    flags = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (2, 1, "y", True), (2, 2, "x", False), (3, 1, "q", True)], "task_id long, rank int, key string, ok boolean")
    none = got.limit(0)
    first = {r.task_id: (r.control_top1, r.memory_top1, r.placebo_top1) for r in RET.guided_first(flags, got, none).collect()}
    assert first == {1: (0, 1, 0), 2: (1, 0, 1), 3: (1, 1, 1)}


def test_nothing_is_injected_without_learning(spark):
    from recurra.plans import REGISTRY
    from recurra.plans.bindings import Tables
    rows_ = REGISTRY["rolling_negative"].run(Tables(spark, "/root/testdata/sf0.001")).collect()
    assert rows_ and all(r.injected == r.covered == r.useful == r.placebo_injected == 0 and r.control_top1 == r.memory_top1 == r.placebo_top1 for r in rows_)


def test_members_of_every_version(spark):
    objects = spark.createDataFrame([("c", "a", 1), ("c", "b", 3), ("d", "z", 2)], "chain_id string, memory_id string, added int")
    done = spark.createDataFrame([("a", "a2", 4)], "old_id string, new_id string, tick int")
    held = MEM.membership(objects, done, ["chain_id"])
    assert rows(held, "chain_id", "memory_id", "added", "removed") == [("c", "a", 1, 4), ("c", "a2", 4, None), ("c", "b", 3, None), ("d", "z", 2, None)]
    got = rows(MEM.members_at(held, MEM.version_ticks(held, ["chain_id"]), ["chain_id"]), "chain_id", "version_tick", "memory_id")
    assert got == [("c", 1, "a"), ("c", 3, "a"), ("c", 3, "b"), ("c", 4, "a2"), ("c", 4, "b"), ("d", 2, "z")]
    assert MEM.members_at(held, spark.createDataFrame([("c", 0)], "chain_id string, version_tick int"), ["chain_id"]).count() == 0


def test_component_purity(spark):
    s = spark.createDataFrame([("c", "f", "f::A.x"), ("c", "f", "f::A.y"), ("c", "g", "g::B.x"), ("c", "g", "g::B.x"), ("c", "h", "h::C.x"), ("c", "h", "h::D.x")], "chain_id string, loc string, key string")
    r = K.cluster_purity(s, F.col("key"), component=keys.class_of(F.col("key"))).head()
    assert (r.clusters, r.pure, r.component_pure) == (3, 1, 2)


# -- ranked search ---------------------------------------------------------------------------------------------
def test_search_equals_scoring_everything_with_fewer_postings(spark):
    import math
    import random
    from collections import Counter
    from recurra.operators import search as SE
    r = random.Random(9)
    word = lambda: f"w{min(r.randrange(1, 400), r.randrange(1, 400), r.randrange(1, 400))}"          # noqa: E731
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 40)))) for i in range(600)] + [(600, None), (601, "The W1, w1; the")]
    asked = [(q, " ".join(word() for _ in range(12)) + f" w{300 + 9 * q}") for q in range(8)] + [(90, ""), (91, "nowhere"), (92, None)]
    index = SE.build_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    top, cost = SE.search(spark.createDataFrame(asked, "qid long, text string"), index, 5)
    tf = {d: Counter((t or "").lower().replace(",", "").replace(";", "").split()) for d, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: round(math.log(len(docs) / n) * 1e6) for w, n in df.items()}
    want, every = [], 0
    for q, t in asked:
        ws = {w for w in (t or "").split() if w in idf}
        every += sum(df[w] for w in ws)
        scored = sorted((-sum(min(5, c[w]) * idf[w] for w in ws), d) for d, c in tf.items() if any(idf[w] and w in c for w in ws))[:5]
        want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(scored)]
    assert sorted(map(tuple, top.select("qid", "rank", "item", "score").collect())) == sorted(want)
    assert cost.agg(F.sum("scored")).first()[0] < every
