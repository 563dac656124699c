"""Quality-metric queries."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.keys import file_of
from ..operators import metrics as M, paired as P
from .bindings import NEGATIVE_CONTROL, TASK_BUCKET, file_sql, with_views
from .gates import ERR_SQL, arm_errors
from .registry import query

MC_SQL = """mc AS (SELECT arm, grp, count(*) AS n_tasks, sum(hit::INT)::BIGINT AS n_localized, sum(n_flags)::BIGINT AS n_flags, sum(n_fp)::BIGINT AS n_false_positive FROM hit GROUP BY 1, 2)"""
RATES_SQL = "round(n_localized / n_tasks, 4) AS localization_rate, round(n_false_positive / n_flags, 4) AS false_positive_rate"
CONTROL_FILE_SQL = f"""gk AS (SELECT DISTINCT task_id, {file_sql('fkey')} AS key FROM gold),
  fl AS (SELECT p.task_id, rank, p.key, gk.key IS NOT NULL AS ok FROM (SELECT task_id, rank, {file_sql('fkey')} AS key FROM pred WHERE arm = 'control') p
    JOIN (SELECT DISTINCT task_id FROM gold) g ON p.task_id = g.task_id LEFT JOIN gk ON gk.task_id = p.task_id AND gk.key = p.key),
  rr AS (SELECT task_id, key, ok, row_number() OVER (PARTITION BY task_id ORDER BY r) AS rank FROM (SELECT task_id, key, min(rank) AS r, bool_or(ok) AS ok FROM fl GROUP BY 1, 2))"""


def control_file_flags(t):
    return M.outcomes(t.pred.filter("arm = 'control'"), t.gold, "file")


def counts(t):
    return M.metric_counts(t.hit, ["arm", "grp"])


@query("label_outcome", with_views("pred gold", """SELECT p.task_id, p.rank, CASE WHEN t.task_id IS NULL THEN 'unknown' WHEN g.fkey IS NOT NULL THEN 'bad' ELSE 'good' END AS label
  FROM pred p LEFT JOIN (SELECT DISTINCT task_id FROM gold) t ON p.task_id = t.task_id LEFT JOIN gold g ON p.task_id = g.task_id AND p.fkey = g.fkey WHERE arm = 'control'"""))
def label_outcome(t):
    return M.label_outcomes(t.pred.filter("arm = 'control'"), t.gold).select("task_id", "rank", "label")


@query("arm_metrics", with_views("hit", MC_SQL + f", al AS (FROM mc UNION ALL SELECT arm, NULL, sum(n_tasks)::BIGINT, sum(n_localized)::BIGINT, sum(n_flags)::BIGINT, sum(n_false_positive)::BIGINT FROM mc GROUP BY 1) SELECT *, {RATES_SQL} FROM al"))
def arm_metrics(t):
    return M.arm_metrics(t.hit)


LIFT = """round(100 * (sum(n_localized) FILTER (arm = '{a}') / sum(n_tasks) FILTER (arm = '{a}') - sum(n_localized) FILTER (arm = '{b}') / sum(n_tasks) FILTER (arm = '{b}')), 2)"""
RISE = """round(100 * (sum(n_false_positive) FILTER (arm = '{a}') / sum(n_flags) FILTER (arm = '{a}') - sum(n_false_positive) FILTER (arm = '{b}') / sum(n_flags) FILTER (arm = '{b}')), 2)"""


def lift_sql(a: str, b: str = "control") -> str:
    return LIFT.format(a=a, b=b)


@query("lift", with_views("hit", MC_SQL + f" SELECT grp, {lift_sql('treatment')} AS localization_lift_pts, {RISE.format(a='treatment', b='control')} AS false_positive_rise_pts FROM mc GROUP BY GROUPING SETS ((grp), ())"))
def lift(t):
    return M.lift_points(M.with_overall(counts(t), "grp"), ["grp"])


@query("merge_shards", with_views("hit", "SELECT arm, count(*) AS n_tasks, sum(hit::INT)::BIGINT AS n_localized, sum(n_flags)::BIGINT AS n_flags, sum(n_fp)::BIGINT AS n_false_positive FROM hit GROUP BY 1"))
def merge_shards(t):
    shard = F.crc32(F.col("grp").cast("binary")) % 3
    parts = M.metric_counts(t.hit.withColumn("shard", shard), ["shard", "arm", "grp"])          # the counts of every shard in one pass
    return M.merge_counts(parts, ["arm"])


def _report_sql(arm: str) -> str:
    neg = NEGATIVE_CONTROL
    minus = f"(SELECT {lift_sql(arm, 'placebo')} FROM mc WHERE grp <> '{neg}')" if arm != "placebo" else "NULL::DOUBLE"
    return f"""SELECT *, n_positive * 2 > n_groups AS effect_in_majority FROM (SELECT '{arm}' AS arm, (SELECT {lift_sql(arm)} FROM mc WHERE grp <> '{neg}') AS localization_lift_pts, (SELECT {RISE.format(a=arm, b='control')} FROM mc WHERE grp <> '{neg}') AS false_positive_rise_pts,
      (SELECT count(DISTINCT grp) FROM mc WHERE grp <> '{neg}') AS n_groups, (SELECT count(*) FROM (SELECT {lift_sql(arm)} AS l FROM mc WHERE grp <> '{neg}' GROUP BY grp) WHERE l > 0) AS n_positive,
      (SELECT {lift_sql(arm)} FROM mc WHERE grp = '{neg}') AS negative_control_lift_pts, {minus} AS minus_placebo_pts)"""


@query("gate_report", with_views("hit", MC_SQL + " " + _report_sql("treatment") + " UNION ALL " + _report_sql("placebo")))
def gate_report(t):
    return M.gate_report(counts(t), "grp", NEGATIVE_CONTROL)


@query("task_hits", with_views("pred gold", f"""ff AS (SELECT DISTINCT task_id, {file_sql('fkey')} AS f FROM gold), t AS (SELECT DISTINCT task_id FROM gold)
  SELECT p.arm, p.task_id, bool_or(g.fkey IS NOT NULL) AS hit, bool_or(ff.f IS NOT NULL) AS file_hit FROM pred p JOIN t ON p.task_id = t.task_id
  LEFT JOIN gold g ON p.task_id = g.task_id AND p.fkey = g.fkey LEFT JOIN ff ON p.task_id = ff.task_id AND {file_sql('p.fkey')} = ff.f GROUP BY 1, 2"""))
def task_hits(t):
    fine = M.hits(t.outcome).select("arm", "task_id", "hit")
    coarse = M.hits(M.outcomes(t.pred, t.gold, "file")).select("arm", "task_id", F.col("hit").alias("file_hit"))
    return fine.join(coarse, ["arm", "task_id"])


@query("hit_at_k", with_views("ln gold", """r AS (SELECT task_id, fkey, row_number() OVER (PARTITION BY task_id ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rank FROM ln),
  o AS (SELECT r.task_id, rank, g.fkey IS NOT NULL AS ok FROM r JOIN (SELECT DISTINCT task_id FROM gold) t ON r.task_id = t.task_id LEFT JOIN gold g ON r.task_id = g.task_id AND r.fkey = g.fkey),
  p AS (SELECT k, task_id, max(ok::INT) AS h, count(*) AS f, count(*) FILTER (NOT ok) AS w FROM o JOIN (VALUES (1),(3),(5)) v(k) ON rank <= k GROUP BY 1, 2)
  SELECT k, count(*) AS n, sum(h)::BIGINT AS hit, round(sum(h) / count(*), 4) AS hit_at_k, sum(f)::BIGINT AS flags, round(sum(w) / sum(f), 4) AS false_positive_rate,
    (SELECT count(DISTINCT task_id) FROM ln WHERE task_id NOT IN (SELECT task_id FROM gold)) AS missing_gold FROM p GROUP BY 1"""))
def hit_at_k(t):
    w = Window.partitionBy("task_id").orderBy(F.col("l_extendedprice").desc(), "l_partkey", "l_suppkey", "l_linenumber")
    ranked = t.ln.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("task_id", "rank", "fkey")
    return M.hit_at_k(ranked, t.gold, (1, 3, 5), t.ln)


@query("precision_by_rank", with_views("pred gold", CONTROL_FILE_SQL + " SELECT rank, count(*) FILTER (ok) AS correct, count(*) AS n FROM rr GROUP BY 1"))
def precision_by_rank(t):
    return M.precision_by_rank(M.rerank_distinct(control_file_flags(t)))


@query("first_hit_rank", with_views("pred gold", CONTROL_FILE_SQL + ", p AS (SELECT task_id, min(rank) FILTER (ok) AS first_rank FROM rr GROUP BY 1) SELECT first_rank, count(*) AS n_tasks FROM p GROUP BY 1"))
def first_hit_rank(t):
    return M.first_hit_rank(M.rerank_distinct(control_file_flags(t)))


@query("display_policy", with_views("pred gold", CONTROL_FILE_SQL + """, p AS (SELECT k, task_id, max(ok::INT) AS h, count(*) FILTER (NOT ok) AS w FROM rr JOIN (VALUES (1),(2),(3)) v(k) ON rank <= k GROUP BY 1, 2),
  s AS (SELECT k, count(*) AS n_tasks, sum(h)::BIGINT AS hits, sum(w)::BIGINT AS wrong FROM p GROUP BY 1)
  SELECT *, round(CASE WHEN wrong > lag(wrong, 1, 0) OVER (ORDER BY k) THEN (hits - lag(hits, 1, 0) OVER (ORDER BY k)) / (wrong - lag(wrong, 1, 0) OVER (ORDER BY k)) END, 4) AS break_even_cost FROM s"""))
def display_policy(t):
    return M.display_policy(M.rerank_distinct(control_file_flags(t)))


@query("coarse_hit", with_views("pred gold", CONTROL_FILE_SQL + ", p AS (SELECT task_id, max(ok::INT) AS h FROM fl GROUP BY 1) SELECT count(*) AS n_tasks, sum(h)::BIGINT AS hits, round(sum(h) / count(*), 4) AS hit_rate FROM p"))
def coarse_hit(t):
    per = M.hits(control_file_flags(t))
    return per.agg(F.count("*").alias("n_tasks"), F.count_if("hit").alias("hits")).withColumn("hit_rate", F.round(F.col("hits") / F.col("n_tasks"), 4))


@query("repeat_fp", with_views("outcome", """p AS (SELECT task_id, fkey AS key, bool_or(ok) AS ok FROM outcome WHERE arm = 'control' GROUP BY 1, 2)
  SELECT key, count(*) FILTER (NOT ok) AS n_wrong, count(*) FILTER (ok) AS n_right FROM p GROUP BY 1 HAVING count(*) FILTER (NOT ok) > 0 ORDER BY n_wrong DESC, key LIMIT 8"""))
def repeat_fp(t):
    return M.repeated_false_positives(t.outcome.filter("arm = 'control'"), 8)


@query("hit_by_recurrence", with_views("hit gold", f"""pl AS (SELECT tk.chain_id, g.task_id, g.key, ord FROM (SELECT DISTINCT task_id, {file_sql('fkey')} AS key FROM gold) g JOIN tk ON g.task_id = tk.task_id),
  pr AS (SELECT task_id, row_number() OVER (PARTITION BY chain_id, key ORDER BY ord) - 1 AS prior FROM pl), rc AS (SELECT task_id, max(prior) > 0 AS recurring FROM pr GROUP BY 1)
  SELECT arm, recurring, count(*) FILTER (hit) AS hits, count(*) AS n FROM hit JOIN rc ON hit.task_id = rc.task_id GROUP BY 1, 2"""))
def hit_by_recurrence(t):
    keyed = t.gold.select("task_id", file_of(F.col("fkey")).alias("key")).distinct().join(t.tasks.select("task_id", "chain_id", "created_at"), "task_id")
    rec = M.recurring_tasks(keyed, "chain_id", ["created_at", "task_id"], TASK_BUCKET)
    return M.hits(t.outcome).join(rec, "task_id").groupBy("arm", "recurring").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


PAIR_SQL = """pa AS (SELECT c.task_id, c.grp, c.hit AS base_hit, a.hit AS arm_hit FROM hit c JOIN hit a ON c.task_id = a.task_id WHERE c.arm = '{b}' AND a.arm = '{a}')"""


@query("wins_losses", with_views("hit", " UNION ALL ".join(f"""SELECT '{a}' AS arm, count(*) AS n, count(*) FILTER (x.hit AND NOT c.hit) AS wins, count(*) FILTER (c.hit AND NOT x.hit) AS losses,
  round(100 * (count(*) FILTER (x.hit AND NOT c.hit) - count(*) FILTER (c.hit AND NOT x.hit)) / count(*), 2) AS delta_pts FROM hit c JOIN hit x ON c.task_id = x.task_id WHERE c.arm = 'control' AND x.arm = '{a}'""" for a in ("treatment", "placebo"))))
def wins_losses(t):
    return M.wins_losses(M.hits(t.outcome), ("treatment", "placebo"))


@query("pair_arms", with_views("hit", PAIR_SQL.format(a="treatment", b="control") + " SELECT task_id, base_hit, arm_hit FROM pa"))
def pair_arms(t):
    return P.pair_arms(t.outcome).select("task_id", "base_hit", "arm_hit")


@query("common_tasks", with_views("pred", ERR_SQL + """, c AS (SELECT task_id FROM pred WHERE arm = 'control' EXCEPT SELECT task_id FROM err WHERE arm = 'control'), x AS (SELECT task_id FROM pred WHERE arm = 'treatment' EXCEPT SELECT task_id FROM err WHERE arm = 'treatment')
  SELECT task_id FROM c INTERSECT SELECT task_id FROM x"""))
def common_tasks(t):
    good = t.pred.select("arm", "task_id").distinct().join(arm_errors(t), ["arm", "task_id"], "left_anti")
    return good.filter("arm = 'control'").select("task_id").intersect(good.filter("arm = 'treatment'").select("task_id"))


@query("run_manifest", with_views("pred tk", ERR_SQL + """, a AS (SELECT grp, task_id FROM tk), e AS (SELECT DISTINCT task_id FROM err), s AS (SELECT DISTINCT task_id FROM pred WHERE task_id NOT IN (SELECT task_id FROM e))
  SELECT grp, count(*) AS attempted, count(s.task_id) AS scored, count(e.task_id) AS errors, count(*) FILTER (s.task_id IS NULL AND e.task_id IS NULL) AS unaccounted FROM a LEFT JOIN s ON a.task_id = s.task_id LEFT JOIN e ON a.task_id = e.task_id GROUP BY 1"""))
def run_manifest(t):
    err = arm_errors(t).select("task_id").distinct()
    scored = t.pred.select("task_id").distinct().join(err, "task_id", "left_anti")
    g = t.tasks.select("grp", "task_id")
    return M.run_manifest(g, scored.join(g, "task_id"), err.join(g, "task_id"), "grp")


@query("label_agreement", with_views("doc", "r AS (SELECT CASE WHEN label <> 'unknown' THEN label ELSE '' END AS manual, CASE WHEN length(text) >= 1500 THEN 'good' ELSE 'bad' END AS rule FROM doc) SELECT count(*) FILTER (manual <> '' AND manual = rule) AS agree, count(*) FILTER (manual <> '') AS n, round(count(*) FILTER (manual <> '' AND manual = rule) / count(*) FILTER (manual <> ''), 4) AS share, count(*) FILTER (manual <> '' AND manual = rule) >= 0.95 * count(*) FILTER (manual <> '') AS passed FROM r"))
def label_agreement(t):
    r = t.doc.select(F.when(F.col("label") != "unknown", F.col("label")).otherwise("").alias("manual"), F.when(F.length("text") >= 1500, "good").otherwise("bad").alias("rule"))
    return M.agreement(r, "rule", "manual")


@query("agreement_signal", with_views("outcome", f"""p AS (SELECT task_id, count(DISTINCT {file_sql('fkey')}) = 1 AS same_file, bool_or(ok) FILTER (rank = 1) AS first_ok, count(*) AS n FROM outcome WHERE arm = 'control' GROUP BY 1)
  SELECT same_file, count(*) AS n_tasks, count(*) FILTER (first_ok) AS first_correct FROM p WHERE n >= 2 GROUP BY 1"""))
def agreement_signal(t):
    f = t.outcome.filter("arm = 'control'").withColumn("file", file_of(F.col("key")))
    per = f.groupBy("task_id").agg((F.min("file") == F.max("file")).alias("same_file"), F.max(F.when(F.col("rank") == 1, F.col("ok"))).alias("first_ok"), F.count("*").alias("n"))
    return per.filter("n >= 2").groupBy("same_file").agg(F.count("*").alias("n_tasks"), F.count_if("first_ok").alias("first_correct"))


@query("mention_rate", """WITH m AS (SELECT doc_id, lang, contains(text, source) AS full_name, contains(lower(text), ' ' || lang || ' ') AS short_name FROM documents)
  SELECT lang, count(*) AS n, count(*) FILTER (full_name) AS n_full, count(*) FILTER (short_name) AS n_short, count(*) FILTER (full_name OR short_name) AS n_any FROM m GROUP BY 1""")
def mention_rate(t):
    m = t.raw("documents").select("lang", F.contains("text", "source").alias("f"), F.contains(F.lower("text"), F.concat(F.lit(" "), F.col("lang"), F.lit(" "))).alias("s"))
    return m.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("f").alias("n_full"), F.count_if("s").alias("n_short"), F.count_if(F.col("f") | F.col("s")).alias("n_any"))


@query("companion_share", with_views("tk ln", """p AS (SELECT task_id, bool_or(l_returnflag = 'R') AS src, bool_or(l_returnflag = 'A') AS comp FROM ln GROUP BY 1)
  SELECT grp, count(*) FILTER (src) AS n_source, count(*) FILTER (src AND comp) AS n_companion, round(count(*) FILTER (src AND comp) / count(*) FILTER (src), 4) AS share FROM p JOIN tk ON p.task_id = tk.task_id GROUP BY 1"""))
def companion_share(t):
    per = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.max(F.col("l_returnflag") == "R").alias("src"), F.max(F.col("l_returnflag") == "A").alias("comp"))
    g = per.join(t.tasks, "task_id").groupBy("grp").agg(F.count_if("src").alias("n_source"), F.count_if(F.col("src") & F.col("comp")).alias("n_companion"))
    return g.withColumn("share", F.round(F.col("n_companion") / F.col("n_source"), 4))


@query("co_change", with_views("gold", """w AS (SELECT task_id FROM gold GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5)
  SELECT a.fkey AS key_a, b.fkey AS key_b, count(*) AS n_tasks FROM gold a JOIN gold b ON a.task_id = b.task_id AND a.fkey < b.fkey WHERE a.task_id IN (SELECT task_id FROM w) GROUP BY 1, 2 HAVING count(*) >= 2"""))
def co_change(t):
    return M.co_change(t.gold, "task_id", "fkey", 2, 5)


@query("shard_overlap", with_views("tk", "SELECT grp, min('s' || task_id % 4) AS lo, max('s' || task_id % 4) AS hi FROM tk GROUP BY 1 HAVING count(DISTINCT task_id % 4) > 1"))
def shard_overlap(t):
    return M.shard_conflicts(t.tasks.withColumn("shard", F.concat(F.lit("s"), (F.col("task_id") % 4).cast("string"))), "grp", "shard")


@query("gold_sets", with_views("gold", "SELECT task_id, list(fkey ORDER BY fkey) AS keys FROM gold GROUP BY 1"))
def gold_sets(t):
    return t.gold.groupBy("task_id").agg(F.sort_array(F.collect_set("fkey")).alias("keys"))
