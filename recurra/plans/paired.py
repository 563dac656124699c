"""Paired statistics and sizing queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digest import counter_draw_sql
from ..operators import paired as P, recurrence as R
from .bindings import NEGATIVE_CONTROL, TASK_BUCKET, file_sql, with_views
from .registry import query

TIE = 1e-9      # p-values are fractions of 2**n: ties at the fourth decimal are exact and go up
SECONDARY = "cast(substring_index(grp, '_', -1) as int) < 10"


def pairs(t, arm="treatment", base="control"):
    touched = t.raw("lineitem").filter("l_quantity >= 40").select(F.col("l_orderkey").alias("task_id")).distinct().withColumn("retrieved", F.lit(True))
    p = P.pair_arms(t.outcome, arm, base).join(touched, "task_id", "left").fillna(False, ["retrieved"])
    return p.join(t.tasks.select("task_id", "grp"), "task_id")


def scopes(t, arm="treatment", base="control"):
    return P.scope_counts(P.pair_counts(pairs(t, arm, base), ["grp"]), "grp", NEGATIVE_CONTROL, F.expr(SECONDARY))


def counts_sql(a: str = "treatment", b: str = "control") -> str:
    return f"""fl2 AS (SELECT arm, task_id, list(fkey ORDER BY rank) AS ks FROM outcome GROUP BY 1, 2), rt AS (SELECT DISTINCT l_orderkey AS task_id FROM lineitem WHERE l_quantity >= 40),
    pa AS (SELECT c.grp, c.hit AS bh, x.hit AS ah, fc.ks <> fx.ks AS df, rt.task_id IS NOT NULL AS ret FROM hit c JOIN hit x ON c.task_id = x.task_id AND c.arm = '{b}' AND x.arm = '{a}'
      JOIN fl2 fc ON fc.arm = '{b}' AND fc.task_id = c.task_id JOIN fl2 fx ON fx.arm = '{a}' AND fx.task_id = c.task_id LEFT JOIN rt ON rt.task_id = c.task_id),
    sc AS (SELECT 'group' AS scope, grp AS label, * FROM pa UNION ALL SELECT 'primary', 'all', * FROM pa WHERE grp <> '{NEGATIVE_CONTROL}'
      UNION ALL SELECT 'secondary', 'all', * FROM pa WHERE grp <> '{NEGATIVE_CONTROL}' AND split_part(grp, '_', 2)::INT < 10 UNION ALL SELECT 'negative_control', 'all', * FROM pa WHERE grp = '{NEGATIVE_CONTROL}'),
    ct AS (SELECT scope, label, count(*) AS n, count(*) FILTER (bh AND ah) AS both_hit, count(*) FILTER (bh AND NOT ah) AS control_only, count(*) FILTER (ah AND NOT bh) AS treatment_only,
      count(*) FILTER (df) AS differed, count(*) FILTER (ret) AS retrieved FROM sc GROUP BY 1, 2)"""


SUM_SQL = """ SELECT *, n - both_hit - control_only - treatment_only AS neither_hit, round((both_hit + control_only) / n, 4) AS control_rate, round((both_hit + treatment_only) / n, 4) AS treatment_rate,
  round(100 * (treatment_only - control_only) / n, 2) AS lift_pts, round(differed / n, 4) AS differed_rate, round(retrieved / n, 4) AS coverage FROM ct"""


@query("paired_summary", with_views("hit outcome", counts_sql() + SUM_SQL))
def paired_summary(t):
    return P.summarise_pairs(scopes(t))


@query("paired_vs_placebo", with_views("hit outcome", counts_sql("treatment", "placebo") + SUM_SQL))
def paired_vs_placebo(t):
    return P.summarise_pairs(scopes(t, "treatment", "placebo"))


@query("mcnemar", with_views("hit outcome", counts_sql() + """, m AS (SELECT scope, label, control_only AS b, treatment_only AS c FROM ct)
  SELECT scope, label, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END + 1e-9, 4) AS p FROM m"""))
def mcnemar(t):
    b, c = F.col("control_only"), F.col("treatment_only")
    return scopes(t).select("scope", "label", b.alias("b"), c.alias("c"), F.round(P.mcnemar_p(b, c) + TIE, 4).alias("p"))


@query("paired_ci", with_views("hit outcome", counts_sql() + """, d AS (SELECT scope, label, n, (treatment_only - control_only) / n AS d, 1.959964 * sqrt(greatest(((control_only + treatment_only) / n - ((treatment_only - control_only) / n) ** 2) / n, 0)) AS h FROM ct)
  SELECT scope, label, n, round(100 * (d - h), 2) AS ci_low, round(100 * (d + h), 2) AS ci_high FROM d"""))
def paired_ci(t):
    lo, hi = P.wald_interval(F.col("n"), F.col("control_only"), F.col("treatment_only"))
    return scopes(t).select("scope", "label", "n", lo.alias("ci_low"), hi.alias("ci_high"))


@query("bootstrap_ci", with_views("hit outcome", counts_sql() + """, g AS (SELECT label, n, control_only AS b, treatment_only AS c FROM ct WHERE scope = 'group'),
  dx AS (SELECT label, n, b, c, rep, i, key, """ + counter_draw_sql('key', '(i % 2147483647)') + """ AS x1 FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, ('0x'||substr(md5('7:' || label || ':' || rep),1,15))::BIGINT % 2147483647 AS key FROM (SELECT *, unnest(range(0, 200)) AS rep FROM g)))),
  dr AS (SELECT label, n, b, c, rep, (""" + counter_draw_sql('(key + i // 2147483647 + 1)', 'x1') + """ * 2147483647 + x1) % n AS r FROM dx),
  s AS (SELECT label, n, rep, sum(CASE WHEN r < b THEN -1 WHEN r < b + c THEN 1 ELSE 0 END) AS s FROM dr GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s, rep) AS rn FROM s)
  SELECT label, max(n) AS n, round(max(100 * s / n) FILTER (rn = 6), 2) AS ci_low, round(max(100 * s / n) FILTER (rn = 195), 2) AS ci_high FROM k GROUP BY 1"""))
def bootstrap_ci(t):
    return P.bootstrap_interval(scopes(t).filter("scope = 'group'"), "label", "7", 200)


NPA = "ceil(pow(1.959963984540054*sqrt(2*((p0+p0+{m})/2)*(1-(p0+p0+{m})/2)) + 0.8416212335729143*sqrt(p0*(1-p0)+(p0+{m})*(1-p0-{m})), 2) / ({m}*{m}))"


def mde_sql(n: str) -> str:
    mid = "((a.lo + a.hi) / 2)"
    return f"""CASE WHEN p0 > 0 AND 1 - p0 - 0.0001 > 0.0001 AND {NPA.format(m='(1 - p0 - 0.0001)')} <= {n} THEN round(list_reduce(list_transform(range(0, 25), lambda i: {{'lo': 0.0001::DOUBLE, 'hi': (1 - p0 - 0.0001)::DOUBLE}}),
      lambda a, b: CASE WHEN a.hi - a.lo > 0.0001 THEN CASE WHEN {NPA.format(m=mid)} <= {n} THEN {{'lo': a.lo, 'hi': {mid}}} ELSE {{'lo': {mid}, 'hi': a.hi}} END ELSE a END).hi, 4) END"""


@query("power_table", with_views("hit", f"""g AS (SELECT grp, count(*) AS n, (sum(hit::INT) / count(*))::DOUBLE AS p0 FROM hit WHERE arm = 'control' GROUP BY 1),
  d AS (SELECT c.grp, (count(*) FILTER (c.hit <> x.hit) / count(*))::DOUBLE AS disc FROM hit c JOIN hit x ON c.task_id = x.task_id WHERE c.arm = 'control' AND x.arm = 'treatment' GROUP BY 1)
  SELECT g.grp, n, CASE WHEN p0 > 0 AND p0 + 0.15 < 1 THEN {NPA.format(m='0.15')}::BIGINT END AS n_for_15pts, {mde_sql('n')} AS mde,
    round(least(list_reduce(list_transform(range(0, 101), lambda i: 2.8015852181129683 * sqrt(disc / n)), lambda a, b: (1.959963984540054 * sqrt(disc) + 0.8416212335729143 * sqrt(greatest(disc - a * a, 1e-12))) / sqrt(n)), disc), 4) AS mde_paired,
    CASE WHEN 0.1 < disc THEN ceil(pow((1.959963984540054 * sqrt(disc) + 0.8416212335729143 * sqrt(disc - 0.1 * 0.1)) / 0.1, 2))::BIGINT END AS n_paired_10pts
  FROM g JOIN d ON g.grp = d.grp"""))
def power_table(t):
    p = P.pair_arms(t.outcome).join(t.tasks.select("task_id", "grp"), "task_id")
    g = p.groupBy("grp").agg(F.count("*").alias("n"), (F.count_if("base_hit") / F.count("*")).alias("p0"), (F.count_if(F.col("base_hit") != F.col("arm_hit")) / F.count("*")).alias("disc"))
    return g.select("grp", "n", P.n_per_arm(F.col("p0"), F.lit(0.15)).alias("n_for_15pts"), P.mde_at(F.col("p0"), F.col("n")).alias("mde"),
                    P.mde_paired(F.col("disc"), F.col("n")).alias("mde_paired"), P.n_paired(F.col("disc"), F.lit(0.1)).alias("n_paired_10pts"))


@query("sizing_report", with_views("tk gold hit", f"""pl AS (SELECT tk.chain_id, g.task_id, g.key, ord FROM (SELECT DISTINCT task_id, {file_sql('fkey')} AS key FROM gold) g JOIN tk ON g.task_id = tk.task_id WHERE chain_len >= 5),
  pr AS (SELECT task_id, ord, row_number() OVER (PARTITION BY chain_id, key ORDER BY ord) - 1 AS prior FROM pl), pt AS (SELECT task_id, max(prior) AS prior FROM pr GROUP BY 1),
  ev AS (SELECT tk.grp, count(*) AS n_all, count(pt.prior) AS n_eval, count(*) FILTER (prior >= 2) AS s2 FROM tk LEFT JOIN pt ON tk.task_id = pt.task_id WHERE chain_len >= 5 AND ord > 3 GROUP BY 1),
  p0s AS (SELECT grp, (sum(hit::INT) / count(*))::DOUBLE AS p0 FROM hit WHERE arm = 'control' GROUP BY 1),
  r AS (SELECT n_eval, p0s.p0, round(100 * (s2 / n_all) * (1 - p0s.p0), 1) AS c FROM ev JOIN p0s ON ev.grp = p0s.grp WHERE ev.grp <> '{NEGATIVE_CONTROL}'),
  a AS (SELECT sum(n_eval)::BIGINT AS eval_pool, (sum(p0 * n_eval) / sum(n_eval))::DOUBLE AS p0, sum(c * n_eval) / sum(n_eval) AS c FROM r), b AS (SELECT *, 100 * ({mde_sql('eval_pool')}) AS m FROM a)
  SELECT eval_pool, round(p0, 4) AS p0, round(c, 1) AS ceiling_pts, round(m, 1) AS mde_pts, ceil(greatest(m, 0.5 * c))::BIGINT AS kill_number_pts, c >= 1.5 * m AS feasible FROM b"""))
def sizing_report(t):
    pre = R.prequential(t.tk, t.gold, 3, 5, TASK_BUCKET, ("file",)).filter(f"grp is not null and grp <> '{NEGATIVE_CONTROL}'")
    p0 = t.hit.filter("arm = 'control'").groupBy("grp").agg((F.count_if("hit") / F.count("*")).alias("p0"))
    return P.sizing_report(pre.select("grp", F.col("n_scorable").alias("n_eval"), (F.col("seen2") / F.col("n_eval")).alias("seen2")).join(p0, "grp"))
