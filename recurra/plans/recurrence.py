"""Recurrence queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recurrence as R
from ..functions.running import position
from .bindings import LEVELS_SQL, TASK_BUCKET, file_sql, with_views
from .registry import query


@query("prequential_recurrence", with_views("tk gold", LEVELS_SQL + """,
    pl AS (SELECT tk.chain_id, lk.level, lk.key, tk.ord, tk.task_id FROM lk JOIN tk ON lk.task_id = tk.task_id WHERE chain_len >= 5),
    pr AS (SELECT *, row_number() OVER (PARTITION BY chain_id, level, key ORDER BY ord) - 1 AS prior FROM pl),
    pt AS (SELECT task_id, level, max(prior) AS prior FROM pr GROUP BY 1, 2),
    ev AS (SELECT task_id, grp, level FROM tk CROSS JOIN (VALUES ('file'),('class'),('function')) v(level) WHERE chain_len >= 5 AND ord > 3)
    SELECT ev.level, grp, count(*) AS n_eval, count(prior) AS n_scorable,
      count(*) FILTER (prior >= 1) AS seen1, count(*) FILTER (prior >= 2) AS seen2, count(*) FILTER (prior >= 3) AS seen3,
      round(count(*) FILTER (prior >= 1) / count(*), 4) AS seen1_rate, round(count(*) FILTER (prior >= 2) / count(*), 4) AS seen2_rate,
      round(count(*) FILTER (prior >= 3) / count(*), 4) AS seen3_rate
    FROM ev LEFT JOIN pt ON ev.task_id = pt.task_id AND ev.level = pt.level
    GROUP BY GROUPING SETS ((ev.level, grp), (ev.level))"""))
def prequential_recurrence(t):
    return R.prequential(t.tk, t.gold, warmup=3, min_chain=5, bucket=TASK_BUCKET)


PREFIX_SQL = f"""ch AS (SELECT task_id, grp, row_number() OVER (PARTITION BY grp ORDER BY created_at, task_id) AS ord, count(*) OVER (PARTITION BY grp) AS n_chain FROM tk),
  gr AS (SELECT task_id, grp, ord, n_chain, prefix, CASE prefix WHEN 'all' THEN n_chain ELSE least(prefix::BIGINT, n_chain) END AS cut FROM ch CROSS JOIN (VALUES ('20'),('100'),('300'),('all')) v(prefix)),
  ks AS (SELECT task_id, fkey AS key, 'key' AS kind FROM gold UNION SELECT task_id, {file_sql('fkey')}, 'dir' FROM gold),
  tc AS (SELECT gr.*, key, kind FROM gr JOIN ks ON gr.task_id = ks.task_id),
  bd AS (SELECT grp, prefix, kind, key, count(*) AS c FROM tc WHERE ord <= cut GROUP BY 1, 2, 3, 4),
  bt AS (SELECT grp, prefix, count(*) FILTER (kind='key') AS distinct_keys, count(*) FILTER (kind='dir') AS distinct_dirs, count(*) FILTER (kind='key' AND c >= 2) AS keys_ge2, count(*) FILTER (kind='key' AND c >= 3) AS keys_ge3,
     count(*) FILTER (kind='dir' AND c >= 3) AS dirs_ge3, (sum(c) FILTER (kind='key'))::BIGINT AS occurrences FROM bd GROUP BY 1, 2),
  sn AS (SELECT tc.task_id, tc.grp, tc.prefix, max(c) FILTER (tc.kind='key') AS k, max(c) FILTER (tc.kind='dir') AS d FROM tc JOIN bd ON tc.grp=bd.grp AND tc.prefix=bd.prefix AND tc.kind=bd.kind AND tc.key=bd.key WHERE ord > cut GROUP BY 1, 2, 3),
  ht AS (SELECT grp, prefix, count(*) FILTER (k>=1) AS key_seen1, count(*) FILTER (k>=2) AS key_seen2, count(*) FILTER (k>=3) AS key_seen3, count(*) FILTER (d>=1) AS dir_seen1, count(*) FILTER (d>=3) AS dir_seen3 FROM sn GROUP BY 1, 2),
  bs AS (SELECT grp, prefix, max(cut) AS cut, max(n_chain) AS n_tasks, count(*) FILTER (ord > cut) AS n_eval FROM gr GROUP BY 1, 2),
  rp AS (SELECT bs.grp, bs.prefix, cut, n_tasks, n_eval, coalesce(distinct_keys,0) AS distinct_keys, coalesce(distinct_dirs,0) AS distinct_dirs, coalesce(keys_ge2,0) AS keys_ge2, coalesce(keys_ge3,0) AS keys_ge3, coalesce(dirs_ge3,0) AS dirs_ge3,
     coalesce(occurrences,0) AS occurrences, coalesce(key_seen1,0) AS key_seen1, coalesce(key_seen2,0) AS key_seen2, coalesce(key_seen3,0) AS key_seen3, coalesce(dir_seen1,0) AS dir_seen1, coalesce(dir_seen3,0) AS dir_seen3,
     CASE WHEN occurrences > 0 THEN round(1 - distinct_keys / occurrences, 4) END AS repeat_share
     FROM bs LEFT JOIN bt ON bs.grp=bt.grp AND bs.prefix=bt.prefix LEFT JOIN ht ON bs.grp=ht.grp AND bs.prefix=ht.prefix)"""


def by_prefix(t):
    placed = position(t.tasks, ["grp"], ["created_at", "task_id"], TASK_BUCKET).join(t.tasks.groupBy("grp").agg(F.count("*").alias("n_chain")), "grp")
    return R.recurrence_by_prefix(placed, t.gold, "grp", (20, 100, 300, None))


@query("recurrence_prefix", with_views("tk gold", PREFIX_SQL + " SELECT * FROM rp"))
def recurrence_prefix(t):
    return by_prefix(t)


@query("lift_ceiling", with_views("tk gold hit", PREFIX_SQL + """, p0 AS (SELECT grp, sum(hit::INT) / count(*) AS p0 FROM hit WHERE arm = 'control' GROUP BY 1)
  SELECT prefix, sum(n_eval)::BIGINT AS eval_pool, round(sum(100 * key_seen2 * (1 - p0)) / sum(n_eval), 4) AS ceiling_ge2, round(sum(100 * key_seen3 * (1 - p0)) / sum(n_eval), 4) AS ceiling_ge3
  FROM rp JOIN p0 ON rp.grp = p0.grp WHERE n_eval >= 10 AND cut < n_tasks GROUP BY 1"""))
def lift_ceiling(t):
    control = t.hit.filter("arm = 'control'").groupBy("grp").agg(F.count_if("hit").alias("n_localized"), F.count("*").alias("n_tasks"))
    return R.lift_ceilings(by_prefix(t), control, "grp")


@query("expected_redundant", with_views("rec", "r AS (SELECT chain_id, row_number() OVER (PARTITION BY chain_id, loc ORDER BY ts, record_id) > 1 AS red FROM rec) SELECT chain_id, count(*) AS n, count(*) FILTER (red) AS redundant FROM r GROUP BY 1"))
def expected_redundant(t):
    return R.expected_redundant(t.rec, ["chain_id", "loc"], ["chain_id"])
