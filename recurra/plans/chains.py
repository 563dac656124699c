"""Chain queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as C
from .bindings import with_views
from .registry import query

LEN_SQL = "cl AS (SELECT o_custkey AS chain_id, count(*) AS n_tasks, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1)"


@query("chains", with_views("tk", "SELECT task_id, chain_id, grp, ord, chain_len FROM tk"))
def chains(t):
    return t.tk.select("task_id", "chain_id", "grp", "ord", "chain_len")


@query("chain_span", "WITH " + LEN_SQL + " SELECT *, date_diff('day', first_day, last_day) AS span_days, n_tasks >= 12 AS eligible FROM cl")
def chain_span(t):
    return C.chain_table(t.tasks, "chain_id", "created_at", 8, 4)


@query("chain_split", with_views("tk", "SELECT chain_id, count(*) FILTER (ord <= 6) AS n_build, count(*) FILTER (ord > 6) AS n_eval, max(created_at) FILTER (ord <= 6) AS build_end FROM tk GROUP BY 1"))
def chain_split(t):
    build = F.col("ord") <= 6
    return t.tk.groupBy("chain_id").agg(F.count_if(build).alias("n_build"), F.count_if(~build).alias("n_eval"), F.max(F.when(build, F.col("created_at"))).alias("build_end"))


def lengths(t):
    return t.tasks.groupBy("chain_id").agg(F.count("*").alias("n_tasks"))


@query("chain_stats", "WITH " + LEN_SQL + """ SELECT count(*) AS n_chains, sum(n_tasks)::BIGINT AS n_tasks, count(*) FILTER (n_tasks >= 5) AS ge_5, count(*) FILTER (n_tasks >= 10) AS ge_10,
  count(*) FILTER (n_tasks >= 20) AS ge_20, count(*) FILTER (n_tasks >= 40) AS ge_40, count(*) FILTER (n_tasks >= 12) AS n_eligible, median(n_tasks) AS median_len FROM cl""")
def chain_stats(t):
    return C.chain_stats(lengths(t), "n_tasks", (5, 10, 20, 40), 12)


@query("split_rule", "WITH " + LEN_SQL + """, b AS (SELECT chain_id, n_tasks, CASE WHEN n_tasks >= 14 THEN 10 WHEN n_tasks >= 10 THEN 7 WHEN n_tasks >= 6 THEN 4 ELSE 3 END AS build FROM cl)
  SELECT *, n_tasks >= build + 3 AS kept FROM b""")
def split_rule(t):
    return C.split_by_rule(lengths(t), "chain_id", "n_tasks", [(14, 10), (10, 7), (6, 4)], 3, 3)


@query("chain_top_n", "WITH " + LEN_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY n_tasks DESC, chain_id) AS rn FROM cl)
  SELECT chain_id::VARCHAR AS chain_id, n_tasks, 1 AS n_rows FROM r WHERE rn <= 30 UNION ALL SELECT '(rest)', sum(n_tasks)::BIGINT, count(*) FROM r WHERE rn > 30 HAVING count(*) > 0""")
def chain_top_n(t):
    return C.top_n_with_rest(lengths(t), [F.col("n_tasks").desc(), F.col("chain_id")], "chain_id", "n_tasks", 30)


@query("seeded_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(t):
    return C.seeded_sample(t.raw("orders").select("o_orderkey", "o_custkey"), "o_orderkey", "7", 100)


@query("corpus_summary", "WITH " + LEN_SQL + """, r AS (SELECT n_tasks, row_number() OVER (ORDER BY n_tasks) AS rn, count(*) OVER () AS n FROM cl)
  SELECT min(n_tasks) FILTER (rn = n // 2 + 1) AS upper_median FROM r""")
def corpus_summary(t):
    return C.upper_median(lengths(t), "n_tasks")


@query("hotspots", with_views("gold", "SELECT fkey, count(DISTINCT task_id) AS n_tasks FROM gold GROUP BY 1 ORDER BY n_tasks DESC, fkey LIMIT 20"))
def hotspots(t):
    return t.gold.groupBy("fkey").agg(F.count("*").alias("n_tasks")).orderBy(F.col("n_tasks").desc(), "fkey").limit(20)
