"""Gate and filter queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as C, gates as G, metrics as M
from .bindings import NEGATIVE_CONTROL, TASK_BUCKET, file_sql, with_views
from .registry import query

CUTS_SQL = "cuts AS (SELECT r_name AS model, DATE '1996-01-01' + (r_regionkey * 180)::INT AS cutoff FROM region)"
CREATED_SQL = "c AS (SELECT task_id, grp, CASE WHEN task_id % 50 = 0 THEN NULL WHEN task_id % 50 = 1 THEN 'soon' ELSE strftime(created_at, '%Y-%m-%dT10:00:00Z') END AS created FROM tk)"
VERDICT_SQL = CUTS_SQL + ",\n" + CREATED_SQL + """,
  v AS (SELECT task_id, try_cast(substr(created,1,10) AS DATE) AS day, (SELECT max(cutoff) FROM cuts) AS cut FROM c),
  w AS (SELECT task_id, day AS created_day, coalesce(day > cut + 10, false) AS admitted,
    CASE WHEN day IS NULL THEN 'missing or unparseable created' WHEN day > cut + 10 THEN 'fresh' ELSE day::VARCHAR || ' <= cutoff ' || cut::VARCHAR || ' (+10d)' END AS reason FROM v)"""


def cutoffs(t):
    return t.raw("region").select(F.col("r_name").alias("model"), F.date_add(F.lit("1996-01-01").cast("date"), F.col("r_regionkey") * 180).alias("cutoff"))


def verdicts(t):
    m = F.col("task_id") % 50
    created = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, "soon").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'10:00:00'Z'"))
    return G.freshness_verdicts(t.tasks.select("task_id", created.alias("created")), cutoffs(t), "created", 10)


@query("freshness_verdicts", with_views("tk", VERDICT_SQL + " SELECT * FROM w"))
def freshness_verdicts(t):
    return verdicts(t).select("task_id", "created_day", "admitted", "reason")


@query("freshness_counts", with_views("tk", VERDICT_SQL + " SELECT admitted, CASE WHEN contains(reason,'<=') THEN 'too old' ELSE reason END AS why, count(*) AS n FROM w GROUP BY 1, 2"))
def freshness_counts(t):
    why = F.when(F.contains("reason", F.lit("<=")), "too old").otherwise(F.col("reason"))
    return verdicts(t).groupBy("admitted", why.alias("why")).agg(F.count("*").alias("n"))


GRID = ("1996-01-01", "1997-06-30", "1999-01-01", "2000-12-31", "2001-07-01")


@query("cutoff_survivors", with_views("tk", f"""g AS (SELECT unnest([{','.join(f"DATE '{c}'" for c in GRID)}]) AS cutoff),
  s AS (SELECT cutoff, grp, count(*) AS c FROM tk JOIN g ON created_at::DATE > cutoff GROUP BY 1, 2)
  SELECT cutoff, sum(c)::BIGINT AS n_tasks, count(*) AS n_groups, count(*) FILTER (c >= 20) AS n_large_groups FROM s GROUP BY 1"""))
def cutoff_survivors(t):
    return G.survivors_by_cutoff(t.tasks, "grp", "created_at", GRID)


@query("per_month", with_views("tk", "SELECT grp, strftime(created_at,'%Y-%m') AS month, count(*) AS n FROM tk GROUP BY 1, 2"))
def per_month(t):
    return t.tasks.groupBy("grp", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("asof_audit", """WITH li AS (SELECT l_orderkey AS task_id, l_suppkey AS s, l_partkey % 7 AS p, o_orderdate::DATE AS cutoff FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  rel AS (SELECT l_suppkey AS s, l_partkey % 7 AS p, min(l_shipdate)::DATE AS released FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1, 2)
  SELECT task_id, 'pkg-' || li.s AS name, li.p::VARCHAR AS version, released, CASE WHEN released IS NULL THEN 'unknown release date' ELSE 'released ' || released || ' > cutoff ' || cutoff END AS reason
  FROM li LEFT JOIN rel ON li.s = rel.s AND li.p = rel.p WHERE released IS NULL OR released > cutoff""")
def asof_audit(t):
    li, o = t.raw("lineitem"), t.raw("orders").select("o_orderkey", "o_orderdate")
    version = (F.col("l_partkey") % 7).cast("string")
    lines = (li.select("l_orderkey", "l_suppkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
             .select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("Pkg_"), F.col("l_suppkey").cast("string"), F.lit("=="), version).alias("line"), F.to_date("o_orderdate").alias("cutoff")))
    rel = (li.filter("l_suppkey % 10 <> 0").groupBy("l_suppkey", version.alias("version")).agg(F.to_date(F.min("l_shipdate")).alias("released"))
           .select(F.concat(F.lit("pkg-"), F.col("l_suppkey").cast("string")).alias("name"), "version", "released"))
    return G.asof_audit(lines, rel).select("task_id", "name", "version", "released", "reason")


@query("group_filter", with_views("tk", f"SELECT grp, count(*) AS n FROM tk WHERE grp IN (SELECT n_name FROM nation WHERE n_regionkey < 3) AND grp <> '{NEGATIVE_CONTROL}' GROUP BY 1"))
def group_filter(t):
    allow = t.raw("nation").filter("n_regionkey < 3").select(F.col("n_name").alias("grp"))
    exclude = t.raw("nation").filter(F.col("n_name") == NEGATIVE_CONTROL).select(F.col("n_name").alias("grp"))
    return G.filter_groups(t.tasks, "grp", allow, exclude).groupBy("grp").agg(F.count("*").alias("n"))


@query("head_per_group", with_views("tk", "h AS (SELECT grp, task_id, row_number() OVER (PARTITION BY grp ORDER BY created_at, task_id) AS rn FROM tk) SELECT grp, task_id, rn FROM h WHERE rn <= 10 ORDER BY grp, rn LIMIT 120"))
def head_per_group(t):
    return C.head_per_group(t.tasks.select("grp", "task_id", "created_at"), "grp", ["created_at", "task_id"], 10, 120).select("grp", "task_id", "rn")


@query("ceiling_drop", with_views("hit", """r AS (SELECT grp, count(*) AS n_tasks, sum(hit::INT)::BIGINT AS n_localized FROM hit WHERE arm = 'control' GROUP BY 1)
  SELECT grp, round(n_localized / n_tasks, 4) AS rate, n_localized / n_tasks >= 0.5 AS dropped, CASE WHEN n_localized / n_tasks >= 0.5 THEN 'control rate >= 0.5' ELSE '' END AS reason FROM r"""))
def ceiling_drop(t):
    per = t.hit.filter("arm = 'control'").groupBy("grp").agg((F.sum(F.col("hit").cast("int")) / F.count("*")).alias("raw"))
    return G.ceiling_drop(per, "raw", 0.5).select("grp", F.round("raw", 4).alias("rate"), "dropped", "reason")


@query("clean_ranked", with_views("ln", """f AS (SELECT task_id, fkey, min(l_linenumber * 10000000 + l_partkey) AS pos FROM ln WHERE (task_id, fkey) IN (SELECT task_id, fkey FROM ln WHERE l_returnflag <> 'N') GROUP BY 1, 2)
  SELECT task_id, fkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos, fkey) AS rank FROM f) WHERE rank <= 3"""))
def clean_ranked(t):
    ranked = t.ln.select("task_id", "fkey", (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("pos"))
    known = t.ln.filter("l_returnflag <> 'N'").select("task_id", "fkey")
    return G.clean_ranked(ranked, known, "task_id", "pos", "fkey", 3)


@query("candidate_lists", with_views("ln", "u AS (SELECT DISTINCT task_id, fkey FROM ln WHERE suffix(fkey, '1')) SELECT task_id, list(fkey ORDER BY fkey)[1:2] AS candidates FROM u GROUP BY 1"))
def candidate_lists(t):
    return G.candidate_lists(t.ln, "task_id", "fkey", "1", 2)


def arm_errors(t):
    arm_no = F.when(F.col("arm") == "control", 0).when(F.col("arm") == "treatment", 1).otherwise(2)
    return t.pred.select("arm", "task_id").distinct().filter((F.col("task_id") * 7 + arm_no) % 29 == 0)


ERR_SQL = "err AS (SELECT DISTINCT arm, task_id FROM pred WHERE (task_id * 7 + CASE arm WHEN 'control' THEN 0 WHEN 'treatment' THEN 1 ELSE 2 END) % 29 = 0)"


@query("paired_exclusion", with_views("pred", ERR_SQL + " SELECT arm, count(DISTINCT task_id) AS n_tasks, count(*) AS n_flags FROM pred WHERE task_id NOT IN (SELECT task_id FROM err) GROUP BY 1"))
def paired_exclusion(t):
    kept = G.drop_failed_in_any_arm(t.pred, arm_errors(t), "task_id")
    per_task = kept.groupBy("arm", "task_id").agg(F.count("*").alias("c"))
    return per_task.groupBy("arm").agg(F.count("*").alias("n_tasks"), F.sum("c").alias("n_flags"))


def _flags(t, chain: str, level: str):
    f = M.outcomes(t.pred.filter("arm = 'control'"), t.gold, level).join(t.tasks.select("task_id", F.col(chain).alias("chain"), "grp", "created_at"), "task_id")
    return f.filter(F.col("grp") != NEGATIVE_CONTROL)


def _flags_sql(chain: str, level: str) -> str:
    k = file_sql("fkey") if level == "file" else "fkey"
    return f"""gk AS (SELECT DISTINCT task_id, {k} AS key FROM gold),
    fl AS (SELECT p.task_id, p.rank, p.key, gk.key IS NOT NULL AS ok, tk.{chain} AS chain, tk.created_at
      FROM (SELECT task_id, rank, {k} AS key FROM pred WHERE arm = 'control') p JOIN (SELECT DISTINCT task_id FROM gold) g ON p.task_id = g.task_id
      JOIN tk ON p.task_id = tk.task_id LEFT JOIN gk ON p.task_id = gk.task_id AND p.key = gk.key WHERE tk.grp <> '{NEGATIVE_CONTROL}'),
    wr AS (SELECT *, coalesce(sum((NOT ok)::INT) OVER w, 0) AS wrong_before, coalesce(sum(ok::INT) OVER w, 0) AS right_before FROM fl
      WINDOW w AS (PARTITION BY chain, key ORDER BY created_at, task_id, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


SUMMARY_SQL = """pt AS (SELECT task_id, {by} count(*) AS f, count(*) FILTER (NOT ok) AS fp, count(*) FILTER (removed AND NOT ok) AS rf, count(*) FILTER (removed AND ok) AS ro,
      max(ok::INT) AS hb, max((ok AND NOT removed)::INT) AS ha FROM mk GROUP BY ALL)
    SELECT {by} count(*) AS tasks, sum(f)::BIGINT AS flags, sum(fp)::BIGINT AS fp, sum(rf)::BIGINT AS removed_fp, sum(ro)::BIGINT AS removed_ok, sum(hb)::BIGINT AS hit_before, sum(ha)::BIGINT AS hit_after,
      count(*) FILTER (rf + ro > 0) AS tasks_touched FROM pt GROUP BY ALL"""
ORDER = ["created_at", "task_id", "rank"]


def _veto_once(t, chain: str, level: str, ks=(1, 2, 3)):
    """All k from one running count: the marks differ only in the threshold."""
    seen = G.veto_marks(_flags(t, chain, level), 1, "chain", "key", ORDER, TASK_BUCKET).drop("removed")
    grid = seen.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    marked = grid.withColumn("removed", (F.col("wrong_before") >= F.col("k")) & (F.col("right_before") == 0))
    return G.veto_summary(marked, "task_id", ["k"])


for _name, _chain, _level in (("veto_filter_file", "chain_id", "file"), ("veto_filter_function", "grp", "function")):
    query(_name, with_views("pred gold tk", _flags_sql(_chain, _level) + ", mk AS (SELECT *, wrong_before >= k AND right_before = 0 AS removed FROM wr CROSS JOIN (VALUES (1),(2),(3)) v(k)),\n" + SUMMARY_SQL.format(by="k,")))(
        lambda t, c=_chain, lv=_level: _veto_once(t, c, lv))


@query("veto_protected", with_views("pred gold tk", _flags_sql("grp", "function") + ", mk AS (SELECT *, wrong_before >= 2 AND right_before = 0 AND (rank > 1 OR variant = 'U') AS removed FROM wr CROSS JOIN (VALUES ('P'),('U')) v(variant)),\n" + SUMMARY_SQL.format(by="variant,")))
def veto_protected(t):
    seen = G.veto_marks(_flags(t, "grp", "function"), 2, "chain", "key", ORDER, TASK_BUCKET)
    both = seen.select("*", F.explode(F.array(F.lit("P"), F.lit("U"))).alias("variant"))
    return G.veto_summary(both.withColumn("removed", F.col("removed") & ((F.col("rank") > 1) | (F.col("variant") == "U"))), "task_id", ["variant"])


@query("placebo_removal", with_views("pred gold tk", _flags_sql("grp", "function") + """, vm AS (SELECT *, wrong_before >= 2 AND right_before = 0 AND rank > 1 AS removed FROM wr),
    n AS (SELECT task_id, count(*) FILTER (removed) AS n FROM vm GROUP BY 1),
    dr AS (SELECT vm.task_id, rank, row_number() OVER (PARTITION BY vm.task_id ORDER BY ('0x'||substr(md5('13:' || vm.task_id || ':' || rank),1,15))::BIGINT, rank) AS rn FROM vm WHERE rank > 1),
    mk AS (SELECT vm.task_id, vm.rank, vm.ok, dr.rn IS NOT NULL AND dr.rn <= n.n AS removed FROM vm JOIN n ON vm.task_id = n.task_id LEFT JOIN dr ON vm.task_id = dr.task_id AND vm.rank = dr.rank),
    """ + SUMMARY_SQL.format(by="")))
def placebo_removal(t):
    marked = G.veto_marks(_flags(t, "grp", "function"), 2, "chain", "key", ORDER, TASK_BUCKET, protect_first=True)
    return G.veto_summary(G.placebo_removal(marked, "task_id", "13", True), "task_id")
