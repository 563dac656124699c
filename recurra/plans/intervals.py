"""Interval and patch-section queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I, sections as D
from .bindings import with_views
from .registry import query

IDS = ["task_id", "path", "start_line", "end_line"]
SYM = "CASE WHEN task_id % 2 = 0 THEN '' ELSE 's' || task_id END"


@query("interval_overlap", with_views("hunks spans", f"h AS (SELECT *, {SYM} AS symbol FROM hunks) SELECT task_id, h.path, h.start_line, h.end_line, qualname FROM h JOIN spans s ON h.path = s.path AND h.start_line - 3 <= s.end_line AND s.start_line - 3 <= h.end_line AND (symbol = '' OR symbol = qualname)"))
def interval_overlap(t):
    h = t.hunks.withColumn("symbol", F.expr(SYM))
    s = t.spans.withColumn("symbol", F.col("qualname"))
    return I.overlap_join(h, s, slack=3, symbols=True).select(*IDS, F.col("r_qualname").alias("qualname"))


@query("innermost_span", with_views("hunks spans", """p AS (SELECT DISTINCT path, start_line AS line FROM hunks),
  j AS (SELECT p.path, line, qualname, row_number() OVER (PARTITION BY p.path, line ORDER BY end_line - start_line, start_line, qualname) AS rn FROM p JOIN spans s ON p.path = s.path AND line BETWEEN start_line AND end_line)
  SELECT p.path, p.line, coalesce(qualname, '<module>') AS qualname FROM p LEFT JOIN j ON p.path = j.path AND p.line = j.line AND rn = 1"""))
def innermost_span(t):
    return I.innermost(t.hunks.select("path", F.col("start_line").alias("line")).distinct(), t.spans, [])


RANGE_SQL = """sp AS (SELECT * FROM spans),
  ln_ AS (SELECT *, unnest(range(greatest(start_line, 1), greatest(end_line, start_line, 1) + 1)) AS line FROM hunks),
  dl AS (SELECT DISTINCT path, line FROM ln_),
  bs AS (SELECT d.path, d.line, arg_min(qualname, (s.end_line - s.start_line, s.start_line, qualname)) AS q FROM dl d JOIN sp s ON d.path = s.path AND line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2),
  sy AS (SELECT task_id, l.path, start_line, end_line, coalesce(q, '<module>') AS symbol, min(l.line) AS first_line FROM ln_ l LEFT JOIN bs ON l.path = bs.path AND l.line = bs.line GROUP BY 1, 2, 3, 4, 5)"""


@query("range_symbols", with_views("hunks spans", RANGE_SQL + " SELECT *, row_number() OVER (PARTITION BY task_id, path, start_line, end_line ORDER BY first_line) AS pos FROM sy"))
def range_symbols(t):
    return I.range_symbols(t.hunks, t.spans, IDS)


@query("symbolise", with_views("hunks spans", RANGE_SQL + " SELECT DISTINCT task_id, sy.path, coalesce(sp.start_line, sy.start_line) AS start_line, coalesce(sp.end_line, sy.end_line) AS end_line, symbol FROM sy LEFT JOIN sp ON sp.path = sy.path AND sp.qualname = symbol"))
def symbolise(t):
    return I.symbolise(t.hunks, t.spans, IDS)


# -- patches built from the order lines: the rows are the truth the parser has to find again
PATH = "CASE l_returnflag WHEN 'R' THEN lower(p_type) || '/' || p_brand || '.py' WHEN 'A' THEN 'tests/' || p_brand || '.py' ELSE 'docs/' || p_brand || '.md' END"
PX_SQL = f"px AS (SELECT DISTINCT l_orderkey AS task_id, replace({PATH}, '#', '') AS path, l_partkey AS start_line, l_quantity::INT AS q FROM lineitem JOIN part ON l_partkey = p_partkey)"


def patches(t):
    li = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select(F.col("l_orderkey").alias("task_id"), F.replace(F.expr(PATH), F.lit("#"), F.lit("")).alias("path"), F.col("l_partkey").alias("s"), F.col("l_quantity").cast("int").alias("q")).distinct()
    span = F.when(F.col("q") % 10 == 0, F.col("s").cast("string")).otherwise(F.concat(F.col("s").cast("string"), F.lit(","), F.when(F.col("q") % 7 == 0, "0").otherwise(F.col("q").cast("string"))))
    old = F.when(F.col("q") % 3 == 0, F.concat(F.lit("old/"), F.col("path"))).otherwise(F.col("path"))
    text = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), old, F.lit("\n--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"), F.lit("\n@@ -"), span, F.lit(" +1,2 @@ def f():\n-x @@ -9,9 +9,9 @@\n+diff --git a/no b/no\n"))
    parts = rows.select("task_id", F.struct("s", "q", "path", text.alias("text")).alias("p"))
    return parts.groupBy("task_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p.getField("text")), "").alias("patch"))


@query("patch_files", "WITH " + PX_SQL + " SELECT DISTINCT task_id, path FROM px")
def patch_files(t):
    return D.patch_files(patches(t), "task_id", "patch")


@query("patch_hunks", "WITH " + PX_SQL + " SELECT task_id, path, start_line, start_line + greatest(CASE WHEN q % 10 = 0 THEN 1 WHEN q % 7 = 0 THEN 0 ELSE q END, 1) - 1 AS end_line FROM px")
def patch_hunks(t):
    return D.patch_hunks(patches(t), "task_id", "patch")


@query("gold_keys", "WITH " + PX_SQL + " SELECT task_id, list(DISTINCT path ORDER BY path) FILTER (suffix(path, '.py') AND NOT starts_with(path, 'tests/')) AS keys FROM px GROUP BY 1")
def gold_keys(t):
    return D.gold_keys(patches(t), "task_id", "patch", (".py",))


@query("dual_extract_agreement", "WITH " + PX_SQL + " SELECT count(DISTINCT task_id) AS n, count(DISTINCT task_id) AS agree FROM px")
def dual_extract_agreement(t):
    p = patches(t)
    both = D.gold_keys(p, "task_id", "patch").join(D.independent_files(p, "task_id", "patch").withColumnRenamed("keys", "other"), "task_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("keys").eqNullSafe(F.col("other"))).alias("agree"))


@query("source_sections", "WITH " + PX_SQL + ", s AS (SELECT task_id, count(*) FILTER (suffix(path, '.py') AND NOT starts_with(path, 'tests/')) AS n_sections FROM px GROUP BY 1) SELECT * FROM s")
def source_sections(t):
    p = patches(t).select("task_id", D.source_sections(F.col("patch"), (".py",)).alias("patch"))
    return p.select("task_id", (F.size(F.split(F.concat(F.lit("\n"), "patch"), "\ndiff --git ")) - 1).cast("long").alias("n_sections"))


@query("sectioned_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos FROM l)
  SELECT doc_id, pos, md5(ls[(pos // 5) * 5 + 1]) AS header_md5, md5(ls[pos + 1]) AS line_md5 FROM e""")
def sectioned_lines(t):
    x = D.lines_under_headers(t.raw("documents"), "doc_id", "text", 5)
    return x.select("doc_id", "pos", F.md5("header").alias("header_md5"), F.md5("line").alias("line_md5"))
