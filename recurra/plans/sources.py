"""Source and sink queries."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, scratch_dir
from ..sources import memo, records as S
from ..operators.chains import seeded_sample, upper_median
from .bindings import with_views
from .registry import query

ORDERS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                       T.StructField("o_orderdate", T.TimestampType()), T.StructField("o_orderpriority", T.StringType())])


@query("scan_tasks", "SELECT o_orderkey AS task_id, o_custkey AS chain_id, strftime(o_orderdate,'%Y-%m-%d') AS created_at, o_orderpriority AS note FROM orders")
def scan_tasks(t):
    df = S.read_records(t.spark, f"{t.path}/orders.parquet", ORDERS)
    return df.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("chain_id"),
                     F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderpriority").alias("note"))


@query("validate_required", """SELECT doc_id, reason = '' AS ok, reason FROM (
  SELECT d.doc_id, CASE WHEN quality IS NULL OR coalesce(text,'') = '' THEN 'missing ' || concat_ws(',', CASE WHEN coalesce(text,'') = '' THEN 'text' END, CASE WHEN quality IS NULL THEN 'quality' END) ELSE '' END AS reason
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def validate_required(t):
    d = t.raw("documents").join(t.raw("labels"), "doc_id", "left")
    return S.check_required(d, ["text", "lang", "quality"]).select("doc_id", "ok", "reason")


@query("dedup_keep_first", """SELECT l_orderkey, l_linenumber, l_partkey, n_dropped FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) - 1 AS n_dropped,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_keep_first(t):
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return S.keep_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "n_dropped")


@query("union_splits_first_wins", """WITH u AS (SELECT 'urgent' AS split, 0 AS s, o_custkey AS id, o_orderdate, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'full', 1, o_custkey, o_orderdate, o_orderkey FROM orders)
  SELECT id, split, o_orderkey, n_dropped FROM (SELECT *, count(*) OVER (PARTITION BY id) - 1 AS n_dropped, row_number() OVER (PARTITION BY id ORDER BY s, o_orderdate, o_orderkey) AS rn FROM u) WHERE rn = 1""")
def union_splits_first_wins(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey", "o_orderpriority")
    full = o.drop("o_orderpriority")
    urgent = o.filter(F.col("o_orderpriority") == "1-URGENT").drop("o_orderpriority")
    return S.union_splits([("urgent", urgent), ("full", full)], ["id"], ["o_orderdate", "o_orderkey"]).select("id", "split", "o_orderkey", "n_dropped")


@query("sink_roundtrip", with_views("tk", "SELECT task_id, chain_id, grp, strftime(created_at,'%Y-%m-%d') AS created_at FROM tk"))
def sink_roundtrip(t):
    path = scratch_dir(t.spark)
    df = t.tasks.select("task_id", "chain_id", "grp", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))
    S.write_sorted_json(df, path, ["grp", "created_at", "task_id"])
    return S.read_records(t.spark, path, df.schema, "jsonl").filter(F.col(S.CORRUPT).isNull()).drop(S.CORRUPT)


@query("csv_roundtrip", """SELECT doc_id, lang, text FROM (SELECT doc_id, lang, text FROM documents
  ORDER BY md5('s'||doc_id), doc_id LIMIT 200)""")
def csv_roundtrip(t):
    df = seeded_sample(t.raw("documents").select("doc_id", "lang", "text"), "doc_id", "s", 200)
    path = scratch_dir(t.spark)
    S.write_csv(df, path)
    return S.read_records(t.spark, path, df.schema, "csv").fillna("", ["text"])


@query("arms_explode", with_views("pred", "SELECT arm, task_id, rank, fkey FROM pred"))
def arms_explode(t):
    lists = t.pred.groupBy("task_id", "arm").agg(F.sort_array(F.collect_list(F.struct("rank", "fkey"))).alias("f"))
    nested = lists.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("arm", F.col("f.fkey")))).alias("arms"))
    path = scratch_dir(t.spark)
    nested.write.json(path)
    schema = T.StructType([T.StructField("task_id", T.LongType()), T.StructField("arms", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
    return S.explode_arms(t.spark.read.schema(schema).json(path), "task_id")


@query("memo_incremental", """WITH memo AS (SELECT DISTINCT text FROM documents WHERE lang = 'en'), r AS (SELECT DISTINCT text FROM documents)
  SELECT CASE WHEN memo.text IS NULL THEN 'miss' ELSE 'hit' END AS status, count(*) AS n, sum(length(r.text))::BIGINT AS total FROM r LEFT JOIN memo ON r.text = memo.text GROUP BY 1""")
def memo_incremental(t):
    d = t.raw("documents").select("lang", "text", memo.memo_key("length", F.col("text")).alias("key"))
    stored = d.filter("lang = 'en'").dropDuplicates(["key"]).select("key", F.length("text").alias("value"))
    return memo.extend_memo(d, stored, F.length("text")).groupBy("status").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("corpus_from_changes", with_views("tk gold", """g AS (SELECT DISTINCT task_id FROM gold),
  c AS (SELECT tk.task_id, CASE WHEN ord = 1 THEN 'no_parent' WHEN g.task_id IS NULL THEN 'no_source_gold' WHEN len(string_split(o_orderpriority,' ')) < 2 AND o_orderpriority <> '1-URGENT' THEN 'short_message' END AS r
     FROM tk LEFT JOIN g ON tk.task_id = g.task_id JOIN orders ON o_orderkey = tk.task_id)
  SELECT coalesce(r, 'kept') AS drop_reason, count(*) AS n FROM c GROUP BY 1"""))
def corpus_from_changes(t):
    has_gold = t.gold.select("task_id").distinct().withColumn("g", F.lit(1))
    ch = t.tk.join(has_gold, "task_id", "left").join(t.raw("orders").select(F.col("o_orderkey").alias("task_id"), "o_orderpriority"), "task_id")
    short = (F.size(F.split("o_orderpriority", " ")) < 2) & (F.col("o_orderpriority") != "1-URGENT")
    marked = S.corpus_from_changes(ch, [("no_parent", F.col("ord") == 1), ("no_source_gold", F.col("g").isNull()), ("short_message", short)])
    return marked.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


@query("corpus_report", with_views("tk gold", """g AS (SELECT DISTINCT task_id FROM gold), z AS (SELECT task_id, count(*) AS size FROM ln GROUP BY 1),
  c AS (SELECT tk.task_id, size, CASE WHEN ord = 1 THEN 'no_parent' WHEN g.task_id IS NULL THEN 'no_source_gold' END AS r FROM tk LEFT JOIN g ON tk.task_id = g.task_id LEFT JOIN z ON z.task_id = tk.task_id),
  m AS (SELECT size, row_number() OVER (ORDER BY size) AS rn, count(*) OVER () AS n FROM c WHERE r IS NULL)
  SELECT count(*) AS seen, count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r = 'no_parent') AS no_parent, count(*) FILTER (r = 'no_source_gold') AS no_source_gold, (SELECT min(size) FILTER (rn = n // 2 + 1) FROM m) AS upper_median FROM c"""))
def corpus_report(t):
    """Rows kept and dropped by reason, and the upper median of the kept ones' sizes, in one pass and a histogram."""
    has_gold = t.gold.select("task_id").distinct().withColumn("g", F.lit(1))
    size = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count(F.lit(1)).alias("size"))
    ch = t.tk.join(has_gold, "task_id", "left").join(size, "task_id", "left")
    marked = materialise(S.corpus_from_changes(ch, [("no_parent", F.col("ord") == 1), ("no_source_gold", F.col("g").isNull())]).select("drop_reason", "size"))
    counts = marked.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), *[F.count_if(F.col("drop_reason") == r).alias(r) for r in ("no_parent", "no_source_gold")])
    median = upper_median(marked.filter("drop_reason IS NULL"), "size")
    return counts.withColumn("k", F.lit(1)).join(median.withColumn("k", F.lit(1)), "k").drop("k")
