"""The package's input views over the test tables, in Spark and as SQL text."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import chains, metrics

ARMS = ("control", "treatment", "placebo")
NEGATIVE_CONTROL = "NATION_7"
TASK_BUCKET = "trunc(created_at, 'month')"


class Tables:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def tasks(self) -> DataFrame:
        """task_id, chain_id, grp, created_at."""
        groups = (self.raw("customer").select("c_custkey", "c_nationkey")
                  .join(self.raw("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
        return (self.raw("orders").join(groups, F.col("o_custkey") == F.col("c_custkey"))
                .select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("chain_id"),
                        F.col("n_name").alias("grp"), F.col("o_orderdate").alias("created_at")))

    @cached_property
    def tk(self) -> DataFrame:
        """``tasks`` with position ``ord`` and ``chain_len``."""
        return chains.chain_positions(self.tasks, "chain_id", "created_at", "task_id", TASK_BUCKET)

    @cached_property
    def keys(self) -> DataFrame:
        """Location key of every part."""
        return self.raw("part").select("p_partkey", F.concat_ws("", "p_type", F.lit("::"), F.substring("p_brand", 1, 7), F.lit("."), F.expr("substr(p_brand, 8)")).alias("fkey"))

    @cached_property
    def ln(self) -> DataFrame:
        """Touched locations: every line of every task."""
        return self.raw("lineitem").join(self.keys, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_orderkey", "task_id")

    @cached_property
    def gold(self) -> DataFrame:
        return self.ln.filter(F.col("l_returnflag") == "R").select("task_id", "fkey").distinct()

    @cached_property
    def pred(self) -> DataFrame:
        """Top three locations per task for each arm: arm, task_id, rank, fkey."""
        wide = self.raw("lineitem").select(F.col("l_orderkey").alias("task_id"), "l_partkey", "l_suppkey", "l_linenumber", F.inline(F.array(
            F.struct(F.lit("control").alias("arm"), F.col("l_extendedprice").alias("score")),
            F.struct(F.lit("treatment").alias("arm"), F.col("l_quantity").alias("score")),
            F.struct(F.lit("placebo").alias("arm"), F.col("l_discount").alias("score")))))
        w = Window.partitionBy("arm", "task_id").orderBy(F.col("score").desc(), "l_partkey", "l_suppkey", "l_linenumber")
        top = wide.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
        return top.join(self.keys, F.col("l_partkey") == F.col("p_partkey")).select("arm", "task_id", "rank", "fkey")

    @cached_property
    def outcome(self) -> DataFrame:
        """Flags of tasks with known truth: arm, task_id, rank, key, ok."""
        return metrics.outcomes(self.pred, self.gold)

    @cached_property
    def hit(self) -> DataFrame:
        """Per arm and task: hit, n_flags, n_fp, with grp, chain_id, created_at."""
        return metrics.hits(self.outcome).join(self.tasks, "task_id")

    @cached_property
    def rec(self) -> DataFrame:
        e = self.raw("events")
        loc = F.concat(F.lit("k"), F.expr("cast(get_json_object(props, '$.k') as int) div 10"))
        return e.select(
            F.col("event_id").alias("record_id"), F.col("user_id").alias("chain_id"), loc.alias("loc"), "ts",
            F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("d"),
            F.date_format("ts", "yyyy-MM-dd").alias("input_hash"),
            F.concat(F.lit("agent-"), (F.col("event_id") % 3).cast("string")).alias("agent_id"),
            F.when(F.col("event_type") == "error", "bad").when(F.col("event_type").isin("click", "view"), "good").otherwise("unknown").alias("label"),
            F.concat(F.col("event_type"), F.lit(" => "), loc, F.lit(" :: v"), F.floor("value").cast("string")).alias("content"))

    @cached_property
    def doc(self) -> DataFrame:
        """doc_id, text, lang, source, label (quality 0 -> bad, 1 -> good, none -> unknown)."""
        return (self.raw("documents").join(self.raw("labels").select("doc_id", "quality"), "doc_id", "left")
                .select("doc_id", "text", "lang", "source",
                        F.when(F.col("quality") == 0, "bad").when(F.col("quality") == 1, "good").otherwise("unknown").alias("label")))

    @cached_property
    def spans(self) -> DataFrame:
        """Named intervals per chain: one per task, [order day, order day + price band]."""
        day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
        return self.raw("orders").select(
            F.col("o_custkey").cast("string").alias("path"), F.concat(F.lit("s"), "o_orderkey").alias("qualname"),
            day.alias("start_line"), (day + F.floor(F.col("o_totalprice") / 5000).cast("int")).alias("end_line"))

    @cached_property
    def hunks(self) -> DataFrame:
        """Changed ranges per chain: one per task line, [ship day, ship day + quantity]."""
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date"))
        return (self.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.col("l_orderkey").alias("task_id"), F.col("o_custkey").cast("string").alias("path"),
                        day.alias("start_line"), (day + F.col("l_quantity").cast("int")).alias("end_line")).distinct())


# The same views as SQL. Every text may use the ones named in DEPS.
CTE = {
    "tk": """tk AS (SELECT o_orderkey AS task_id, o_custkey AS chain_id, n_name AS grp, o_orderdate AS created_at,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord,
      count(*) OVER (PARTITION BY o_custkey) AS chain_len
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "ln": """ln AS (SELECT l_orderkey AS task_id, p_type || '::' || substr(p_brand,1,7) || '.' || substr(p_brand,8) AS fkey, lineitem.*
    FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "gold": "gold AS (SELECT DISTINCT task_id, fkey FROM ln WHERE l_returnflag = 'R')",
    "pred": """pred AS (SELECT arm, task_id, rank, fkey FROM (
      SELECT arm, task_id, fkey, row_number() OVER (PARTITION BY arm, task_id ORDER BY score DESC, l_partkey, l_suppkey, l_linenumber) AS rank FROM (
        SELECT 'control' AS arm, task_id, fkey, l_extendedprice AS score, l_partkey, l_suppkey, l_linenumber FROM ln
        UNION ALL SELECT 'treatment', task_id, fkey, l_quantity, l_partkey, l_suppkey, l_linenumber FROM ln
        UNION ALL SELECT 'placebo', task_id, fkey, l_discount, l_partkey, l_suppkey, l_linenumber FROM ln)) WHERE rank <= 3)""",
    "rec": """rec AS (SELECT *, event_type || ' => ' || loc || ' :: v' || floor(value)::BIGINT AS content FROM (
      SELECT event_id AS record_id, user_id AS chain_id, ts, event_type, value,
        'k' || ((json_extract_string(props, '$.k')::INT) // 10) AS loc,
        date_diff('day', DATE '2024-01-01', ts::DATE) AS d, strftime(ts, '%Y-%m-%d') AS input_hash,
        'agent-' || (event_id % 3) AS agent_id,
        CASE WHEN event_type = 'error' THEN 'bad' WHEN event_type IN ('click','view') THEN 'good' ELSE 'unknown' END AS label
      FROM events))""",
    "doc": """doc AS (SELECT documents.doc_id, text, lang, source,
      CASE WHEN quality = 0 THEN 'bad' WHEN quality = 1 THEN 'good' ELSE 'unknown' END AS label
    FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)""",
    "spans": """spans AS (SELECT o_custkey::VARCHAR AS path, 's' || o_orderkey AS qualname,
      date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS start_line,
      date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + floor(o_totalprice/5000)::INT AS end_line FROM orders)""",
    "hunks": """hunks AS (SELECT DISTINCT l_orderkey AS task_id, o_custkey::VARCHAR AS path,
      date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS start_line,
      date_diff('day', DATE '1995-01-01', l_shipdate::DATE) + l_quantity::INT AS end_line
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "outcome": """outcome AS (SELECT p.arm, p.task_id, p.rank, p.fkey, g.fkey IS NOT NULL AS ok
      FROM pred p JOIN (SELECT DISTINCT task_id FROM gold) t ON p.task_id = t.task_id
      LEFT JOIN gold g ON p.task_id = g.task_id AND p.fkey = g.fkey)""",
    "hit": """hit AS (SELECT o.arm, o.task_id, tk.grp, tk.chain_id, tk.ord, bool_or(ok) AS hit, count(*) AS n_flags, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS n_fp
      FROM outcome o JOIN tk ON o.task_id = tk.task_id GROUP BY ALL)""",
}
DEPS = {"gold": ("ln",), "pred": ("ln",), "outcome": ("pred", "gold"), "hit": ("outcome", "tk")}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` (which may start with further ``name AS (...)``, then SELECT) with the named views."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in DEPS.get(n, ()):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names.split():
        add(n)
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    sep = ",\n" if body[:1].islower() and " AS " in body.split("(", 1)[0] else "\n"
    return head + ",\n".join(CTE[n] for n in ordered) + sep + body


def file_sql(c: str) -> str:
    return f"split_part({c}, '::', 1)"


def class_sql(c: str) -> str:
    return f"split_part({c}, '::', 1) || '::' || split_part(split_part({c}, '::', 2), '.', 1)"


LEVELS_SQL = f"""lk AS (SELECT task_id, 'file' AS level, {file_sql('fkey')} AS key FROM gold
  UNION SELECT task_id, 'class', {class_sql('fkey')} FROM gold UNION SELECT task_id, 'function', fkey FROM gold)"""
