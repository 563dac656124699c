"""Stream queries, run to completion over the available rows."""
from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import lateness
from ..session import scratch_dir
from ..streaming import consolidation as S
from .bindings import Tables, with_views
from .consolidate import SEPARATED, TTL_POLICY, ttl_sql
from .registry import query


class _StreamTables(Tables):
    """The same views over file streams."""

    def raw(self, name: str):
        schema = self.spark.read.parquet(f"{self.path}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.path)


def _finish(t, stream, mode: str = "append"):
    base = scratch_dir(t.spark)
    S.run_available(stream, f"{base}/out", f"{base}/ckpt", mode)
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_records(t):
    return _StreamTables(t.spark, t.path).rec


@query("stream_outcomes", with_views("rec", ttl_sql(7, 1) + " SELECT record_id, outcome FROM st", recursive=True))
def stream_outcomes(t):
    out = _finish(t, S.consolidate_stream(stream_records(t), TTL_POLICY, "2024-01-01", "0 seconds"))
    return out.filter("kind = 'record'").select("record_id", "outcome")


@query("stream_dedup", "SELECT event_id AS record_id FROM events")
def stream_dedup(t):
    r = stream_records(t)
    return _finish(t, S.drop_repeated(r.unionByName(r), "60 days").select("record_id"))


@query("tick_counts", with_views("rec", "SELECT ts::DATE AS day, label, count(*) AS n FROM rec GROUP BY 1, 2"))
def tick_counts(t):
    return S.tick_counts(t.rec, "0 seconds")


@query("stream_tick_counts", with_views("rec", "SELECT ts::DATE AS day, label, count(*) AS n FROM rec GROUP BY 1, 2"))
def stream_tick_counts(t):
    """Every day, open ones too: each epoch writes the counts that changed, the last one of a day holds."""
    base = scratch_dir(t.spark)
    S.run_batches(S.tick_counts(stream_records(t), "0 seconds"), S.append_by_epoch(base, lambda b: {"counts": b}), f"{base}/ckpt", "update")
    out = t.spark.read.parquet(f"{base}/counts")
    return out.groupBy("day", "label").agg(F.max_by("n", "epoch").alias("n"))


LATE_SQL = """b AS (SELECT record_id, ts, CASE WHEN record_id % 40 = 0 THEN 4 ELSE record_id * 4 // (SELECT max(record_id) + 1 FROM rec) END AS epoch FROM rec),
  n AS (SELECT epoch, max(ts) AS newest FROM b GROUP BY 1),
  w AS (SELECT record_id, ts < (SELECT max(newest) FROM n WHERE n.epoch < b.epoch) - INTERVAL 5 DAY AS late FROM b)"""


@query("stream_late_rows", with_views("rec", LATE_SQL + " SELECT record_id, CASE WHEN coalesce(late, false) THEN 'more than 432000 seconds behind' ELSE '' END AS reason FROM w"))
def stream_late_rows(t):
    """Five batches with rows out of order: every row is on time or in the side table, none is lost."""
    base = scratch_dir(t.spark)
    r = t.rec.select("record_id", "ts")
    top = r.agg(F.max("record_id") + 1).first()[0]
    epoch = F.when(F.col("record_id") % 40 == 0, 4).otherwise(F.floor(F.col("record_id") * 4 / top))
    for i in range(5):
        r.filter(epoch == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    live = t.spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    S.run_batches(live, S.split_late(base, "ts", 5 * 86400), f"{base}/ckpt")
    on_time = t.spark.read.parquet(f"{base}/on_time").select("record_id", F.lit("").alias("reason"))
    return on_time.unionByName(t.spark.read.parquet(f"{base}/late").select("record_id", "reason"))


SEPARATED_STREAM = ttl_sql(12, 1, "agent-0", True)


@query("stream_outcomes_separated", with_views("rec", SEPARATED_STREAM + " SELECT record_id, outcome FROM st", recursive=True))
def stream_outcomes_separated(t):
    out = _finish(t, S.consolidate_stream(stream_records(t), SEPARATED, "2024-01-01", "0 seconds", contradictions=True))
    return out.filter("kind = 'record'").select("record_id", "outcome")


@query("late_rows", "WITH o AS (SELECT o_orderkey, o_orderdate, max(o_orderdate) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS seen FROM orders) SELECT o_orderkey, o_orderdate < seen - INTERVAL 1000 DAY AS late, CASE WHEN o_orderdate < seen - INTERVAL 1000 DAY THEN 'more than 1000 days behind' ELSE '' END AS reason FROM o")
def late_rows(t):
    o = t.raw("orders").select("o_orderkey", "o_orderdate", F.lit(0).alias("g"))
    return lateness.mark_late(o, ["g"], ["o_orderkey"], "o_orderkey div 4096", "o_orderdate", 1000).select("o_orderkey", "late", "reason")
