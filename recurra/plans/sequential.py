"""Order-dependent consolidation under word similarity (rows-only: not expressible as plain SQL)."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import sequential as Q
from ..operators.consolidate import Policy
from ..operators.paired import recommend_cell
from ..operators.recurrence import expected_redundant
from .registry import query

BASE = Policy(min_occurrences=2, min_inputs=2, schedule=1, ttl=10, theta=0.45, rho=0.6, cluster=0.6)
GRID = {f"{th:.2f}/{rho:.2f}/{cl:.2f}": replace(BASE, ttl=10_000, schedule=10, theta=th, rho=rho, cluster=cl)
        for th in (0.35, 0.5) for rho in (0.65, 0.8) for cl in (0.6, 0.8)}


def records(t):
    return t.rec.withColumn("pattern", F.col("loc"))


@query("ingest_outcomes_jaccard")
def ingest_outcomes_jaccard(t):
    out = Q.consolidate(records(t), {"base": BASE})
    return out.filter("kind = 'record'").select("chain_id", "record_id", "outcome")


@query("threshold_sweep")
def threshold_sweep(t):
    injected = expected_redundant(records(t), ["chain_id", "loc"], ["chain_id"])
    return Q.sweep_table(Q.consolidate(records(t), GRID), GRID, injected)


@query("recommend_cell")
def recommend(t):
    return recommend_cell(threshold_sweep(t))


@query("leader_cluster")
def leader_cluster(t):
    items = records(t).select("chain_id", F.col("record_id").alias("item_id"), "content", "ts")
    return Q.leader_clusters(items, ["ts", "item_id"], 0.6)
