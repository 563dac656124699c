"""Rows that arrive too late for their event time."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.running import asof_latest


def mark_late(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str], bucket: str, ts: str, delay_days: int) -> DataFrame:
    """``late`` and ``reason``: the row is older than the latest event seen so far minus the delay."""
    x = asof_latest(rows, keys, arrival, bucket, ts, "__seen")
    late = F.col(ts) < F.col("__seen") - F.expr(f"interval {delay_days} days")
    return x.withColumn("late", late).withColumn("reason", F.when(late, F.lit(f"more than {delay_days} days behind")).otherwise(F.lit(""))).drop("__seen")
