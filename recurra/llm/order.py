"""Running totals over a whole table in one global order, without one task for all rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise


def running_total(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before a row in ``order`` (which must have no ties, or only between
    equal rows), and ``part``: the range it lies in. Rows are split into ranges, the ranges' totals are added up (one
    row a range, so as many as there are partitions), and a window runs inside each range."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("__v", value.cast("long")))
    totals = ranged.groupBy("part").agg(F.sum("__v").alias("t"))
    before = totals.select(F.col("part").alias("__p"), F.coalesce(
        F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(before), F.col("part") == F.col("__p"))                 # one row a partition
            .withColumn(name, F.col("__before") + F.coalesce(F.sum("__v").over(inner), F.lit(0))).drop("__p", "__before", "__v"))
