"""Running totals and positions that survive a hot group.

A plain window sends a whole group to one task. Here each group is cut into
time buckets: bucket totals are pre-aggregated (map-side combine), summed
over the earlier buckets, and added to a window inside the bucket only. The
result equals the plain window; no task ever holds more than one bucket.

``bucket`` is a SQL expression that must be non-decreasing along ``order`` (a truncated timestamp, a
position divided by a constant). A NULL key is a group like any other.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

_B = "__bucket"


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join in which NULL keys meet."""
    r = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(r, same).drop(*[f"__k_{k}" for k in keys])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: str,
            sums: Mapping[str, Column], inclusive: bool = False) -> DataFrame:
    """Add one column per entry of ``sums``: its total over the group's earlier rows
    (and the current row when ``inclusive``)."""
    keys = list(keys)
    tagged = df.withColumn(_B, F.expr(bucket))
    for name, expr in sums.items():
        tagged = tagged.withColumn(f"__v_{name}", expr.cast("long"))
    totals = tagged.groupBy(*keys, _B).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _B, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inner = (Window.partitionBy(*keys, _B).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    joined = _on(tagged, offsets, [*keys, _B])
    out = joined.select(*df.columns, *[
        (F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0))).alias(n) for n in sums])
    return out


def position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: str,
             name: str = "ord") -> DataFrame:
    """1-based position of every row in its group (``row_number`` without the single task)."""
    return running(df, keys, order, bucket, {name: F.lit(1)}, inclusive=True)


def ordered_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1-based number of every row in one global order, without one task for all rows: rows are split into ranges (written, so that
    the split holds), counted per range, and numbered inside each. The order must be without ties."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))                     # one row a partition
    before = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(before, F.col("__range") == F.col("__r")).withColumn(name, F.col("__before") + inner).drop("__range", "__r", "__before")


def asof_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: str, value: str, name: str) -> DataFrame:
    """Largest ``value`` among the group's earlier rows and the row itself (NULLs skipped).

    For a value that grows along ``order`` (a version tick) this is the latest one in force.
    """
    keys = list(keys)
    tagged = df.withColumn(_B, F.expr(bucket))
    per = tagged.groupBy(*keys, _B).agg(F.max(value).alias("__m"))
    earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*keys, _B, F.max("__m").over(earlier).alias("__o"))
    inner = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _on(tagged, offsets, [*keys, _B])
    return joined.select(*df.columns, F.greatest(F.max(value).over(inner), F.col("__o")).alias(name))
