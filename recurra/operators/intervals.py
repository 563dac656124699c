"""Interval joins: overlap, innermost enclosing span, symbols of a range."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

BIN = 4096               # lines of a bin where ranges meet the stretches of a path: wide, so that few lie at higher levels
MODULE = "<module>"
WHOLE_FILE = (1, 10 ** 9)


def whole_file(path: Column) -> tuple[Column, Column, Column]:
    return path.alias("path"), F.lit(WHOLE_FILE[0]).alias("start_line"), F.lit(WHOLE_FILE[1]).alias("end_line")


def _levels(side: DataFrame) -> Column:
    """The levels a side's ranges have: an array of at most 64 numbers."""
    return side.agg(F.collect_set("__lvl").alias("l")).scalar()


def overlap_join(left: DataFrame, right: DataFrame, slack: int = 0, bin_width: int = 64, symbols: bool = False, null_path: bool = False) -> DataFrame:
    """Pairs on the same path whose ranges touch (with ``slack``).

    Both sides have path, start_line, end_line and other, distinct column names; the right
    side's come back prefixed ``r_``. With ``null_path`` NULL is a path like any other. With ``symbols`` both also have ``symbol``: an empty one
    matches any, two named ones must be equal. A range has the level at which it lies in one or two bins of
    ``bin_width`` 2^level lines; two ranges meet at the higher of their levels, so a range is repeated once for each higher level that
    the other side has, and a long one is never cut into many bins. A pair is emitted only in the bin where the later range starts.
    """
    def binned(df: DataFrame, start: Column, end: Column) -> DataFrame:
        x = df.withColumn("__lo", F.floor(start / bin_width).cast("long")).withColumn("__hi", F.floor(F.greatest(start, end) / bin_width).cast("long"))
        return x.withColumn("__lvl", F.ceil(F.log2(F.col("__hi") - F.col("__lo") + 1)).cast("int"))

    def placed(df: DataFrame, others: Column, prefix: str) -> DataFrame:
        at = df.withColumn("__others", F.coalesce(others, F.array().cast("array<int>")))
        at = at.withColumn("__at", F.explode(F.array_union(F.array("__lvl"), F.filter("__others", lambda v: v > F.col("__lvl"))))).drop("__others")
        at = at.withColumn("__first", F.expr("shiftright(__lo, __at)"))
        at = at.withColumn("__bin", F.explode(F.sequence("__first", F.expr("shiftright(__hi, __at)"))))
        return at.withColumnsRenamed({c: f"{prefix}{c}" for c in ("__lvl", "__at", "__first", "__bin")}).drop("__lo", "__hi")

    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    l_, r_ = binned(left, F.col("start_line") - slack, F.col("end_line") + slack), binned(r, F.col("r_start_line"), F.col("r_end_line"))
    here, there = placed(l_, _levels(r_), "l"), placed(r_, _levels(l_), "r")
    touch = (F.col("start_line") - slack <= F.col("r_end_line")) & (F.col("r_start_line") - slack <= F.col("end_line"))
    if symbols:
        touch = touch & ((F.coalesce("symbol", F.lit("")) == "") | (F.coalesce("r_symbol", F.lit("")) == "") | (F.col("symbol") == F.col("r_symbol")))
    same = F.col("path").eqNullSafe(F.col("r_path")) if null_path else F.col("path") == F.col("r_path")
    meet = same & (F.col("l__at") == F.col("r__at")) & (F.col("l__bin") == F.col("r__bin"))
    once = (F.col("l__at") == F.greatest("l__lvl", "r__lvl")) & (F.col("l__bin") == F.greatest("l__first", "r__first"))
    return here.join(there, meet & once & touch).select(*left.columns, *r.columns)


def innermost(points: DataFrame, spans: DataFrame, ids: Sequence[str], line: str = "line", bin_width: int = 64) -> DataFrame:
    """Smallest span containing each point (ties: first by start, then name); ``<module>`` if none.

    ``points`` has ``ids``, path and ``line``. Kept as a minimum, so a point under many spans
    needs no sorting.
    """
    p = points.select(*ids, "path", line, F.col(line).alias("start_line"), F.col(line).alias("end_line"))
    found = overlap_join(p, spans.select("path", "qualname", "start_line", "end_line"), 0, bin_width)
    key = list(dict.fromkeys([*ids, "path", line]))
    best = found.groupBy(*key).agg(F.min(F.struct((F.col("r_end_line") - F.col("r_start_line")).alias("w"), F.col("r_start_line").alias("s"), F.col("r_qualname").alias("q"))).alias("b"))
    return points.join(best, key, "left").withColumn("qualname", F.coalesce("b.q", F.lit(MODULE))).drop("b")


def symbol_segments(spans: DataFrame, bin_width: int = 64, paths: DataFrame | None = None, last: Column | None = None) -> DataFrame:
    """Disjoint stretches of each path with their innermost symbol, gaps as ``<module>``.

    Only span boundaries are looked at, so a long range never becomes one row per line. ``paths`` without spans
    are all ``<module>``. The last stretch of a path ends at line ``last`` (none: far away).
    """
    edges = (spans.select("path", F.explode(F.array(F.col("start_line").cast("long"), F.col("end_line").cast("long") + 1, F.lit(1).cast("long"))).alias("start_line"))
             .filter("start_line >= 1"))
    if paths is not None:
        edges = edges.unionByName(paths.select("path", F.lit(1).cast("long").alias("start_line")))
    nxt = F.lead("start_line").over(Window.partitionBy("path").orderBy("start_line"))
    end = F.lit(10 ** 9).cast("long") if last is None else F.greatest("start_line", last.cast("long"))
    segs = edges.distinct().withColumn("end_line", F.coalesce(nxt - 1, end))
    named = innermost(segs.select("path", F.col("start_line").alias("line"), F.col("end_line").alias("seg_end")), spans, ["seg_end"], "line", bin_width)
    return named.select("path", F.col("line").alias("start_line"), F.col("seg_end").alias("end_line"), "qualname")


def _touched(ranges: DataFrame, spans: DataFrame, ids: Sequence[str], bin_width: int) -> DataFrame:
    """ids, symbol, first_line, dealt by ``ids``. The ranges are written once: their levels, paths and last line are read besides themselves."""
    clean = materialise(ranges.select(F.struct(*ids).alias("rid"), "path", F.greatest(F.col("start_line"), F.lit(1)).alias("start_line"),
                                      F.greatest(F.col("end_line"), F.col("start_line"), F.lit(1)).alias("end_line")))
    last = clean.agg(F.max("end_line").alias("m")).scalar()
    segments = symbol_segments(spans.filter("path IS NOT NULL"), bin_width, clean.select("path").distinct(), last)
    hit = overlap_join(clean, segments, 0, bin_width, null_path=True)
    hit = hit.select("rid.*", F.col("r_qualname").alias("symbol"), F.greatest("start_line", "r_start_line").alias("first_line"))
    return hit.repartition(*ids).groupBy(*ids, "symbol").agg(F.min("first_line").alias("first_line"))


def range_symbols(ranges: DataFrame, spans: DataFrame, ids: Sequence[str], bin_width: int = BIN) -> DataFrame:
    """Symbols touched by each range, numbered in line order: ids, symbol, first_line, pos.

    ``ids`` identify a range. Lines start at 1; a path without spans is all ``<module>``.
    """
    return _touched(ranges, spans, ids, bin_width).withColumn("pos", F.row_number().over(Window.partitionBy(*ids).orderBy("first_line")))


def symbolise(ranges: DataFrame, spans: DataFrame, ids: Sequence[str], bin_width: int = BIN) -> DataFrame:
    """One location per touched symbol: the span's own lines, or the range itself under ``<module>``."""
    sym = _touched(ranges, spans, ids, bin_width).select(*ids, "symbol")
    own = spans.groupBy("path", "qualname").agg(F.max(F.struct("start_line", "end_line")).alias("sp"))
    keep = list(dict.fromkeys([*ids, "path", "start_line", "end_line"]))
    # ids that hold the lines themselves need not meet the ranges again
    x = sym.dropna(subset=list(ids)) if set(keep) == set(ids) else ranges.select(*keep).join(sym, list(ids))
    x = x.join(own.withColumnRenamed("qualname", "symbol"), ["path", "symbol"], "left")
    rest = [c for c in ids if c not in ("path", "start_line", "end_line")]
    return x.select(*rest, "path", F.coalesce("sp.start_line", "start_line").alias("start_line"), F.coalesce("sp.end_line", "end_line").alias("end_line"), "symbol").distinct()
