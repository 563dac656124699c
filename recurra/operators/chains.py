"""Chronological chains: positions, spans, splits, statistics, summaries."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.running import position


def chain_positions(tasks: DataFrame, chain: str, created: str, task: str, bucket: str) -> DataFrame:
    """``ord`` (1-based, by date then id) and ``chain_len`` for every task."""
    lengths = tasks.groupBy(chain).agg(F.count("*").alias("chain_len"))
    return position(tasks, [chain], [created, task], bucket, "ord").join(lengths, chain)


def chain_table(tasks: DataFrame, chain: str, created: str, min_build: int = 20, min_eval: int = 10) -> DataFrame:
    """One row per chain: length, first and last date, span in days, eligibility."""
    return (tasks.groupBy(chain)
            .agg(F.count("*").alias("n_tasks"), F.to_date(F.min(created)).alias("first_day"), F.to_date(F.max(created)).alias("last_day"))
            .withColumn("span_days", F.datediff("last_day", "first_day"))
            .withColumn("eligible", F.col("n_tasks") >= min_build + min_eval))


def chain_stats(chain_lengths: DataFrame, length: str, at_least: Sequence[int], eligible_at: int) -> DataFrame:
    """Counts, exact median and number of chains at or above each length.

    Lengths are first counted per distinct value, so the median needs only
    the (small) length histogram, not the chains.
    """
    cum = _cumulative(chain_lengths.select(F.col(length).alias("n")), "n")
    n, c = F.col("n"), F.col("c")
    out = cum.agg(F.sum("c").alias("n_chains"), F.sum(n * c).alias("n_tasks"),
                  *[F.sum(F.when(n >= k, c).otherwise(0)).alias(f"ge_{k}") for k in at_least], F.sum(F.when(n >= eligible_at, c).otherwise(0)).alias("n_eligible"),
                  F.min(F.when(F.col("upto") >= F.floor((F.col("total") + 1) / 2), n)).alias("__lo"), F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, n)).alias("__hi"))
    return out.withColumn("median_len", (F.col("__lo") + F.col("__hi")) / 2).drop("__lo", "__hi")


def _cumulative(values: DataFrame, name: str) -> DataFrame:
    """(value, c, upto, total): a histogram with running counts. Its size is the number of distinct values."""
    hist = values.groupBy(name).agg(F.count("*").alias("c"))
    w = Window.orderBy(name)
    return hist.select(name, "c", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                       F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))


def split_by_rule(chain_lengths: DataFrame, chain: str, length: str, rule: Sequence[tuple[int, int]],
                  default_build: int, min_eval: int) -> DataFrame:
    """Build size per chain: the one of the highest threshold not above its length; short chains marked."""
    build = F.lit(default_build)
    for threshold, size in sorted(rule):
        build = F.when(F.col(length) >= threshold, F.lit(size)).otherwise(build)
    return (chain_lengths.select(chain, length, build.alias("build"))
            .withColumn("kept", F.col(length) >= F.col("build") + min_eval))


def top_n_with_rest(table: DataFrame, order: Sequence[Column], label: str, value: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` and one row summing what is left."""
    top = table.orderBy(*order).limit(n).select(F.col(label).cast("string").alias(label), value, F.lit(1).cast("long").alias("n_rows"))
    shown = top.agg(F.struct(F.count("*").alias("n"), F.sum(value).alias("v")).alias("s"))
    rest = (table.agg(F.count("*").alias("n"), F.sum(value).alias("v")).withColumn("s", shown.scalar()).filter("n > s.n")
            .select(F.lit("(rest)").alias(label), (F.col("v") - F.col("s.v")).alias(value), (F.col("n") - F.col("s.n")).alias("n_rows")))
    return top.unionByName(rest)


def head_per_group(tasks: DataFrame, group: str, order: Sequence[Column | str], n: int, limit: int | None = None) -> DataFrame:
    """Earliest ``n`` rows per group (each task keeps only its own best n before the shuffle), then a global cut."""
    w = Window.partitionBy(group).orderBy(*order)
    out = tasks.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return out.orderBy(group, "rn").limit(limit) if limit is not None else out


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows whose seeded hash is smallest."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def upper_median(sizes: DataFrame, size: str) -> DataFrame:
    """``sorted[n // 2]`` from a histogram of sizes."""
    cum = _cumulative(sizes.select(F.col(size).alias("value")), "value")
    return cum.filter(F.col("upto") >= F.floor(F.col("total") / 2) + 1).agg(F.min("value").alias("upper_median"))
