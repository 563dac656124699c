"""Row gates. Every gate keeps all rows and says why a row was refused."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import literal_date
from ..functions.digest import draw
from ..functions.running import running

FREEZE_LINE = r"^([A-Za-z0-9_.\-]+)==([^\s;]+)"


def latest_cutoff(cutoffs: DataFrame, column: str = "cutoff") -> DataFrame:
    """One row: the latest date. An empty table or an unreadable date is an error."""
    c = F.col(column)
    return cutoffs.agg(F.when(F.count("*") == 0, F.raise_error(F.lit("no cut-offs given")).cast("date"))
                       .when(F.count("*") != F.count(c), F.raise_error(F.lit("unreadable cut-off date")).cast("date"))
                       .otherwise(F.max(c)).alias("cutoff"))


def freshness_verdicts(tasks: DataFrame, cutoffs: DataFrame, created: str, margin_days: int = 0) -> DataFrame:
    """``created_day, admitted, reason``: admitted only when strictly after cut-off + margin."""
    one = tasks.select("*", literal_date(F.col(created)).alias("created_day"), latest_cutoff(cutoffs).scalar().alias("__cut"))
    late = F.col("created_day") > F.date_add("__cut", margin_days)
    reason = (F.when(F.col("created_day").isNull(), F.lit(f"missing or unparseable {created}"))
              .when(late, F.lit("fresh"))
              .otherwise(F.concat(F.col("created_day").cast("string"), F.lit(" <= cutoff "), F.col("__cut").cast("string"), F.lit(f" (+{margin_days}d)"))))
    return one.withColumn("admitted", F.coalesce(late, F.lit(False))).withColumn("reason", reason).drop("__cut")


def survivors_by_cutoff(tasks: DataFrame, group: str, day: str, cutoffs: Sequence[str], min_group: int = 20) -> DataFrame:
    """Tasks, groups and groups of at least ``min_group`` left after each cut-off.

    Tasks are counted per group and day first, so the grid multiplies counts, not tasks.
    """
    per_day = tasks.groupBy(group, F.col(day).cast("date").alias("day")).agg(F.count("*").alias("c"))
    grid = per_day.select("*", F.explode(F.array(*[F.lit(c).cast("date") for c in cutoffs])).alias("cutoff")).filter(F.col("day") > F.col("cutoff"))
    per_group = grid.groupBy("cutoff", group).agg(F.sum("c").alias("c"))
    return per_group.groupBy("cutoff").agg(F.sum("c").alias("n_tasks"), F.count("*").alias("n_groups"), F.count_if(F.col("c") >= min_group).alias("n_large_groups"))


def asof_audit(lines: DataFrame, releases: DataFrame, line: str = "line", cutoff: str = "cutoff") -> DataFrame:
    """Pinned ``name==version`` items released after the row's cut-off, or of unknown date.

    ``releases`` has name, version, released. Lines of another shape are ignored.
    """
    text = F.trim(F.col(line))
    parsed = (lines.filter(F.regexp_like(text, F.lit(FREEZE_LINE)))
              .withColumn("name", F.replace(F.lower(F.regexp_extract(text, FREEZE_LINE, 1)), F.lit("_"), F.lit("-")))
              .withColumn("version", F.regexp_extract(text, FREEZE_LINE, 2)))
    found = parsed.join(releases, ["name", "version"], "left")
    bad = F.col("released").isNull() | (F.col("released") > F.col(cutoff))
    return found.filter(bad).withColumn("reason", F.when(F.col("released").isNull(), F.lit("unknown release date")).otherwise(
        F.concat(F.lit("released "), F.col("released").cast("string"), F.lit(" > cutoff "), F.col(cutoff).cast("string"))))


def filter_groups(tasks: DataFrame, group: str, allow: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    out = tasks
    if allow is not None:
        out = out.join(allow.select(group).distinct(), group, "left_semi")
    if exclude is not None:
        out = out.join(exclude.select(group).distinct(), group, "left_anti")
    return out


def ceiling_drop(group_rates: DataFrame, rate: str, ceiling: float) -> DataFrame:
    """Groups whose control rate leaves no room are dropped, with the reason."""
    out = F.coalesce(F.col(rate) >= ceiling, F.lit(False))
    return group_rates.withColumn("dropped", out).withColumn("reason", F.when(out, F.lit(f"control rate >= {ceiling}")).otherwise(F.lit("")))


def clean_ranked(ranked: DataFrame, known: DataFrame, task: str, pos: str, key: str, k: int) -> DataFrame:
    """Known keys only, first occurrence, top ``k`` in order, re-ranked from 1."""
    ok = ranked.join(known.select(task, key).distinct(), [task, key], "left_semi")
    first = ok.groupBy(task, key).agg(F.min(pos).alias("__pos"))
    w = Window.partitionBy(task).orderBy("__pos", key)
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__pos")


def candidate_lists(keys: DataFrame, task: str, key: str, suffix: str, n: int) -> DataFrame:
    """First ``n`` distinct keys with a suffix per task, as one list (bounded by ``n``)."""
    w = Window.partitionBy(task).orderBy(key)
    top = (keys.filter(F.endswith(F.col(key), F.lit(suffix))).select(task, key).distinct()
           .withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n))
    return top.groupBy(task).agg(F.sort_array(F.collect_list(key)).alias("candidates"))


def drop_failed_in_any_arm(results: DataFrame, errors: DataFrame, task: str) -> DataFrame:
    """A task that failed in one arm leaves every arm."""
    return results.join(errors.select(task).distinct(), task, "left_anti")


def veto_marks(flags: DataFrame, k: int, chain: str, key: str, order: Sequence[str], bucket: str, protect_first: bool = False) -> DataFrame:
    """Mark flags whose key was wrong >= k times and never right earlier in its chain.

    ``flags`` has ``chain``, ``key``, ``ok``, rank and the order columns. Removed flags
    count as evidence too. With ``protect_first`` rank 1 is never removed.
    """
    seen = running(flags, [chain, key], order, bucket, {"wrong_before": F.when(~F.col("ok"), 1).otherwise(0), "right_before": F.when(F.col("ok"), 1).otherwise(0)})
    removed = (F.col("wrong_before") >= k) & (F.col("right_before") == 0)
    return seen.withColumn("removed", removed & (F.col("rank") > 1) if protect_first else removed)


def veto_summary(marked: DataFrame, task: str, by: Sequence[str] = ()) -> DataFrame:
    """Flags, false positives, removals and hit rates before and after."""
    ok, gone = F.col("ok"), F.col("removed")
    per_task = marked.groupBy(task, *by).agg(
        F.count("*").alias("f"), F.count_if(~ok).alias("fp"), F.count_if(gone & ~ok).alias("rf"), F.count_if(gone & ok).alias("ro"),
        F.max(ok.cast("int")).alias("hb"), F.max((ok & ~gone).cast("int")).alias("ha"))
    return per_task.groupBy(*by).agg(
        F.count("*").alias("tasks"), F.sum("f").alias("flags"), F.sum("fp").alias("fp"), F.sum("rf").alias("removed_fp"), F.sum("ro").alias("removed_ok"),
        F.sum("hb").alias("hit_before"), F.sum("ha").alias("hit_after"), F.count_if(F.col("rf") + F.col("ro") > 0).alias("tasks_touched"))


def placebo_removal(marked: DataFrame, task: str, seed: str, protect_first: bool) -> DataFrame:
    """Remove as many flags per task as the veto did, drawn from the same eligible ranks.

    Windows over a task's shown flags (a handful), both on one shuffle.
    """
    eligible = F.col("rank") > 1 if protect_first else F.lit(True)
    n = F.sum(F.col("removed").cast("int")).over(Window.partitionBy(task))
    rn = F.row_number().over(Window.partitionBy(task).orderBy(F.when(eligible, 0).otherwise(1), draw(seed, F.col(task), F.col("rank")), "rank"))
    return marked.withColumn("__n", n).withColumn("__rn", rn).withColumn("removed", eligible & (F.col("__rn") <= F.col("__n"))).drop("__n", "__rn")
