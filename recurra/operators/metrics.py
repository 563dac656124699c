"""Outcome labels and the quality metrics computed from them.

Common inputs: ``pred`` (arm, task_id, rank, fkey) and ``gold`` (task_id, fkey).
A task without gold rows has unknown truth and is outside the metrics.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import key_at
from ..functions.running import running


def _rate(num: Column, den: Column, digits: int = 4) -> Column:
    return F.round(F.when(den > 0, num / den).otherwise(F.lit(0.0)), digits)


def match_flags(pred: DataFrame, gold: DataFrame, level: str = "function") -> DataFrame:
    """Every flag with ``key``, ``has_truth`` and ``ok``."""
    truth = gold.select("task_id", key_at(level, F.col("fkey")).alias("key")).distinct()
    flags = pred.withColumn("key", key_at(level, F.col("fkey")))
    known = gold.select("task_id").distinct().withColumn("has_truth", F.lit(True))
    return (flags.join(known, "task_id", "left").join(truth.withColumn("__m", F.lit(True)), ["task_id", "key"], "left")
            .withColumn("has_truth", F.coalesce("has_truth", F.lit(False))).withColumn("ok", F.col("__m").isNotNull()).drop("__m"))


def outcomes(pred: DataFrame, gold: DataFrame, level: str = "function") -> DataFrame:
    """Flags of tasks with known truth."""
    return match_flags(pred, gold, level).filter("has_truth").drop("has_truth")


def label_outcomes(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """``bad`` when the flag names a true location, ``good`` when not, ``unknown`` without truth."""
    return match_flags(pred, gold).withColumn("label", F.when(~F.col("has_truth"), "unknown").when(F.col("ok"), "bad").otherwise("good"))


def hits(flags: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per arm and task: hit, n_flags, n_fp."""
    return flags.groupBy("arm", "task_id", *extra).agg(
        (F.max(F.col("ok").cast("int")) == 1).alias("hit"), F.count("*").alias("n_flags"), F.count_if(~F.col("ok")).alias("n_fp"))


METRIC_SUMS = ("n_tasks", "n_localized", "n_flags", "n_false_positive")


def metric_counts(per_task: DataFrame, by: Sequence[str]) -> DataFrame:
    """Additive metric counts; partial results of different shards add up exactly."""
    return per_task.groupBy(*by).agg(
        F.count("*").alias("n_tasks"), F.count_if("hit").alias("n_localized"), F.sum("n_flags").alias("n_flags"), F.sum("n_fp").alias("n_false_positive"))


def with_rates(counts: DataFrame) -> DataFrame:
    return (counts.withColumn("localization_rate", _rate(F.col("n_localized"), F.col("n_tasks")))
            .withColumn("false_positive_rate", _rate(F.col("n_false_positive"), F.col("n_flags"))))


def arm_metrics(per_task: DataFrame, group: str = "grp") -> DataFrame:
    """Counts and rates per arm and group, and per arm overall (group NULL)."""
    return with_rates(with_overall(metric_counts(per_task, ["arm", group]), group))


def with_overall(counts: DataFrame, group: str) -> DataFrame:
    """Group rows and, from the same pass, one row per arm over all groups (group NULL)."""
    both = counts.select("arm", *METRIC_SUMS, F.explode(F.array(F.col(group), F.lit(None).cast("string"))).alias(group))
    return both.groupBy("arm", group).agg(*[F.sum(c).alias(c) for c in METRIC_SUMS])


def merge_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in METRIC_SUMS])


def lift_points(counts: DataFrame, by: Sequence[str], arm: str = "treatment", base: str = "control") -> DataFrame:
    """Localisation lift and false-positive rise in points, arm minus base."""
    def val(which: str, c: str) -> Column:
        return F.sum(F.when(F.col("arm") == which, F.col(c)))
    wide = counts.groupBy(*by).agg(*[val(a, c).alias(f"{p}_{c}") for a, p in ((arm, "a"), (base, "b")) for c in METRIC_SUMS])
    return wide.select(*by,
                       F.round(100 * (F.col("a_n_localized") / F.col("a_n_tasks") - F.col("b_n_localized") / F.col("b_n_tasks")), 2).alias("localization_lift_pts"),
                       F.round(100 * (F.col("a_n_false_positive") / F.col("a_n_flags") - F.col("b_n_false_positive") / F.col("b_n_flags")), 2).alias("false_positive_rise_pts"))


def gate_report(counts: DataFrame, group: str, negative: str, arms: Sequence[str] = ("treatment", "placebo"), base: str = "control") -> DataFrame:
    """Per memory arm: pooled lift vs control without the negative group, strict majority of
    positive groups, the negative group's own lift, and the difference to placebo.

    One pass over the (group, arm) counts: a row per group, then one aggregate.
    """
    every = [base, *arms]
    wide = counts.groupBy(group).agg(*[F.sum(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in every for c in METRIC_SUMS])
    main, neg = F.col(group) != negative, F.col(group) == negative

    def pts(a: str, b: str, num: str, den: str, keep: Column) -> Column:
        part = lambda x, c: F.sum(F.when(keep, F.col(f"{x}_{c}")))
        return F.round(100 * (part(a, num) / part(a, den) - part(b, num) / part(b, den)), 2)

    def rate(a: str) -> Column:
        return F.col(f"{a}_n_localized") / F.col(f"{a}_n_tasks")
    cells = [F.struct(
        F.lit(a).alias("arm"), pts(a, base, "n_localized", "n_tasks", main).alias("localization_lift_pts"), pts(a, base, "n_false_positive", "n_flags", main).alias("false_positive_rise_pts"),
        F.count_if(main).alias("n_groups"), F.count_if(main & (F.round(100 * (rate(a) - rate(base)), 2) > 0)).alias("n_positive"),
        pts(a, base, "n_localized", "n_tasks", neg).alias("negative_control_lift_pts"),
        (pts(a, "placebo", "n_localized", "n_tasks", main) if a != "placebo" and "placebo" in arms else F.lit(None).cast("double")).alias("minus_placebo_pts")) for a in arms]
    out = wide.agg(F.array(*cells).alias("r")).select(F.inline("r"))
    return out.withColumn("effect_in_majority", F.col("n_positive") * 2 > F.col("n_groups"))


def hit_at_k(ranked: DataFrame, gold: DataFrame, ks: Sequence[int], listed_tasks: DataFrame) -> DataFrame:
    """hit@k, false-positive share and tasks without gold, for each k. Ranks are per task."""
    flags = outcomes(ranked, gold)
    grid = flags.select("task_id", "rank", "ok", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter(F.col("rank") <= F.col("k"))
    per_task = grid.groupBy("k", "task_id").agg(F.max(F.col("ok").cast("int")).alias("h"), F.count("*").alias("f"), F.count_if(~F.col("ok")).alias("w"))
    missing = listed_tasks.select("task_id").distinct().join(gold.select("task_id").distinct(), "task_id", "left_anti").agg(F.count("*").alias("missing_gold"))
    out = per_task.groupBy("k").agg(F.count("*").alias("n"), F.sum("h").alias("hit"), F.sum("f").alias("flags"), F.sum("w").alias("wrong"))
    return (out.select("k", "n", "hit", F.round(F.col("hit") / F.col("n"), 4).alias("hit_at_k"), "flags", F.round(F.col("wrong") / F.col("flags"), 4).alias("false_positive_rate"),
                       missing.scalar().alias("missing_gold")))


def rerank_distinct(flags: DataFrame) -> DataFrame:
    """Keep a key's first position within a task's list and number the rest again."""
    first = flags.groupBy("task_id", "key").agg(F.min("rank").alias("__r"), F.max("ok").alias("ok"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("__r"))).drop("__r")


def precision_by_rank(reranked: DataFrame) -> DataFrame:
    return reranked.groupBy("rank").agg(F.count_if("ok").alias("correct"), F.count("*").alias("n"))


def first_hit_rank(reranked: DataFrame) -> DataFrame:
    """How many tasks are first right at each rank (NULL = never)."""
    per = reranked.groupBy("task_id").agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("first_rank"))
    return per.groupBy("first_rank").agg(F.count("*").alias("n_tasks"))


def display_policy(reranked: DataFrame, ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Show the top k: hits, wrong pointers, and the cost of a wrong pointer (in hits) at which
    showing one more breaks even with k-1."""
    grid = reranked.select("task_id", "ok", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter(F.col("rank") <= F.col("k"))
    per = grid.groupBy("k", "task_id").agg(F.max(F.col("ok").cast("int")).alias("h"), F.count_if(~F.col("ok")).alias("w"))
    tot = per.groupBy("k").agg(F.count("*").alias("n_tasks"), F.sum("h").alias("hits"), F.sum("w").alias("wrong"))
    w = Window.orderBy("k")
    gain, cost = F.col("hits") - F.lag("hits", 1, 0).over(w), F.col("wrong") - F.lag("wrong", 1, 0).over(w)
    return tot.select("k", "n_tasks", "hits", "wrong", F.round(F.when(cost > 0, gain / cost), 4).alias("break_even_cost"))


def repeated_false_positives(flags: DataFrame, n: int) -> DataFrame:
    """Most often wrong keys (once per task), with how often each was right."""
    per = flags.groupBy("task_id", "key").agg(F.max("ok").alias("ok"))
    return (per.groupBy("key").agg(F.count_if(~F.col("ok")).alias("n_wrong"), F.count_if("ok").alias("n_right"))
            .filter("n_wrong > 0").orderBy(F.col("n_wrong").desc(), "key").limit(n))


def recurring_tasks(gold_keyed: DataFrame, chain: str, order: Sequence[str], bucket: str) -> DataFrame:
    """(task_id, recurring): does any gold key appear in an earlier task of the chain?"""
    seen = running(gold_keyed, [chain, "key"], order, bucket, {"before": F.lit(1)})
    return seen.groupBy("task_id").agg((F.max("before") > 0).alias("recurring"))


def wins_losses(per_task: DataFrame, arms: Sequence[str], base: str = "control") -> DataFrame:
    """Tasks an arm wins from and loses to the base, all arms from one shuffle on the task."""
    wide = per_task.groupBy("task_id").agg(*[F.max(F.when(F.col("arm") == a, F.col("hit"))).alias(a) for a in (base, *arms)])
    rows = wide.select(F.col(base).alias("b"), F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("x")) for a in arms]))).filter("b is not null and x is not null")
    out = rows.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("x") & ~F.col("b")).alias("wins"), F.count_if(F.col("b") & ~F.col("x")).alias("losses"))
    return out.withColumn("delta_pts", F.round(100 * (F.col("wins") - F.col("losses")) / F.col("n"), 2))


def co_change(keyed: DataFrame, task: str, key: str, min_tasks: int, max_width: int) -> DataFrame:
    """Key pairs changed together in at least ``min_tasks`` tasks.

    Broad tasks (more than ``max_width`` keys) are outside the measure by definition,
    which also bounds what one task can emit.
    """
    width = keyed.groupBy(task).agg(F.count("*").alias("w")).filter(F.col("w").between(2, max_width)).select(task)
    lists = keyed.join(width, task, "left_semi").groupBy(task).agg(F.sort_array(F.collect_list(key)).alias("ks"))
    pairs = lists.select(F.explode(F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("key_a"), b.alias("key_b")))))).alias("p"))
    return pairs.groupBy("p.key_a", "p.key_b").agg(F.count("*").alias("n_tasks")).filter(F.col("n_tasks") >= min_tasks)


def shard_conflicts(rows: DataFrame, group: str, shard: str, fail: bool = False) -> DataFrame:
    """Groups found in more than one shard; an error when ``fail``."""
    per = rows.groupBy(group).agg(F.min(shard).alias("lo"), F.max(shard).alias("hi"))
    bad = per.filter("lo <> hi")
    if fail:
        bad = bad.withColumn("lo", F.raise_error(F.concat(F.lit("group in two shards: "), F.col(group).cast("string"))).cast("string"))
    return bad


def run_manifest(attempted: DataFrame, scored: DataFrame, errors: DataFrame, group: str) -> DataFrame:
    """Attempted, scored, failed and unaccounted tasks per group, in one aggregate over tagged rows."""
    tagged = (attempted.select(group, "task_id", F.lit(1).alias("a"), F.lit(0).alias("s"), F.lit(0).alias("e"))
              .unionByName(scored.select(group, "task_id", F.lit(0).alias("a"), F.lit(1).alias("s"), F.lit(0).alias("e")))
              .unionByName(errors.select(group, "task_id", F.lit(0).alias("a"), F.lit(0).alias("s"), F.lit(1).alias("e"))))
    per = tagged.groupBy(group, "task_id").agg(*[F.max(c).alias(c) for c in "ase"])
    return per.groupBy(group).agg(F.sum("a").alias("attempted"), F.sum("s").alias("scored"), F.sum("e").alias("errors"),
                                  F.count_if((F.col("a") == 1) & (F.col("s") == 0) & (F.col("e") == 0)).alias("unaccounted"))


def agreement(table: DataFrame, a: str, b: str, threshold: float = 0.95) -> DataFrame:
    """Share of rows (with ``b`` filled in) on which two labelings agree."""
    n, same = F.count_if(F.coalesce(F.col(b), F.lit("")) != ""), F.count_if((F.coalesce(F.col(b), F.lit("")) != "") & F.col(a).eqNullSafe(F.col(b)))
    return table.agg(same.alias("agree"), n.alias("n")).withColumn("share", F.round(F.col("agree") / F.col("n"), 4)).withColumn("passed", F.col("agree") >= threshold * F.col("n"))
