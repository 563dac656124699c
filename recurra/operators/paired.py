"""Paired comparison of two arms on the same tasks, and sample sizing."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.digest import PRIME, draw, with_counter_draw

# Normal quantiles for alpha 0.05 (two-sided) and power 0.8, and the published interval's z.
Z_ALPHA = 1.959963984540054
Z_POWER = 0.8416212335729143
Z_WALD = 1.959964

PAIR_SUMS = ("n", "both_hit", "control_only", "treatment_only", "differed", "retrieved")


def pair_arms(flags: DataFrame, arm: str = "treatment", base: str = "control") -> DataFrame:
    """One row per task seen in both arms: base_hit, arm_hit, flags_differed (as ordered lists).

    A conditional aggregate instead of a self-join: one shuffle on the task.
    Lists are bounded by the number of flags shown per task.
    """
    def of(which: str) -> Column:
        return F.col("arm") == which
    wide = flags.filter(F.col("arm").isin(arm, base)).groupBy("task_id").agg(
        *[x for w, p in ((base, "base"), (arm, "arm")) for x in (
            F.max(F.when(of(w), F.col("ok"))).alias(f"{p}_hit"),
            F.sort_array(F.collect_list(F.when(of(w), F.struct("rank", "key")))).alias(f"__{p}"))])
    return (wide.filter("base_hit is not null and arm_hit is not null")
            .select("task_id", "base_hit", "arm_hit", (F.col("__base") != F.col("__arm")).alias("flags_differed")))


def pair_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Additive 2x2 counts. ``pairs`` also carries ``retrieved``."""
    b, t = F.col("base_hit"), F.col("arm_hit")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(b & t).alias("both_hit"), F.count_if(b & ~t).alias("control_only"), F.count_if(t & ~b).alias("treatment_only"),
        F.count_if("flags_differed").alias("differed"), F.count_if("retrieved").alias("retrieved"))


def scope_counts(counts: DataFrame, group: str, negative: str, secondary: Column) -> DataFrame:
    """Group rows plus primary (all but the negative control), secondary and negative-control rows."""
    is_neg = F.col(group) == negative
    scopes = F.array_compact(F.array(
        F.struct(F.lit("group").alias("scope"), F.col(group).alias("label")),
        F.when(~is_neg, F.struct(F.lit("primary").alias("scope"), F.lit("all").alias("label"))),
        F.when(~is_neg & secondary, F.struct(F.lit("secondary").alias("scope"), F.lit("all").alias("label"))),
        F.when(is_neg, F.struct(F.lit("negative_control").alias("scope"), F.lit("all").alias("label")))))
    return counts.select(F.inline(scopes), *PAIR_SUMS).groupBy("scope", "label").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])


def summarise_pairs(counts: DataFrame) -> DataFrame:
    n = F.col("n")
    return (counts.withColumn("neither_hit", n - F.col("both_hit") - F.col("control_only") - F.col("treatment_only"))
            .withColumn("control_rate", F.round((F.col("both_hit") + F.col("control_only")) / n, 4))
            .withColumn("treatment_rate", F.round((F.col("both_hit") + F.col("treatment_only")) / n, 4))
            .withColumn("lift_pts", F.round(100 * (F.col("treatment_only") - F.col("control_only")) / n, 2))
            .withColumn("differed_rate", F.round(F.col("differed") / n, 4))
            .withColumn("coverage", F.round(F.col("retrieved") / n, 4)))


def ln_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series at x + 8."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    shift = x
    for i in range(1, 8):
        shift = shift * (x + i)
    return series - F.log(shift)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p on discordant pairs; 1 when there are none.

    Terms are summed from the largest down; beyond about 12 standard deviations they
    add nothing to a double, so the list of terms is bounded for any n.
    """
    n, k = (b + c).cast("double"), F.least(b, c)
    width = F.least(k, (F.ceil(F.sqrt(n) * 12) + 60).cast("long"))

    def term(j: Column) -> Column:
        i = (k - j).cast("double")
        return F.exp(ln_gamma(n + 1) - ln_gamma(i + 1) - ln_gamma(n - i + 1) - n * math.log(2))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), width.cast("long")), F.lit(0.0), lambda acc, j: acc + term(j))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def wald_interval(n: Column, b: Column, c: Column, z: float = Z_WALD) -> tuple[Column, Column]:
    """Paired difference (c - b) / n in points: lower, upper."""
    d = (c - b) / n
    h = z * F.sqrt(F.greatest(((b + c) / n - d * d) / n, F.lit(0.0)))
    lo = F.when(n > 0, F.round(100 * (d - h), 2)).otherwise(0.0)
    hi = F.when(n > 0, F.round(100 * (d + h), 2)).otherwise(0.0)
    return lo, hi


def bootstrap_interval(counts: DataFrame, group: str, seed: str, reps: int, chunk: int = 2000) -> DataFrame:
    """Percentile bootstrap of the paired lift, tasks resampled with replacement.

    Only three values occur per task (-1, 0, +1), so resampling needs the counts, not
    the tasks: draw r < n is a loss when r < b, a win when r < b + c. Draws are spread as
    (repetition, chunk) rows over the cluster; nothing is joined back and each task of
    the job sends one partial sum per repetition. Quantiles are by index.
    """
    base = counts.select(group, F.col("n").cast("long").alias("n"), F.col("control_only").alias("b"), F.col("treatment_only").alias("c")).filter("n > 0")
    grid = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("ch"))
    grid = grid.repartition(group, "rep", "ch").withColumn("key", F.pmod(draw(seed, F.col(group), F.col("rep")), F.lit(PRIME)))
    last = F.least(F.col("n"), (F.col("ch") + 1) * chunk) - 1
    draws = grid.select(group, "n", "b", "c", "rep", "key", F.explode(F.sequence(F.col("ch") * chunk, last)).alias("i"))
    # two draws make one of 62 bits, so that "mod n" stays even for every n
    draws = with_counter_draw(draws, F.col("key"), F.col("i") % PRIME, "x1")
    draws = with_counter_draw(draws, F.col("key") + F.floor(F.col("i") / PRIME) + 1, F.col("x1"), "x2").withColumn("x", F.col("x2") * PRIME + F.col("x1"))
    r = F.col("x") % F.col("n")
    value = F.when(r < F.col("b"), -1).when(r < F.col("b") + F.col("c"), 1).otherwise(0)
    sums = draws.groupBy(group, "rep", "n").agg(F.sum(value).alias("s"))

    ranked = sums.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("s", "rep")))
    lo, hi = int(0.025 * reps) + 1, int(0.975 * reps)
    return ranked.groupBy(group).agg(
        F.max("n").alias("n"), F.round(F.max(F.when(F.col("rn") == lo, 100 * F.col("s") / F.col("n"))), 2).alias("ci_low"),
        F.round(F.max(F.when(F.col("rn") == hi, 100 * F.col("s") / F.col("n"))), 2).alias("ci_high"))


def n_per_arm(p0: Column, mde: Column) -> Column:
    """Tasks per arm to detect ``mde`` (two-proportion normal formula); NULL when a rate leaves (0, 1)."""
    p1 = p0 + mde
    bar = (p0 + p1) / 2
    root = Z_ALPHA * F.sqrt(2 * bar * (1 - bar)) + Z_POWER * F.sqrt(p0 * (1 - p0) + p1 * (1 - p1))
    return F.when((p0 > 0) & (p0 < 1) & (p1 > 0) & (p1 < 1), F.ceil(root * root / (mde * mde)))


def mde_at(p0: Column, n: Column, tol: float = 1e-4) -> Column:
    """Smallest detectable lift at ``n`` per arm by bisection; NULL when none is."""
    def step(acc: Column, _i: Column) -> Column:
        lo, hi = acc.getField("lo"), acc.getField("hi")
        mid = (lo + hi) / 2
        fits, go = n_per_arm(p0, mid) <= n, hi - lo > tol
        return F.struct(F.when(go & ~fits, mid).otherwise(lo).alias("lo"), F.when(go & fits, mid).otherwise(hi).alias("hi"))
    hi0 = 1 - p0 - tol
    end = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(F.lit(tol).alias("lo"), hi0.alias("hi")), step)
    return F.when((p0 > 0) & (hi0 > tol) & (n_per_arm(p0, hi0) <= n), F.round(end.getField("hi"), 4))


def mde_paired(discordance: Column, n: Column) -> Column:
    """Smallest paired lift detectable when a share ``discordance`` of tasks changes outcome."""
    start = (Z_ALPHA + Z_POWER) * F.sqrt(discordance / n)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, lambda x, _i: (
        Z_ALPHA * F.sqrt(discordance) + Z_POWER * F.sqrt(F.greatest(discordance - x * x, F.lit(1e-12)))) / F.sqrt(n))
    return F.round(F.least(end, discordance), 4)


def n_paired(discordance: Column, mde: Column) -> Column:
    root = (Z_ALPHA * F.sqrt(discordance) + Z_POWER * F.sqrt(discordance - mde * mde)) / mde
    return F.when(mde < discordance, F.ceil(root * root))


def sizing_report(groups: DataFrame) -> DataFrame:
    """Pool, weighted control rate and ceiling, MDE, kill number, feasibility.

    ``groups`` has n_eval, p0, seen2 (fractions).
    """
    g = groups.withColumn("ceil", F.round(100 * F.col("seen2") * (1 - F.col("p0")), 1))
    pooled = g.agg(F.sum("n_eval").alias("eval_pool"), (F.sum(F.col("p0") * F.col("n_eval")) / F.sum("n_eval")).alias("p0"), (F.sum(F.col("ceil") * F.col("n_eval")) / F.sum("n_eval")).alias("c"))
    mde = 100 * mde_at(F.col("p0"), F.col("eval_pool"))
    return (pooled.withColumn("m", mde).select(
        "eval_pool", F.round("p0", 4).alias("p0"), F.round("c", 1).alias("ceiling_pts"), F.round("m", 1).alias("mde_pts"),
        F.ceil(F.greatest("m", 0.5 * F.col("c"))).alias("kill_number_pts"), (F.col("c") >= 1.5 * F.col("m")).alias("feasible")))


def recommend_cell(cells: DataFrame, tol: float = 0.05, min_purity: float = 1.0) -> DataFrame:
    """Closest to the injected share, then most promotions, then highest theta; among cells within ``tol`` and pure enough."""
    gap = F.abs(F.col("discard_rate") - F.col("injected"))
    ok = cells.filter((gap <= tol) & (F.coalesce(F.col("purity"), F.lit(0.0)) >= min_purity) & (F.col("promoted") > 0))
    return ok.agg(F.max_by(F.struct(*cells.columns), F.struct((-gap).alias("g"), F.col("promoted"), F.col("theta"), F.col("rho"))).alias("best")).select("best.*").filter("theta is not null")
