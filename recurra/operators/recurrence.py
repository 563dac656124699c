"""How often a key has been seen before in its chain."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import LEVELS, dir_of, key_at
from ..functions.running import running

SEEN = (1, 2, 3)


def keys_at_levels(gold: DataFrame, task: str, key: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Distinct (task, level, key) rows; one pass over ``gold`` for all levels."""
    items = F.array(*[F.struct(F.lit(lv).alias("level"), key_at(lv, F.col(key)).alias("key")) for lv in levels])
    return gold.select(task, F.inline(items)).distinct()


def prior_counts(keyed: DataFrame, group: Sequence[str], order: Sequence[str], bucket: str, name: str = "prior") -> DataFrame:
    """Earlier rows of the same group, for every row."""
    return running(keyed, group, order, bucket, {name: F.lit(1)})


def prequential(tasks: DataFrame, gold: DataFrame, warmup: int, min_chain: int, bucket: str, level_names: Sequence[str] = LEVELS) -> DataFrame:
    """Seen >= 1/2/3 times before, per report group and pooled (``grp`` NULL), at each level.

    ``tasks`` has task_id, chain_id, grp, created_at, ord, chain_len; ``gold`` has task_id, fkey.
    Rates are over all evaluated tasks, also those without gold.
    """
    pool = tasks.filter(F.col("chain_len") >= min_chain)
    keyed = keys_at_levels(gold, "task_id", "fkey", level_names)
    # tasks without gold stay in, under the empty level, so the tasks are read once
    placed = pool.select("task_id", "chain_id", "grp", "created_at", "ord").join(keyed, "task_id", "left").fillna("", ["level", "key"])
    counted = prior_counts(placed, ["chain_id", "level", "key"], ["ord"], bucket)
    per_task = counted.filter(F.col("ord") > warmup).groupBy("task_id", "grp", "level").agg(F.max("prior").alias("prior"))
    bare = F.col("level") == ""
    levels = F.when(bare, F.array(*map(F.lit, level_names))).otherwise(F.array("level"))
    joined = per_task.select("grp", F.when(~bare, F.col("prior")).alias("prior"), F.explode(levels).alias("level"))
    return (joined.rollup("level", "grp").agg(
        F.count("*").alias("n_eval"), F.count("prior").alias("n_scorable"),
        *[F.count_if(F.col("prior") >= k).alias(f"seen{k}") for k in SEEN])
        .filter("level is not null")
        .select("level", "grp", "n_eval", "n_scorable", *[f"seen{k}" for k in SEEN],
                *[F.round(F.col(f"seen{k}") / F.col("n_eval"), 4).alias(f"seen{k}_rate") for k in SEEN]))


def recurrence_by_prefix(tasks: DataFrame, gold: DataFrame, chain: str, prefixes: Sequence[int | None]) -> DataFrame:
    """Build-window recurrence for each prefix (None = whole chain), one row per chain and prefix.

    ``tasks`` has task_id, ``chain``, ord, n_chain. Counts per (chain, key, prefix) are
    aggregates, so a frequent key is combined map-side; tasks meet them by an equi-join.
    """
    marks = F.array(*[F.struct(F.lit("all" if p is None else str(p)).alias("prefix"),
                               (F.col("n_chain") if p is None else F.least(F.lit(p).cast("long"), F.col("n_chain"))).alias("cut")) for p in prefixes])
    grid = tasks.select("task_id", chain, "ord", "n_chain", F.inline(marks))
    files = gold.select("task_id", F.col("fkey").alias("key"), F.lit("key").alias("kind"))
    dirs = gold.select("task_id", dir_of(F.col("fkey")).alias("key"), F.lit("dir").alias("kind")).distinct()
    touched = grid.join(files.unionByName(dirs), "task_id")
    build = touched.filter("ord <= cut").groupBy(chain, "prefix", "kind", "key").agg(F.count("*").alias("c"))
    is_key, is_dir = F.col("kind") == "key", F.col("kind") == "dir"
    built = build.groupBy(chain, "prefix").agg(
        F.count_if(is_key).alias("distinct_keys"), F.count_if(is_dir).alias("distinct_dirs"),
        F.count_if(is_key & (F.col("c") >= 2)).alias("keys_ge2"), F.count_if(is_key & (F.col("c") >= 3)).alias("keys_ge3"),
        F.count_if(is_dir & (F.col("c") >= 3)).alias("dirs_ge3"), F.sum(F.when(is_key, F.col("c"))).alias("occurrences"))
    seen = (touched.filter("ord > cut").join(build, [chain, "prefix", "kind", "key"])
            .groupBy("task_id", chain, "prefix").agg(F.max(F.when(is_key, F.col("c"))).alias("k"), F.max(F.when(is_dir, F.col("c"))).alias("d")))
    hits = seen.groupBy(chain, "prefix").agg(
        *[F.count_if(F.col("k") >= n).alias(f"key_seen{n}") for n in SEEN],
        *[F.count_if(F.col("d") >= n).alias(f"dir_seen{n}") for n in (1, 3)])
    base = grid.groupBy(chain, "prefix").agg(F.max("cut").alias("cut"), F.max("n_chain").alias("n_tasks"), F.count_if(F.col("ord") > F.col("cut")).alias("n_eval"))
    zero = [c for c in built.columns + hits.columns if c not in (chain, "prefix")]
    return (base.join(built, [chain, "prefix"], "left").join(hits, [chain, "prefix"], "left").fillna(0, zero)
            .withColumn("repeat_share", F.when(F.col("occurrences") > 0, F.round(1 - F.col("distinct_keys") / F.col("occurrences"), 4))))


def lift_ceilings(by_prefix: DataFrame, control: DataFrame, chain: str, min_eval: int = 10) -> DataFrame:
    """Most that memory could add: seenK share x (1 - control rate), eval-weighted over chains per prefix.

    ``control`` has ``chain``, n_localized, n_tasks.
    """
    rows = (by_prefix.filter((F.col("n_eval") >= min_eval) & (F.col("cut") < F.col("n_tasks")))
            .join(control.select(chain, (F.col("n_localized") / F.col("n_tasks")).alias("p0")), chain))
    miss = 1 - F.col("p0")
    return rows.groupBy("prefix").agg(
        F.sum("n_eval").alias("eval_pool"),
        *[F.round(F.sum(100 * F.col(f"key_seen{k}") * miss) / F.sum("n_eval"), 4).alias(f"ceiling_ge{k}") for k in (2, 3)])


def expected_redundant(records: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Rows whose key already appeared, per group: all rows minus distinct keys (no ordering needed)."""
    per_key = records.groupBy(*keys).agg(F.count("*").alias("c"))
    return per_key.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("redundant"))
