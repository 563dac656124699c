"""Retrieval as of a point in time, inside a prequential evaluation.

Memories lie in an inverted index whose postings carry the interval in which a memory is visible: from the task after its promotion
until it is superseded. A task's text meets the postings of its chain and words by one equi-join; which version a task sees is a range
predicate on the posting, so no version is ever written out. Similarity is Jaccard on word sets, the best ``k`` of at least ``tau`` count.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, release


def postings(memories: DataFrame, words: Column) -> DataFrame:
    """chain_id, word, loc, m_size, m_words, place, since, until: a row for each word of a memory, with all its words, those rarest in the
    chain first, and the place of the row's word among them. ``memories`` has chain_id, loc, promo_tick and perhaps superseded_tick
    (NULL or no such column: live)."""
    until = F.col("superseded_tick") if "superseded_tick" in memories.columns else F.lit(None)
    held = memories.select("chain_id", "loc", F.col("promo_tick").cast("long").alias("since"), until.cast("long").alias("until"), F.array_distinct(words).alias("w"))
    each = held.select("chain_id", "loc", "since", "until", F.size("w").alias("m_size"), F.explode("w").alias("word"))
    common = each.groupBy("chain_id", "word").agg(F.count(F.lit(1)).alias("df"))
    whole = each.join(common, ["chain_id", "word"]).groupBy("chain_id", "loc", "since", "until", "m_size").agg(F.sort_array(F.collect_set(F.struct("df", "word"))).alias("o"))
    listed = whole.select("chain_id", "loc", "since", "until", "m_size", F.col("o.word").alias("m_words"), F.posexplode("o.word").alias("place", "word"))
    return listed.withColumn("place", F.col("place") + 1)


def retrieve(queries: DataFrame, index: DataFrame, k: int, tau: float) -> DataFrame:
    """task_id, loc, score, rank: the ``k`` nearest memories that a task (task_id, chain_id, ord, words) can see: promoted at a tick before
    ``ord``, not superseded before it. Ties go to the smaller loc. A task without words retrieves nothing.

    A task and a memory are scored where they meet at the memory's first word that the task has, so the pairs are neither
    shuffled nor added up; a memory is not met at words after which too few are left to reach ``tau``."""
    q = queries.select("task_id", "chain_id", "ord", F.col("words").alias("q_words"), F.size("words").alias("q_size"), F.explode(F.array_distinct("words")).alias("word"))
    seen = q.join(index, ["chain_id", "word"]).filter((F.col("since") < F.col("ord")) & (F.col("until").isNull() | (F.col("until") >= F.col("ord"))))
    need = F.ceil(F.lit(tau / (1 + tau)) * (F.col("q_size") + F.col("m_size")) - 1e-9)
    seen = seen.filter(F.col("m_size") - F.col("place") + 1 >= need)
    shared = F.array_intersect("m_words", "q_words")
    met = seen.select("task_id", "loc", "word", "q_size", "m_size", shared.alias("both")).filter(F.get("both", F.lit(0)) == F.col("word"))
    n = F.size("both")
    scored = met.select("task_id", "loc", (n / (F.col("q_size") + F.col("m_size") - n)).alias("score")).filter((F.col("score") > 0) & (F.col("score") >= tau))
    best = Window.partitionBy("task_id").orderBy(F.col("score").desc(), "loc")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def matched_placebo(retrieved: DataFrame, pool: DataFrame, size: int, seed: str) -> DataFrame:
    """task_id, loc: for each task as many items of the pool (idx from 0, loc) as it has retrieved, from a seeded place on."""
    n = retrieved.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("task_id").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = n.select("task_id", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(size)) - 1)).alias("j")).select("task_id", ((place + F.col("j")) % size).alias("idx"))
    return drawn.join(pool, "idx").select("task_id", "loc")


def guided_first(flags: DataFrame, retrieved: DataFrame, placebo: DataFrame) -> DataFrame:
    """Per task whether the first flag is right: as ranked (control_top1), and when flags at retrieved locations are shown first
    (memory_top1, placebo_top1). ``flags`` has task_id, rank, key, ok."""
    # flags and marks meet in one shuffle by the task
    x = flags.select("task_id", "key", "rank", "ok", F.lit(1).alias("m"), F.lit(1).alias("p"), F.lit(True).alias("flag"))
    for marks, m, p in ((retrieved, 0, 1), (placebo, 1, 0)):
        x = x.unionByName(marks.filter("loc IS NOT NULL").select("task_id", F.col("loc").alias("key"), F.lit(m).alias("m"), F.lit(p).alias("p"), F.lit(False).alias("flag")), allowMissingColumns=True)
    same = Window.partitionBy("task_id", "key")
    x = x.repartition("task_id").select("task_id", "rank", "ok", "flag", *[F.min(c).over(same).alias(c) for c in "mp"]).filter("flag")
    ok = F.col("ok").cast("int")
    return x.groupBy("task_id").agg(F.min_by(ok, "rank").alias("control_top1"), F.min_by(ok, F.struct("m", "rank")).alias("memory_top1"), F.min_by(ok, F.struct("p", "rank")).alias("placebo_top1"))


def evaluate(tasks: DataFrame, flags: DataFrame, retrieved: DataFrame, placebo: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """Paired rates of the arms over the tasks, what was retrieved for them (covered, injected; useful: at a right location), as many
    placebos, and the first flags with and without memory. ``flags`` has arm, task_id, rank, key, ok of tasks with known truth."""
    wide = flags.groupBy("task_id").agg(*[F.max(F.when(F.col("arm") == a, F.col("ok").cast("int"))).alias(a) for a in ("control", "treatment", "placebo")])
    wide = wide.filter("control is not null and treatment is not null and placebo is not null")
    first = materialise(guided_first(flags.filter("arm = 'control'"), retrieved, placebo))
    release(flags.sparkSession)
    right = gold.select("task_id", F.col("fkey").alias("loc"), F.lit(1).alias("right"))
    n = retrieved.join(right, ["task_id", "loc"], "left").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count("right").alias("n_right"))
    sham = placebo.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_sham"))
    x = tasks.select("task_id", by).join(wide, "task_id").join(first, "task_id").join(n, "task_id", "left").join(sham, "task_id", "left").fillna(0, ["n", "n_right", "n_sham"])
    return x.groupBy(by).agg(
        F.count("*").alias("n_eval"), *[F.sum(a).alias(f"{a}_hits") for a in ("control", "treatment", "placebo")],
        F.count_if((F.col("treatment") == 1) & (F.col("control") == 0)).alias("wins"), F.count_if((F.col("treatment") == 0) & (F.col("control") == 1)).alias("losses"),
        F.count_if(F.col("n") > 0).alias("covered"), F.sum("n").alias("injected"), F.sum("n_right").alias("useful"), F.sum("n_sham").alias("placebo_injected"),
        *[F.sum(c).alias(c) for c in ("control_top1", "memory_top1", "placebo_top1")])
