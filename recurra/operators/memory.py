"""Versioned, content-addressed memory and retrieval from it."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.digest import set_digest


def put(store: DataFrame, new: DataFrame, key: str = "memory_id") -> DataFrame:
    """Rows to append: new ids only, once each (an existing id is the same object)."""
    return new.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def check_supersede(requests: DataFrame, store: DataFrame, supersession: DataFrame) -> DataFrame:
    """Validate (old_id, declared, new_id, seq) requests; ``reason`` is empty when applied.

    In rule order: the old object exists, the new one declares it, it was not superseded
    before (also not by an earlier request), and the new object is a distinct one.
    """
    known = store.select(F.col("memory_id").alias("old_id"), F.lit(True).alias("__known"))
    done = supersession.select("old_id", F.lit(True).alias("__done")).distinct()
    valid = (F.col("__known") & (F.col("declared") == F.col("old_id")) & (F.col("new_id") != F.col("old_id")))
    x = requests.join(known, "old_id", "left").join(done, "old_id", "left")
    first = x.filter(valid & F.col("__done").isNull()).groupBy("old_id").agg(F.min("seq").alias("__first"))
    x = x.join(first, "old_id", "left")
    reason = (F.when(F.col("__known").isNull(), "unknown id")
              .when(~F.coalesce(F.col("declared") == F.col("old_id"), F.lit(False)), "not declared")
              .when(F.col("__done").isNotNull() | (F.col("seq") > F.col("__first")), "already superseded")
              .when(F.col("new_id") == F.col("old_id"), "not distinct").otherwise(""))
    return x.select("seq", "old_id", "declared", "new_id", reason.alias("reason"))


def supersede(store: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The objects that applied requests write: the declared new id with everything else inherited from the old object (content,
    provenance, inputs, approval), and which one it ``supersedes``. To be appended to the store with :func:`put`."""
    done = verdicts.filter("reason = ''").select("old_id", "new_id")
    rest = [c for c in store.columns if c not in ("memory_id", "supersedes")]
    return store.join(done, F.col("memory_id") == F.col("old_id")).select(F.col("new_id").alias("memory_id"), F.col("old_id").alias("supersedes"), *rest)


def live_set(objects: DataFrame, supersession: DataFrame, key: str = "memory_id") -> DataFrame:
    return objects.join(supersession.select(F.col("old_id").alias(key)).distinct(), key, "left_anti")


def snapshot(live: DataFrame, by: Sequence[str], key: str = "memory_id") -> DataFrame:
    """One version per group: order-free digest of the live ids. Equal sets get equal versions."""
    return live.groupBy(*by).agg(set_digest(F.col(key)).alias("version_id"), F.count("*").alias("n_live"))


def version_members(live: DataFrame, versions: DataFrame, by: Sequence[str], key: str = "memory_id") -> DataFrame:
    """(version_id, id) rows: a snapshot, not a view."""
    return live.join(versions, list(by)).select("version_id", key)


def at_version(members: DataFrame, objects: DataFrame, version: str | None, key: str = "memory_id") -> DataFrame:
    """Objects visible at a version; none for NULL; an unknown version is an error."""
    if version is None:
        return objects.limit(0)
    wanted = members.filter(F.col("version_id") == version)
    if wanted.isEmpty():
        raise KeyError(f"unknown memory version {version}")
    return objects.join(wanted.select(key), key, "left_semi")


def membership(objects: DataFrame, supersession: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, memory_id, added, removed: the ticks from which and before which an object is live (removed NULL: still live). ``objects`` has
    ``by``, memory_id, added; ``supersession`` old_id, new_id, tick. Two numbers an object stand for all versions it is in."""
    done = supersession.select("old_id", "new_id", F.col("tick").alias("removed"))
    old = objects.join(done, F.col("memory_id") == F.col("old_id"), "left")
    new = old.filter("new_id IS NOT NULL").select(*by, F.col("new_id").alias("memory_id"), F.col("removed").alias("added"), F.lit(None).cast("int").alias("removed"))
    return old.select(*by, "memory_id", "added", F.col("removed").cast("int").alias("removed")).unionByName(new)


def version_ticks(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, version_tick: every tick at which a live set changes."""
    return members.select(*by, F.explode(F.array("added", "removed")).alias("version_tick")).filter("version_tick IS NOT NULL").distinct()


def members_at(members: DataFrame, versions: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, version_tick, memory_id: the objects live at each of the wanted versions, by a range predicate."""
    return versions.join(members, list(by)).filter((F.col("added") <= F.col("version_tick")) & (F.col("removed").isNull() | (F.col("removed") > F.col("version_tick")))).select(*by, "version_tick", "memory_id")


def gate_retrieval(ranked: DataFrame, tau: float) -> DataFrame:
    """Keep every candidate's score; inject those above zero and at least ``tau``."""
    return ranked.withColumn("injected", (F.col("score") > 0) & (F.col("score") >= tau))


def placebo_retrieval(gated: DataFrame, pool_ranked: DataFrame) -> DataFrame:
    """As many pool items per query as memory injected, by the same ranking."""
    n = gated.groupBy("qid").agg(F.count_if("injected").alias("__n"))
    return pool_ranked.join(n, "qid").filter(F.col("rank") <= F.col("__n")).drop("__n")


def memory_locations(support: DataFrame, key: str = "memory_id") -> DataFrame:
    """Location of each memory: that of its first supporting record (smallest id)."""
    return support.groupBy(key).agg(F.min(F.struct("record_id", "loc")).alias("f")).select(key, F.col("f.loc").alias("location"))
