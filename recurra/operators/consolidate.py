"""Keyed consolidation: which records are new, which add evidence, what is promoted.

A record arrives at tick ``d`` (its day or task number); the tick that closes it is
``d + 1``. Within a (chain, loc) cluster the first record is *buffered*, later ones
*reinforce* it, and once the cluster is promoted they are *discarded*. Everything is
computed from (chain, loc, tick) counts, so a hot cluster is combined map-side and what
is ordered is its ticks, not its records.
"""
from __future__ import annotations

from dataclasses import dataclass
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.digest import content_digest, set_digest
from ..functions.running import asof_latest, running
from ..session import materialise, release

KEYS = ["chain_id", "loc"]
TICK_BUCKET = "d div 64"


@dataclass(frozen=True)
class Policy:
    """Consolidation settings; the defaults are the untuned ones."""
    min_occurrences: int = 3
    min_inputs: int = 3
    labels: tuple[str, ...] = ("bad",)
    schedule: int = 10
    ttl: int | None = 50
    approver: str = "promotion-gate"
    separation_of_duties: bool = True
    theta: float = 0.35
    rho: float | None = None
    cluster: float = 0.65

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, separators=(",", ":"), default=list).encode()).hexdigest()


TUNED = Policy(min_occurrences=2, min_inputs=2, schedule=1, ttl=None, theta=0.45, rho=0.70, cluster=0.60)


def eligible(records: DataFrame, policy: Policy) -> DataFrame:
    return records.filter(F.col("label").isin(*policy.labels))


def next_tick(d: Column, schedule: int) -> Column:
    """First scheduled tick that closes after a record of tick ``d``."""
    return (F.ceil((d + 1) / schedule) * schedule).cast("int")


# -- without expiry: closed form ---------------------------------------------------------
def last_ticks(records: DataFrame, policy: Policy) -> DataFrame:
    """(chain_id, last_tick): the tick that closes a chain's last record. Where the calendar of a finished run ends."""
    return records.groupBy("chain_id").agg(F.max(next_tick(F.col("d"), policy.schedule)).alias("last_tick"))


def conflicts(records: DataFrame, policy: Policy) -> DataFrame:
    """(chain_id, loc, d_other): from which day on a cluster also holds a record of the opposite label."""
    opposite = "good" if "bad" in policy.labels else "bad"
    return records.filter(F.col("label") == opposite).groupBy(*KEYS).agg(F.min("d").alias("d_other"))


def _keyed_join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the cluster; a NULL location is a cluster like any other."""
    r = right.withColumnsRenamed({"chain_id": "__c", "loc": "__l"})
    return left.join(r, F.col("chain_id").eqNullSafe(F.col("__c")) & F.col("loc").eqNullSafe(F.col("__l")), how).drop("__c", "__l")


def promotion_ticks(records: DataFrame, policy: Policy, last: DataFrame | int | None = None, contradicting: DataFrame | None = None, store: bool = False) -> DataFrame:
    """(chain_id, loc, promo_tick) of every cluster that is promoted.

    ``last`` is the final tick: a number, a table (chain_id, last_tick), or None when the calendar goes on until every
    record is closed. ``contradicting`` has (chain_id, loc, d_other): a conflict known when a tick closes blocks the cluster.
    ``store``: the counts per tick, which are read twice, are written first.
    """
    el = eligible(records, policy)
    # one row per cluster, input and tick; an input is new on its first tick
    base = el.groupBy(*KEYS, "input_hash", "d").agg(F.count("*").alias("e"), F.max((F.col("agent_id") == policy.approver).cast("int")).alias("self"))
    first = F.min("d").over(Window.partitionBy(*KEYS, "input_hash"))
    steps = (base.withColumn("i", (F.col("d") == first).cast("int")).groupBy(*KEYS, "d")
             .agg(F.sum("e").alias("e"), F.sum("i").alias("i"), F.max("self").alias("self")))
    if store:
        steps = materialise(steps, codec="zstd")
        release(records.sparkSession)
    run = running(steps, KEYS, ["d"], TICK_BUCKET, {"n_e": F.col("e"), "n_i": F.col("i")}, inclusive=True)
    enough = (F.col("n_e") >= policy.min_occurrences) & (F.col("n_i") >= policy.min_inputs)
    ready = run.groupBy(*KEYS).agg(F.min(F.when(enough, F.col("d"))).alias("d"), F.min(F.when(F.col("self") == 1, F.col("d"))).alias("d_self")).filter("d is not null")
    if policy.separation_of_duties:
        # an approver among the proposers blocks the cluster from that record on
        blocked = F.col("d_self").isNotNull() & (next_tick(F.col("d_self"), policy.schedule) <= next_tick(F.col("d"), policy.schedule))
        ready = ready.filter(~blocked)
    if contradicting is not None:
        ready = _keyed_join(ready, contradicting.select(*KEYS, "d_other"), "left")
        ready = ready.filter(~F.coalesce(next_tick(F.col("d_other"), policy.schedule) <= next_tick(F.col("d"), policy.schedule), F.lit(False)))
    out = ready.select(*KEYS, next_tick(F.col("d"), policy.schedule).alias("promo_tick"))
    if last is None:
        return out
    if isinstance(last, int):
        return out.filter(F.col("promo_tick") <= last)
    return out.join(last, "chain_id").filter(F.col("promo_tick") <= F.col("last_tick")).drop("last_tick")


def outcomes(records: DataFrame, promotions: DataFrame) -> DataFrame:
    """``outcome`` per record, and the cluster's promo_tick."""
    first = records.groupBy(*KEYS).agg(F.min(F.struct("ts", "record_id")).alias("f"))
    x = _keyed_join(_keyed_join(records, first.select(*KEYS, F.col("f.record_id").alias("__first")), "inner"), promotions, "left")
    out = (F.when(F.col("record_id") == F.col("__first"), "buffered")
           .when(F.col("promo_tick").isNotNull() & (F.col("d") + 1 > F.col("promo_tick")), "discarded").otherwise("reinforced"))
    return x.withColumn("outcome", out).drop("__first")


def support_rows(records: DataFrame, promotions: DataFrame, policy: Policy) -> DataFrame:
    """Eligible records behind each promotion: provenance as rows, unbounded by any array."""
    start = F.col("from_tick") if "from_tick" in promotions.columns else F.lit(0)
    return _keyed_join(eligible(records, policy), promotions, "inner").filter((F.col("d") + 1 <= F.col("promo_tick")) & (F.col("d") >= start))


def memory_objects(records: DataFrame, promotions: DataFrame, policy: Policy) -> DataFrame:
    """One immutable object per promotion, with digests of its evidence and its content id."""
    start = F.col("from_tick") if "from_tick" in promotions.columns else F.lit(0)
    seed = (_keyed_join(records, promotions, "inner").filter(F.col("d") >= start).groupBy(*KEYS)
            .agg(F.min(F.struct("ts", "record_id", "content")).alias("s")).select(*KEYS, F.col("s.content").alias("content")))
    sup = support_rows(records, promotions, policy)
    ev = sup.groupBy(*KEYS, "promo_tick").agg(F.count("*").alias("n_support"), set_digest(F.col("record_id").cast("string")).alias("provenance"))
    inputs = sup.select(*KEYS, "input_hash").distinct().groupBy(*KEYS).agg(F.count("*").alias("n_inputs"), set_digest(F.col("input_hash")).alias("inputs"))
    out = _keyed_join(_keyed_join(ev, inputs, "inner"), seed, "inner").withColumn("approved_by", F.lit(policy.approver))
    return out.withColumn("memory_id", content_digest("content", "provenance", "inputs", "approved_by"))


def gate_reasons(records: DataFrame, policy: Policy, contradicting: DataFrame | None = None) -> DataFrame:
    """Every cluster at the current tick with the first promotion rule it fails ('' = promoted).

    ``contradicting`` lists (chain_id, loc) clusters that conflict with promoted memory.
    """
    is_el = F.col("label").isin(*policy.labels)
    inputs = eligible(records, policy).select(*KEYS, "input_hash").distinct().groupBy(*KEYS).agg(F.count("*").alias("n_inputs"))
    c = records.groupBy(*KEYS).agg(F.count_if(is_el).alias("n_eligible"), F.max((is_el & (F.col("agent_id") == policy.approver)).cast("int")).alias("__self"))
    c = _keyed_join(c, inputs, "left").fillna(0, ["n_inputs"])
    if contradicting is not None:
        c = _keyed_join(c, contradicting.select(*KEYS).distinct().withColumn("__bad", F.lit(True)), "left")
    else:
        c = c.withColumn("__bad", F.lit(None).cast("boolean"))
    reason = (F.when(F.col("n_eligible") < policy.min_occurrences, "too_few_records")
              .when(F.col("n_inputs") < policy.min_inputs, "too_few_inputs")
              .when(F.lit(policy.separation_of_duties) & (F.col("__self") == 1), "own_approval")
              .when(F.col("__bad"), "conflict").otherwise(""))
    return c.select(*KEYS, "n_eligible", "n_inputs", reason.alias("reason"))


def contradicted(records: DataFrame, promotions: DataFrame, policy: Policy) -> DataFrame:
    """Promotions whose cluster also holds a record of the opposite label by then."""
    return _keyed_join(promotions, conflicts(records, policy), "inner").filter(F.col("d_other") + 1 <= F.col("promo_tick")).select(*KEYS)


# -- with expiry: a fold over the ticks of each cluster -------------------------------------
def _tick_rows(records: DataFrame, policy: Policy) -> DataFrame:
    """(chain_id, loc, d, n, e, self, news): self tells that the approver is among the tick's proposers; news counts the tick's
    eligible inputs by the tick they were last seen at (-1 = never), which is what decides if they are new to an entry."""
    is_el = F.col("label").isin(*policy.labels)
    mine = is_el & F.coalesce(F.col("agent_id") == policy.approver, F.lit(False))
    per = records.groupBy(*KEYS, "d").agg(F.count("*").alias("n"), F.count_if(is_el).alias("e"), F.max(mine).alias("self"))
    seen = eligible(records, policy).select(*KEYS, "input_hash", "d").distinct()
    prev = F.coalesce(F.lag("d").over(Window.partitionBy(*KEYS, "input_hash").orderBy("d")), F.lit(-1))
    news = seen.select(*KEYS, "d", prev.alias("prev")).groupBy(*KEYS, "d", "prev").agg(F.count("*").alias("c"))
    lists = news.groupBy(*KEYS, "d").agg(F.collect_list(F.struct("prev", "c")).alias("news")).withColumnRenamed("d", "__d")
    return _day_join(per, lists).select(*KEYS, "d", "n", "e", "self", F.coalesce("news", F.array().cast("array<struct<prev:int,c:bigint>>")).alias("news"))


def _day_join(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.withColumnsRenamed({"chain_id": "__c", "loc": "__l"})
    return left.join(r, F.col("chain_id").eqNullSafe(F.col("__c")) & F.col("loc").eqNullSafe(F.col("__l")) & (F.col("d") == F.col("__d")), "left").drop("__c", "__l", "__d")


def ttl_states(records: DataFrame, policy: Policy, last_tick: int | None = None, contradicting: DataFrame | None = None) -> DataFrame:
    """Per cluster: promo_tick, from_tick (start of the promoted entry), the state at every
    tick with records, and the expiries. Ticks without records are skipped over exactly.

    The calendar ends at ``last_tick`` or, without it, where the chain's last record is closed. The fold holds one array element
    per tick on which the cluster has records. Separation of duties and contradictions (see :func:`promotion_ticks`) hold as in
    the closed form; an entry starts with no proposers.
    """
    ttl, sched, mo, mi = policy.ttl, policy.schedule, policy.min_occurrences, policy.min_inputs
    rows = _tick_rows(records, policy).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("d", "n", "e", "self", "news"))).alias("ticks"))
    if last_tick is not None:
        rows = rows.withColumn("last_tick", F.lit(last_tick))
    else:
        end = last_ticks(records, policy).withColumnRenamed("chain_id", "__end")
        rows = rows.join(end, F.col("chain_id").eqNullSafe(F.col("__end"))).drop("__end")
    if contradicting is not None:
        rows = _keyed_join(rows, contradicting.select(*KEYS, next_tick(F.col("d_other"), sched).alias("barred")), "left")
    else:
        rows = rows.withColumn("barred", F.lit(None).cast("int"))
    start = F.expr("named_struct('ins', cast(null as int), 'e', 0L, 'i', 0L, 'self', false, 'last', -1, 'p', cast(null as int), 'p_from', cast(null as int), "
                   "'states', cast(array() as array<struct<d:int,state:string>>), 'dead', cast(array() as array<struct<ins:int,tick:int>>))")

    def advance(s: Column, upto: Column) -> Column:
        g = s.getField
        tick = next_tick(g("last"), sched)
        live = g("p").isNull() & g("ins").isNotNull()
        allowed = F.coalesce(tick < F.col("barred"), F.lit(True)) & ~(F.lit(policy.separation_of_duties) & g("self"))
        promote = F.coalesce(live & allowed & (g("e") >= mo) & (g("i") >= mi) & (tick <= upto) & (tick < g("ins") + ttl), F.lit(False))
        expire = F.coalesce(live & ~promote & (g("ins") + ttl <= upto), F.lit(False))
        gone = promote | expire
        dead = F.when(expire, F.array(F.struct(g("ins").alias("ins"), (g("ins") + ttl).alias("tick")))).otherwise(F.expr("cast(array() as array<struct<ins:int,tick:int>>)"))
        return F.struct(F.when(~gone, g("ins")).alias("ins"), F.when(gone, 0).otherwise(g("e")).cast("long").alias("e"), F.when(gone, 0).otherwise(g("i")).cast("long").alias("i"),
                        (~gone & g("self")).alias("self"), g("last").alias("last"), F.when(promote, tick).otherwise(g("p")).alias("p"), F.when(promote, g("ins")).otherwise(g("p_from")).alias("p_from"),
                        g("states").alias("states"), F.concat(g("dead"), dead).alias("dead"))

    def absorb(s: Column, x: Column) -> Column:
        g = s.getField
        state = F.when(g("p").isNotNull(), "discarded").when(g("ins").isNull(), "buffered").otherwise("reinforced")
        ins = F.when(g("p").isNull(), F.coalesce(g("ins"), x.getField("d")))
        new = F.aggregate(x.getField("news"), F.lit(0).cast("long"), lambda a, v: a + F.when(v.getField("prev") < ins, v.getField("c")).otherwise(0))
        return F.struct(ins.alias("ins"), (g("e") + x.getField("e")).alias("e"), (g("i") + new).alias("i"), (g("self") | x.getField("self")).alias("self"), x.getField("d").alias("last"), g("p").alias("p"), g("p_from").alias("p_from"),
                        F.concat(g("states"), F.array(F.struct(x.getField("d").alias("d"), state.alias("state")))).alias("states"), g("dead").alias("dead"))

    folded = F.aggregate("ticks", start, lambda s, x: absorb(advance(s, x.getField("d")), x), lambda s: advance(s, F.col("last_tick")))
    return rows.select(*KEYS, folded.alias("f")).select(*KEYS, F.col("f.p").alias("promo_tick"), F.col("f.p_from").alias("from_tick"), F.col("f.states").alias("states"), F.col("f.dead").alias("expired"))


def ttl_outcomes(records: DataFrame, states: DataFrame) -> DataFrame:
    """``outcome`` per record under expiry: only the first record of a tick can open an entry."""
    per_tick = states.select(*KEYS, F.inline("states"))
    first = records.groupBy(*KEYS, "d").agg(F.min(F.struct("ts", "record_id")).alias("f")).select(*KEYS, "d", F.col("f.record_id").alias("__first"))
    x = _day_join(records, _day_join(per_tick, first.withColumnRenamed("d", "__d")).withColumnRenamed("d", "__d"))
    opens = (F.col("state") == "buffered") & (F.col("record_id") != F.col("__first"))
    return x.withColumn("outcome", F.when(opens, "reinforced").otherwise(F.col("state"))).drop("state", "__first")


def expiries(states: DataFrame) -> DataFrame:
    return states.select(*KEYS, F.inline("expired")).withColumnRenamed("ins", "inserted").withColumnRenamed("tick", "expired_tick")


# -- statistics ------------------------------------------------------------------------------
def learning_stats(outcome_rows: DataFrame, promotions: DataFrame, by: str = "chain_id") -> DataFrame:
    """Candidates, buffered, discard rate (everything not buffered) and promotions."""
    c = outcome_rows.groupBy(by).agg(F.count("*").alias("candidates"), F.count_if(F.col("outcome") == "buffered").alias("buffered"))
    p = promotions.groupBy(by).agg(F.count("*").alias("promoted"))
    return (c.join(p, by, "left").fillna(0, ["promoted"])
            .withColumn("discard_rate", F.round((F.col("candidates") - F.col("buffered")) / F.col("candidates"), 4)))


def outcome_crosstab(outcome_rows: DataFrame, labels: tuple[str, ...] = ("bad", "good", "unknown")) -> DataFrame:
    return outcome_rows.groupBy("outcome").pivot("label", list(labels)).count().fillna(0)


def cluster_purity(support: DataFrame, pattern: Column, by: str = "chain_id", component: Column | None = None) -> DataFrame:
    """Clusters, and those whose records share one pattern; with ``component``, also those whose records share a component."""
    parts = [] if component is None else [component]
    per = support.groupBy(*KEYS).agg((F.min(pattern) == F.max(pattern)).alias("pure"), *[(F.min(c) == F.max(c)).alias("same_component") for c in parts])
    counts = per.groupBy(by).agg(F.count("*").alias("clusters"), F.count_if("pure").alias("pure"), *[F.count_if("same_component").alias("component_pure") for _ in parts])
    return counts.withColumn("merged_share", F.round((F.col("clusters") - F.col("pure")) / F.col("clusters"), 4))


def never_used(promotions: DataFrame, outcome_rows: DataFrame) -> DataFrame:
    """Promotions no later record was redundant to."""
    return _keyed_join(promotions, outcome_rows.filter("outcome = 'discarded'").select(*KEYS).distinct(), "left_anti")


# -- evaluation against memory as it was --------------------------------------------------------
def asof_version(tasks: DataFrame, promotions: DataFrame) -> DataFrame:
    """For each task (chain_id, task_id, ord) the latest promotion tick visible before it.

    A promotion at tick p is visible from the task after it. Tasks and promotion ticks are
    laid on one line per chain and the latest tick carried forward, bucket by bucket.
    """
    marks = promotions.select("chain_id", "promo_tick").distinct().select(
        "chain_id", F.lit(None).cast("long").alias("task_id"), F.col("promo_tick").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("promo_tick").alias("v"))
    line = tasks.select("chain_id", "task_id", (F.col("ord") - 1).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("v")).unionByName(marks)
    found = asof_latest(line, ["chain_id"], ["at", "kind"], "at div 64", "v", "version_tick")
    return found.filter("kind = 1").select("chain_id", "task_id", "version_tick")
