"""Vector clocks as maps: ticking, merging, comparing, and what a wall clock gets wrong."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.running import running


def tick(clock: Column, agent: Column) -> Column:
    one = F.create_map(agent, F.lit(1).cast("long"))
    return F.map_zip_with(clock, one, lambda _k, a, b: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(b, F.lit(0).cast("long")))


def merge(a: Column, b: Column) -> Column:
    """Pointwise maximum."""
    return F.map_zip_with(a, b, lambda _k, x, y: F.greatest(x, y))


def normalise(clock: Column) -> Column:
    """Drop zero counts."""
    return F.map_filter(clock, lambda _k, v: v > 0)


def canonical(clock: Column) -> Column:
    """Comparable, hashable text form: agents sorted, zero counts dropped."""
    items = F.sort_array(F.map_entries(normalise(clock)))
    return F.array_join(F.transform(items, lambda e: F.concat(e.getField("key"), F.lit(":"), e.getField("value").cast("string"))), ",")


def leq(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(normalise(a)), lambda e: F.coalesce(F.try_element_at(b, e.getField("key")), F.lit(0).cast("long")) >= e.getField("value"))


def relation(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent."""
    le, ge = leq(a, b), leq(b, a)
    return F.when(le & ge, "equal").when(le, "before").when(ge, "after").otherwise("concurrent")


def merge_rows(df: DataFrame, by: Sequence[str], clock: str, out: str = "clock") -> DataFrame:
    """Merged clock per group: per-agent maxima combine map-side."""
    per = df.select(*by, F.explode(clock).alias("agent", "n")).groupBy(*by, "agent").agg(F.max("n").alias("n"))
    return per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("agent", "n"))).alias(out))


def turn_clocks(turns: DataFrame, agents: Sequence[str], isolated: Sequence[str] = ()) -> DataFrame:
    """Clock of each turn of a conversation: turns so far per agent. Isolated agents share with nobody."""
    sums = {f"n_{a}": F.when(F.col("role") == a, 1).otherwise(0) for a in agents}
    r = running(turns, ["conv_id"], ["turn"], "turn div 64", sums, inclusive=True)
    parts = []
    for a in agents:
        seen = F.col("role") == a if a in isolated else ~F.col("role").isin(*isolated) if isolated else F.lit(True)
        parts += [F.lit(a), F.when(seen, F.col(f"n_{a}")).otherwise(0).cast("long")]
    return r.withColumn("clock", normalise(F.create_map(*parts))).drop(*sums)


def with_memories(turns: DataFrame, memories: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Every turn (``a_``) beside every memory (``m_``) of its conversation, whatever lies between them. ``memories`` is a
    table of its own; the result has turns times memories rows."""
    m = memories.select(F.col(by).alias("__by"), *[F.col(c).alias(f"m_{c}") for c in columns])
    return (turns.select(by, *[F.col(c).alias(f"a_{c}") for c in columns]).join(m, F.col(by).eqNullSafe(F.col("__by"))).drop("__by"))


def known_before(turns: DataFrame, memory: Column, agents: Sequence[str], by: str = "conv_id", order: str = "turn", bucket: str = "turn div 64") -> DataFrame:
    """``known``: how many memories lie in the causal past of each turn, without a pair. The past of a turn is a frontier, its
    clock: of each agent's memories the first so many turns of that agent are known, which a running count has ready."""
    r = running(turns, [by], [order], bucket, {f"m_{a}": F.when((F.col("role") == a) & memory, 1).otherwise(0) for a in agents}, inclusive=True)
    seen = [F.when(F.coalesce(F.try_element_at("clock", F.lit(a)), F.lit(0)) > 0, F.col(f"m_{a}")).otherwise(0) for a in agents]
    total = seen[0]
    for s in seen[1:]:
        total = total + s
    return r.withColumn("known", total.cast("long")).drop(*[f"m_{a}" for a in agents])


def skew_counts(turns: DataFrame, memory: Column, agents: Sequence[str], by: str = "conv_id", wall: str = "wall", bucket: str = "wall div 4096") -> DataFrame:
    """:func:`skew_disagreement` of every turn with every memory of its conversation, without a pair. Of each agent's memories a turn
    knows the first so many, by its clock and by wall time alike, so those known by both are the smaller number. An agent's own
    wall clock must not run backwards."""
    mine = {f"m_{a}": F.when((F.col("role") == a) & memory, 1).otherwise(0) for a in agents}
    t = running(turns, [by], ["turn"], "turn div 64", mine, inclusive=True)
    at = turns.groupBy(by, wall).agg(*[F.sum(v).alias(f"s_{k}") for k, v in mine.items()])              # equal times are known to each other
    at = running(at, [by], [wall], bucket, {f"w_{a}": F.col(f"s_m_{a}") for a in agents}, inclusive=True)
    at = at.select(F.col(by).alias("__by"), F.col(wall).alias("__wall"), *[f"w_{a}" for a in agents])
    every = turns.groupBy(F.col(by).alias("__all")).agg(F.sum(F.when(memory, 1).otherwise(0)).alias("n_all"))
    t = t.join(at, F.col(by).eqNullSafe(F.col("__by")) & (F.col(wall) == F.col("__wall"))).join(every, F.col(by).eqNullSafe(F.col("__all")))
    causal = {a: F.when(F.coalesce(F.try_element_at("clock", F.lit(a)), F.lit(0)) > 0, F.col(f"m_{a}")).otherwise(0) for a in agents}
    total = lambda cols: sum(cols, F.lit(0))          # noqa: E731
    t = t.select("n_all", total(causal.values()).alias("c"), total(F.col(f"w_{a}") for a in agents).alias("w"), total(F.least(causal[a], F.col(f"w_{a}")) for a in agents).alias("b"))
    n = t.agg(F.sum("b").alias("tt"), F.sum(F.col("c") - F.col("b")).alias("tf"), F.sum(F.col("w") - F.col("b")).alias("ft"), F.sum(F.col("n_all") - F.col("c") - F.col("w") + F.col("b")).alias("ff"))
    cells = F.array(*[F.struct(F.lit(x[0] == "t").alias("knew_causal"), F.lit(x[1] == "t").alias("knew_wall"), F.col(x).cast("long").alias("n")) for x in ("tt", "tf", "ft", "ff")])
    return n.select(F.inline(cells)).filter("n > 0")


def causal_join(pairs: DataFrame, memory: str = "m_clock", action: str = "a_clock") -> DataFrame:
    """Pairs in which the memory lies in the action's causal past."""
    return pairs.filter(leq(F.col(memory), F.col(action)))


def skew_disagreement(pairs: DataFrame) -> DataFrame:
    """knew by causal order against knew by wall clock, counted."""
    return (pairs.select(leq(F.col("m_clock"), F.col("a_clock")).alias("knew_causal"), (F.col("a_wall") >= F.col("m_wall")).alias("knew_wall"))
            .groupBy("knew_causal", "knew_wall").agg(F.count("*").alias("n")))
