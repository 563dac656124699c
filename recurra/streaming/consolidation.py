"""The keyed consolidation as a stream.

State per (chain_id, loc): the open entry (start tick, evidence counts) and, once promoted,
the promotion tick. Clusters are dealt by hash into ``GROUPS`` groups, whose states are kept and stepped together: calling
Python costs far more than a cluster's few records, so there are never more calls than groups. Evidence is bounded: a row count and at most ``min_inputs`` distinct
inputs; provenance is in the emitted rows, not in the state. Ticks are event days. Ticks
that pass without records are caught up when the key is next seen or when the watermark
passes the tick at which something is due.
"""
from __future__ import annotations

from collections.abc import Iterator
import json
from datetime import date, datetime, timedelta, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.consolidate import KEYS, Policy

OUTPUT = "chain_id long, loc string, kind string, record_id long, outcome string, tick int"
GROUPS = 2048            # groups of clusters that are stepped in one call
STATE = "clusters string"            # JSON: [chain_id, loc, values of KeyState] of each cluster of a group
_EMPTY = (None, 0, [], -1, None, None, False, None)


class KeyState:
    """One cluster between two records."""

    def __init__(self, values: tuple, p: Policy) -> None:
        self.ins, self.rows, inputs, self.last, self.promo, self.start, self.own, self.bar = values
        self.inputs, self.p = list(inputs or []), p

    def values(self) -> tuple:
        return (self.ins, self.rows, self.inputs, self.last, self.promo, self.start, self.own, self.bar)

    def tick(self, d: int) -> int:
        """The scheduled tick that closes day ``d``."""
        return -(-(d + 1) // self.p.schedule) * self.p.schedule

    def due(self) -> tuple[int | None, int | None]:
        """(tick of promotion, tick of expiry) if no further record arrives."""
        if self.promo is not None or self.ins is None:
            return None, None
        end = None if self.p.ttl is None else self.ins + self.p.ttl
        tick = self.tick(self.last)
        allowed = not (self.p.separation_of_duties and self.own) and (self.bar is None or tick < self.bar)
        ready = allowed and self.rows >= self.p.min_occurrences and len(self.inputs) >= self.p.min_inputs
        return (tick if ready and (end is None or tick < end) else None), end

    def advance(self, to: int) -> int | None:
        """Close ticks up to ``to``; returns the promotion tick if one fired."""
        tick, end = self.due()
        if tick is not None and tick <= to:
            self.promo, self.start, self.ins = tick, self.ins, None
            return tick
        if end is not None and end <= to:
            self.ins, self.rows, self.inputs, self.own = None, 0, [], False
        return None

    def ingest(self, d: int, label: str, input_hash: str, agent: str, opposite: str | None) -> str:
        self.last = d
        if opposite is not None and label == opposite and self.bar is None:
            self.bar = self.tick(d)
        if self.promo is not None:
            return "discarded"
        outcome = "reinforced"
        if self.ins is None:
            self.ins, self.rows, self.inputs, self.own, outcome = d, 0, [], False, "buffered"
        if label in self.p.labels:
            self.rows += 1
            self.own = self.own or agent == self.p.approver
            if input_hash not in self.inputs and len(self.inputs) < self.p.min_inputs:
                self.inputs.append(input_hash)
        return outcome


def _timed(records: DataFrame, delay: str) -> DataFrame:
    return records.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chain_id", "loc", "kind", "record_id", "outcome", "tick"], dtype=object)


def consolidate_stream(records: DataFrame, policy: Policy, origin: str, delay: str, last_tick: int | None = None, contradictions: bool = False) -> DataFrame:
    """``records`` (batch or stream) has chain_id, loc, record_id, ts, d, label, input_hash, agent_id.

    ``delay`` is how far behind the newest row a row may come; split what comes later off with :func:`split_late` first, which
    keeps it in a side table, since the engine drops such rows here. With ``contradictions`` a record of the opposite label bars
    the cluster from the tick that closes it.

    Emits one row per record (kind 'record') and per promotion (kind 'promotion').
    ``origin`` is the date of tick 0; promotions after ``last_tick`` are not made.
    """
    day0 = date.fromisoformat(origin)
    opposite = ("good" if "bad" in policy.labels else "bad") if contradictions else None
    cap = last_tick if last_tick is not None else 2 ** 31 - 1

    def millis(tick: int) -> int:
        return int(datetime.combine(day0 + timedelta(days=tick), datetime.min.time(), timezone.utc).timestamp() * 1000)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(c, loc): KeyState(tuple(v), policy) for c, loc, v in json.loads(state.get[0])} if state.exists else {}
        out: list[tuple] = []
        seen = set()
        if not state.hasTimedOut:
            rows = sorted((x for pdf in batches for x in zip(pdf["ts"], pdf["record_id"].tolist(), pdf["chain_id"], pdf["loc"], pdf["d"].tolist(), pdf["label"], pdf["input_hash"], pdf["agent_id"])), key=lambda x: x[:2])
            for _ts, rid, chain, loc, d, label, input_hash, agent in rows:
                who = (None if chain is None else int(chain), loc)
                s = held.get(who)
                if s is None:
                    s = held[who] = KeyState(_EMPTY, policy)
                seen.add(who)
                made = s.advance(min(d, cap))
                if made is not None:
                    out.append((*who, "promotion", None, None, made))
                out.append((*who, "record", rid, s.ingest(d, label, input_hash, agent, opposite), d))
        mark, due = state.getCurrentWatermarkMs(), []
        now = (datetime.fromtimestamp(mark / 1000, timezone.utc).date() - day0).days if mark > 0 else -1
        for who, s in list(held.items()):
            if who not in seen and now >= 0:            # no row of its own: the watermark closes what is due
                made = s.advance(min(now, cap))
                if made is not None:
                    out.append((*who, "promotion", None, None, made))
                if s.ins is None and s.promo is None and s.bar is None:
                    del held[who]                       # expired and never promoted: nothing left to know
                    continue
            due += [t for t in s.due() if t is not None and t <= cap]
        if not held:
            if state.exists:
                state.remove()
            yield _frame(out)
            return
        state.update((json.dumps([[*who, s.values()] for who, s in held.items()]),))
        if due:
            state.setTimeoutTimestamp(max(millis(min(due)), mark + 1))
        yield _frame(out)

    keyed = _timed(records, delay).select(F.pmod(F.xxhash64(*KEYS), F.lit(GROUPS)).alias("grp"), F.col("chain_id").cast("string").alias("chain_id"), "loc",
                                          "record_id", "ts", "d", "label", "input_hash", "agent_id")
    return keyed.groupBy("grp").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def split_late(path: str, time: str, delay_seconds: int):
    """foreachBatch function: rows of a batch go to ``path``/on_time or, with a reason, to ``path``/late, under their epoch.

    A row is late when it is more than ``delay_seconds`` behind the newest row of all earlier epochs. The newest time of every
    epoch is stored with it, so a repeated epoch splits as before and overwrites its own folder: no row is lost or doubled.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = None
        if epoch:
            marks = spark.read.schema("newest timestamp, epoch int").parquet(f"{path}/newest")
            seen = marks.filter(F.col("epoch") < epoch).agg(F.max("newest")).first()[0]
        late = F.lit(False) if seen is None else F.coalesce(F.col(time).cast("timestamp") < F.lit(seen) - F.expr(f"INTERVAL {delay_seconds} SECONDS"), F.lit(False))
        reason = F.lit(f"more than {delay_seconds} seconds behind")
        batch.filter(~late).write.mode("overwrite").parquet(f"{path}/on_time/epoch={epoch}")
        batch.filter(late).withColumn("reason", reason).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        batch.agg(F.max(F.col(time).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/epoch={epoch}")
    return write


def drop_repeated(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """A record id counts once."""
    return _timed(records, delay).dropDuplicatesWithinWatermark(["record_id"])


def tick_counts(records: DataFrame, delay: str) -> DataFrame:
    """Records per day and label in tumbling windows."""
    return (_timed(records, delay).groupBy(F.window("ts", "1 day"), "label").agg(F.count("*").alias("n"))
            .select(F.to_date("window.start").alias("day"), "label", "n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop; output as Parquet with exactly-once files."""
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there with a foreachBatch function and stop."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def append_by_epoch(path: str, tables):
    """foreachBatch function: ``tables(batch) -> {name: DataFrame}`` written under the epoch.

    A repeated epoch overwrites its own folder, so a retry never doubles rows.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        for name, df in tables(batch).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")
    return write
