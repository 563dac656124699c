"""Consolidation under a general similarity, where order matters.

With word overlap instead of exact keys every record is compared with everything still in
the buffer, so a chain has to be read in order. Two things keep that scalable and exact:

* Only similarities of at least ``floor`` (the lowest bar any step uses) can change a
  decision. Distinct contents of a chain that are not linked, directly or through others, by
  such a similarity never meet, so each connected component is folded on its own.
* A chain of at most ``CHAIN_ROWS`` records meets once, in one task, which finds its components and folds them: its records
  are shuffled once, whatever the number of settings.
* Longer chains have their components found by a join, and their fold streams: rows arrive sorted, batch by batch, and only the buffer, the promoted
  texts and bounded evidence are held. No such group is ever collected.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..session import materialise
from .consolidate import Policy
from .similarity import distinct_sets, jaccard_set_join

CHAIN_ROWS = 10_000      # records of a chain that one task holds
OUT = "cell string, chain_id long, kind string, record_id long, outcome string, tick int, content string, pure boolean"
OUT_COLUMNS = ["cell", "chain_id", "kind", "record_id", "outcome", "tick", "content", "pure"]


def components(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    """(node, comp): smallest node id reachable. Labels spread along edges, then jump to the
    label of their label; each round is written to the shared folder, so lost executors cost a round."""
    both = materialise(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))))
    linked = both.select(F.col("x").alias("n")).distinct()
    labels = materialise(linked.select("n", F.col("n").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("n", "y"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels["n"] == near["x"]).select("n", F.least("comp", "near").alias("new"), "comp")
        jump = labels.select(F.col("n").alias("new"), F.col("comp").alias("far"))
        nxt = materialise(spread.join(jump, "new").select("n", F.least("new", "far").alias("comp"), (F.least("new", "far") != F.col("comp")).alias("moved")))
        labels = nxt.select("n", "comp")
        if nxt.filter("moved").isEmpty():
            break
    return nodes.select(node).distinct().join(labels.withColumnRenamed("n", node), node, "left").select(node, F.coalesce("comp", F.col(node)).alias("comp"))


def content_components(records: DataFrame, floor: float) -> DataFrame:
    """(chain_id, content, comp) for the distinct contents of every chain."""
    words = F.sort_array(X.words(F.col("content")))
    # the chain is part of each word, so only contents of one chain can meet
    own = F.transform(words, lambda w: F.concat(F.col("chain_id").cast("string"), F.lit("\x1f"), w))
    tagged = records.select("chain_id", "content").distinct().withColumn("ws", own)
    tagged = tagged.withColumn("sid", F.unhex(F.md5(F.concat_ws("\x1e", F.col("chain_id").cast("string"), F.array_join("ws", " ")))))
    tagged = materialise(tagged)
    sets = distinct_sets(tagged)
    comp = components(jaccard_set_join(sets, sets, floor, self_join=True), sets, "sid_l", "sid_r", "sid")
    return tagged.select("chain_id", "content", "sid").join(comp, "sid").drop("sid")


def _split(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(records of chains that one task may hold, records of longer chains or None)."""
    rows = records.filter("chain_id IS NOT NULL AND content IS NOT NULL")
    long = materialise(rows.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHAIN_ROWS).select("chain_id"))
    if long.isEmpty():
        return rows, None
    return rows.join(long, "chain_id", "left_anti"), rows.join(long, "chain_id", "left_semi")


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """The rows of one chain after the other, from batches in the order of the chains. The first column is the chain."""
    held: list = []
    for pdf in batches:
        for r in zip(*[pdf[c].tolist() for c in pdf.columns]):
            if held and r[0] != held[0][0]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _linked(sets: list[frozenset], floor: float) -> list[int]:
    """For each word set the first one it is linked with, directly or through others, by a similarity of at least ``floor``.

    As in the join, two sets that similar share one of their n - ceil(floor n) + 1 rarest words.
    """
    df = Counter(w for s in sets for w in s)
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i
    seen: dict = {}
    for i, s in enumerate(sets):
        words = sorted(s, key=lambda w: (df[w], w))[:len(s) - math.ceil(floor * len(s) - 1e-9) + 1] if s else [None]
        for w in words:
            for j in seen.get(w, ()):
                a, b = top(i), top(j)
                if a != b and _sim(s, sets[j]) >= floor:
                    root[max(a, b)] = min(a, b)
        for w in words:
            seen.setdefault(w, []).append(i)
    return [top(i) for i in range(len(sets))]


def _parts(rows: list, at: int, floor: float) -> list[list[tuple]]:
    """A chain's rows by component, in their order, each with its word set; column ``at`` holds the words, parted by blanks."""
    texts = list(dict.fromkeys(r[at] for r in rows))
    sets = {t: frozenset(t.split(" ")) if t else frozenset() for t in texts}
    comp = dict(zip(texts, _linked(list(sets.values()), floor)))
    out: dict[int, list[tuple]] = {}
    for r in rows:
        out.setdefault(comp[r[at]], []).append((r, sets[r[at]]))
    return list(out.values())


def _by_chain(rows: DataFrame, order: Sequence[str], each: Callable[[list], Iterator[tuple]], columns: list[str], schema: str) -> DataFrame:
    """``each`` on the rows of every chain in ``order``; what it yields are the rows of the result."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for chain in _chains(batches):
            out.extend(each(chain))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out = []
        yield pd.DataFrame(out, columns=columns, dtype=object)
    return rows.repartition("chain_id").sortWithinPartitions("chain_id", *order).mapInPandas(run, schema)


def _sim(a: frozenset, b: frozenset) -> float:
    if not a and not b:
        return 1.0
    inter = len(a & b)
    return inter / (len(a) + len(b) - inter) if inter else 0.0


class _Entry:
    __slots__ = ("words", "ins", "rows", "inputs", "agents", "patterns", "content")

    def __init__(self, words, ins, content):
        self.words, self.ins, self.content = words, ins, content
        self.rows, self.inputs, self.agents, self.patterns = 0, set(), False, set()


class Fold:
    """State of one component: buffered entries in insertion order, promoted texts, the tick."""

    def __init__(self, p: Policy) -> None:
        self.p, self.entries, self.memory, self.now = p, [], [], 0
        self.settled = False            # the last scheduled tick promoted nothing, and nothing has come or gone since

    def support(self, e: _Entry, label: str, input_hash: str, agent: str, pattern: str) -> None:
        self.settled = False
        if label in self.p.labels:
            e.rows += 1
            if len(e.inputs) < max(self.p.min_inputs, 1):       # more distinct inputs cannot change the rule
                e.inputs.add(input_hash)
            e.agents = e.agents or agent == self.p.approver
            if len(e.patterns) < 2:                             # pure or not pure
                e.patterns.add(pattern)

    def clusters(self) -> list[list[_Entry]]:
        out: list[list[_Entry]] = []
        for e in self.entries:
            home = next((c for c in out if _sim(e.words, c[0].words) >= self.p.cluster), None)
            home.append(e) if home is not None else out.append([e])
        return out

    def advance(self, to: int) -> list[tuple[int, str, bool]]:
        """Close the ticks up to ``to``: expire, then promote on schedule."""
        made, p = [], self.p
        while self.now < to:
            if not self.entries:
                self.now = to
                break
            if self.settled:                        # only an expiry can change what the next scheduled tick finds
                due = to + 1 if p.ttl is None else min(e.ins for e in self.entries) + p.ttl
                if due > to:
                    self.now = to
                    break
                self.now = max(self.now, due - 1)
            self.now += 1
            if p.ttl is not None:
                kept = [e for e in self.entries if self.now - e.ins < p.ttl]
                self.settled = self.settled and len(kept) == len(self.entries)
                self.entries = kept
            if self.now % p.schedule:
                continue
            gone: set[int] = set()
            for c in self.clusters():
                inputs = set().union(*[e.inputs for e in c])
                blocked = p.separation_of_duties and any(e.agents for e in c)
                if sum(e.rows for e in c) >= p.min_occurrences and len(inputs) >= p.min_inputs and not blocked:
                    patterns = set().union(*[e.patterns for e in c])
                    made.append((self.now, c[0].content, len(patterns) == 1))
                    self.memory.append(c[0].words)
                    gone.update(id(e) for e in c)
            self.settled = not gone
            self.entries = [e for e in self.entries if id(e) not in gone]
        return made

    def ingest(self, d: int, content: str, words: frozenset, label: str, input_hash: str, agent: str, pattern: str) -> str:
        best, who = 0.0, None
        for e in self.entries:
            s = _sim(words, e.words)
            if s > best:
                best, who = s, e
        for m in self.memory:
            s = _sim(words, m)
            if s > best:
                best, who = s, None
        if 1.0 - best > self.p.theta:
            who = _Entry(words, d, content)
            self.entries.append(who)
            self.support(who, label, input_hash, agent, pattern)
            return "buffered"
        bar = self.p.rho if self.p.rho is not None else 1.0 - self.p.theta
        if who is not None and best >= bar:
            self.support(who, label, input_hash, agent, pattern)
            return "reinforced"
        return "discarded"


def consolidate(records: DataFrame, cells: dict[str, Policy], last_tick: int | None = None) -> DataFrame:
    """Outcome per record (kind 'record') and promotions (kind 'promotion') for every cell of settings.

    ``records`` has chain_id, record_id, ts, d, content, label, input_hash, agent_id, pattern.
    Similarities are found once, at the lowest bar of all cells, and shared by them. The calendar ends at ``last_tick`` or where
    a chain's last record is closed.
    """
    floor = max(min(min(1 - p.theta, p.cluster, p.rho if p.rho is not None else 1.0) for p in cells.values()) - 1e-9, 1e-6)
    short, long = _split(records)

    def each(chain: list) -> Iterator[tuple]:
        who, newest = chain[0][0], max(r[3] for r in chain)
        for rows in _parts(chain, 5, floor):
            for cell, p in cells.items():
                state = Fold(p)
                for (_c, _ts, rid, d, content, _w, label, input_hash, agent, pattern), words in rows:
                    for t, c, ok in state.advance(d):
                        yield cell, who, "promotion", None, None, t, c, ok
                    yield cell, who, "record", rid, state.ingest(d, content, words, label, input_hash, agent, pattern), d, content, None
                for t, c, ok in state.advance(last_tick if last_tick is not None else -(-(newest + 1) // p.schedule) * p.schedule):
                    yield cell, who, "promotion", None, None, t, c, ok
    rows = short.select("chain_id", "ts", "record_id", "d", "content", F.array_join(X.words(F.col("content")), " ").alias("ws"), "label", "input_hash", "agent_id", "pattern")
    out = _by_chain(rows, ["ts", "record_id"], each, OUT_COLUMNS, OUT)
    return out if long is None else out.unionByName(_consolidate_long(long, cells, last_tick, floor))


def _consolidate_long(records: DataFrame, cells: dict[str, Policy], last_tick: int | None, floor: float) -> DataFrame:
    comps = content_components(records, floor)
    names = F.array(*[F.lit(c) for c in cells])
    ends = records.groupBy("chain_id").agg(F.max("d").alias("last_d"))
    rows = (records.join(ends, "chain_id").join(comps, ["chain_id", "content"]).withColumn("cell", F.explode(names))
            .select("cell", "chain_id", "comp", "ts", "record_id", "d", "last_d", "content", X.words(F.col("content")).alias("ws"), "label", "input_hash", "agent_id", "pattern")
            .repartition("cell", "chain_id", "comp").sortWithinPartitions("cell", "chain_id", "comp", "ts", "record_id"))

    def end(key: tuple) -> int:
        if last_tick is not None:
            return last_tick
        step = cells[key[0]].schedule
        return -(-(key[3] + 1) // step) * step

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, here = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                key = (r.cell, r.chain_id, r.comp, int(r.last_d))
                if key != here:
                    if state is not None:
                        out += [(here[0], here[1], "promotion", None, None, t, c, ok) for t, c, ok in state.advance(end(here))]
                    state, here = Fold(cells[r.cell]), key
                out += [(r.cell, r.chain_id, "promotion", None, None, t, c, ok) for t, c, ok in state.advance(int(r.d))]
                got = state.ingest(int(r.d), r.content, frozenset(r.ws), r.label, r.input_hash, r.agent_id, r.pattern)
                out.append((r.cell, r.chain_id, "record", r.record_id, got, int(r.d), r.content, None))
            yield _frame(out)
        if state is not None:
            yield _frame([(here[0], here[1], "promotion", None, None, t, c, ok) for t, c, ok in state.advance(end(here))])
    return rows.mapInPandas(fold, OUT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=OUT_COLUMNS, dtype=object)


def sweep_table(folded: DataFrame, cells: dict[str, Policy], injected: DataFrame | None = None) -> DataFrame:
    """Discard rate, promotions and purity per cell."""
    rec, pro = F.col("kind") == "record", F.col("kind") == "promotion"
    agg = folded.groupBy("cell").agg(
        F.count_if(rec).alias("candidates"), F.count_if(rec & (F.col("outcome") == "buffered")).alias("buffered"),
        F.count_if(rec & (F.col("outcome") == "reinforced")).alias("reinforced"), F.count_if(pro).alias("promoted"), F.count_if(pro & F.col("pure")).alias("n_pure"))
    def setting(name: str):
        v = F.lit(None).cast("double")
        for c, p in cells.items():
            v = F.when(F.col("cell") == c, F.lit(getattr(p, name)).cast("double")).otherwise(v)
        return v.alias(name)
    out = agg.select("cell", setting("theta"), setting("rho"), setting("cluster"), "candidates", "buffered", "reinforced", "promoted",
                     F.round((F.col("candidates") - F.col("buffered")) / F.col("candidates"), 4).alias("discard_rate"),
                     F.round(F.when(F.col("promoted") > 0, F.col("n_pure") / F.col("promoted")), 4).alias("purity"))
    if injected is not None:
        out = out.withColumn("injected", injected.agg(F.round(F.sum("redundant") / F.sum("n"), 4).alias("i")).scalar())
    return out


def leader_clusters(items: DataFrame, order: Sequence[str], floor: float) -> DataFrame:
    """Greedy leader clustering per chain in the given order: chain_id, item_id, leader_id.

    An item joins the first leader at least ``floor`` similar, else leads. ``items`` has
    chain_id, item_id, content and the order columns.
    """
    short, long = _split(items)

    def each(chain: list) -> Iterator[tuple]:
        for rows in _parts(chain, 1, floor):
            leaders: list = []
            for (who, _w, item, *_), words in rows:
                home = next((i for i, w in leaders if _sim(words, w) >= floor), None)
                if home is None:
                    leaders.append((item, words))
                    home = item
                yield who, item, home
    columns = ["chain_id", "item_id", "leader_id"]
    rows = short.select("chain_id", F.array_join(X.words(F.col("content")), " ").alias("ws"), "item_id", *[c for c in dict.fromkeys(order) if c != "item_id"])
    out = _by_chain(rows, order, each, columns, "chain_id long, item_id long, leader_id long")
    return out if long is None else out.unionByName(_leaders_long(long, order, floor))


def _leaders_long(items: DataFrame, order: Sequence[str], floor: float) -> DataFrame:
    comps = content_components(items, floor)
    rows = (items.join(comps, ["chain_id", "content"]).select("chain_id", "comp", *dict.fromkeys([*order, "item_id"]), X.words(F.col("content")).alias("ws"))
            .repartition("chain_id", "comp").sortWithinPartitions("chain_id", "comp", *order))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, leaders = None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.chain_id, r.comp) != here:
                    here, leaders = (r.chain_id, r.comp), []
                words = frozenset(r.ws)
                home = next((i for i, w in leaders if _sim(words, w) >= floor), None)
                if home is None:
                    leaders.append((r.item_id, words))
                    home = r.item_id
                out.append((r.chain_id, r.item_id, home))
            yield pd.DataFrame(out, columns=["chain_id", "item_id", "leader_id"])
    return rows.mapInPandas(fold, "chain_id long, item_id long, leader_id long")
