"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become integers (``floor(scale x)``). Rows are ordered by label and by their position on a Hilbert curve through all
dimensions, cut into blocks and written as Parquet, a row a block, with the least and largest value of every dimension (the zone map) and
of the label. For an anchor a, interval arithmetic over a block's zone map bounds every score in it: the sum over dimensions of the smaller
and of the larger of a_d * low_d and a_d * high_d. The bounds choose the blocks that an anchor must read:

* positives (its k best rows of the same label): first the two blocks with the highest upper bounds, whose k-th score is a floor; then
  every block whose upper bound reaches that floor;
* negatives (for each positive the k best rows of other labels with ``near`` percent of the positive's score at least, and no
  more than all of it: a window of scores): first two blocks whose bounds lie around the windows, whose k-th scores raise the windows' lower
  ends; then every block whose bounds meet a window.

Only (block, anchors) pairs that the bounds leave are joined with the block table, and only the vectors of those anchors are sent. What a
block returns is at most k rows an anchor and window. The bounds are widened by more than doubles can be off; scores are
exact integers, cut to 64 bits. Results are exact whatever the bounds leave out.

Defined results: rows without vec_id, with a NULL label, a NULL vector or a NULL or non-finite component take no part; shorter vectors count as
padded with zeros; rows with an anchor's id are its own and neither positives nor negatives; an anchor row that is repeated is answered
for each row; a positive or negative row that is repeated counts as often; windows of negative scores are empty; an
empty table gives no rows.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import doubles, integer_scores, longs, matrix, usable
from .common import materialise, salted_join
from .topk import quantise

ANCHOR_BLOCK, ROW_BLOCK, ZONE_GROUP, BITS = 256, 2048, 512, 4
LEAST = np.iinfo(np.int64).min
BLOCKS = "block long, n int, ids binary, labels binary, mat binary, low binary, high binary, first_label long, last_label long"
FOUND = "aq long, pos int, w int, id long, score long"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Positions of grid cells (rows, dimensions; values below 2 ** bits) on the Hilbert curve, as bytes that sort like them.

    The transposed index of Skilling (2004): undo the excess rotations from the highest bit down, then Gray-encode; bit planes of
    the result, interleaved over the dimensions, are the index."""
    x = cells.astype(np.uint32).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap).astype(np.uint32)
            x[i] ^= swap.astype(np.uint32)
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= flip
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])                # (bits, dimensions, rows)
    packed = np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)
    return [r.tobytes() for r in packed]


def _with_key(mean: np.ndarray, spread: np.ndarray, dim: int, bits: int):
    def run(batches):
        for b in batches:
            if len(b):
                m = matrix(b["v"], dim)
                cell = np.clip(((m - mean) / spread + 3) / 6 * (1 << bits), 0, (1 << bits) - 1)
                yield b.assign(key=hilbert_keys(cell, bits))
    return run


def _packed(dim: int, size: int, scale: float, number: bool = True):
    """Blocks of rows in the order in which they come; ids ascend inside a block."""
    from pyspark import TaskContext

    def run(batches):
        ctx = TaskContext.get()
        no, held = (ctx.partitionId() if ctx else 0) << 32, []

        def block(part: pd.DataFrame, no: int) -> pd.DataFrame:
            part = part.sort_values("vec_id", kind="stable")
            m = quantise(scale)(matrix(part["v"], dim))
            label = part["label"].to_numpy(np.int64)
            return pd.DataFrame({"block": [no], "n": [len(part)], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "labels": [label.tobytes()],
                                 "mat": [m.tobytes()], "low": [m.min(axis=0).tobytes()], "high": [m.max(axis=0).tobytes()],
                                 "first_label": [label.min()], "last_label": [label.max()]})

        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= size:
                rows = pd.concat(held, ignore_index=True)
                yield block(rows.iloc[:size], no)
                no, held = no + 1, [rows.iloc[size:]]
        if sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True), no)
    return run


def _zone_groups(zones: DataFrame, dim: int) -> DataFrame:
    """Zone maps of up to ZONE_GROUP blocks in one row."""
    def run(batches):
        for b in batches:
            for i in range(0, len(b), ZONE_GROUP):
                z = b.iloc[i:i + ZONE_GROUP]
                yield pd.DataFrame({"blocks": [z["block"].to_numpy(np.int64).tobytes()], "low": [b"".join(z["low"])], "high": [b"".join(z["high"])],
                                    "labels": [z[["first_label", "last_label"]].to_numpy(np.int64).tobytes()]})
    return zones.select("block", "low", "high", "first_label", "last_label").mapInPandas(run, "blocks binary, low binary, high binary, labels binary")


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of every anchor (row) with any vector of every block (column)."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    slack = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T * (a.shape[1] + 2) * 2.0 ** -51 + 1
    return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack


def _windows(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends (anchor, window); windows that are not there are empty."""
    w = longs(raw).reshape(2, n, -1)
    return w[0], w[1]


def _eligible(labels: np.ndarray, zone: np.ndarray, same: bool) -> np.ndarray:
    first, last = zone[:, 0][None, :], zone[:, 1][None, :]
    mine = labels[:, None]
    return (first <= mine) & (mine <= last) if same else ~((first == mine) & (last == mine))


def _choose(same: bool, seeds: int):
    """Which blocks to read. With ``seeds``: the most promising of this group for each anchor; without: all that the bounds leave."""
    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                blocks = longs(row.blocks)
                ok = _eligible(longs(row.labels), longs(row.z_labels).reshape(-1, 2), same)
                lower, upper = bounds(doubles(row.mat, row.n), doubles(row.low, len(blocks)), doubles(row.high, len(blocks)))
                lo, hi = _windows(row.windows, row.n)
                meets = np.zeros(ok.shape, bool)
                for w in range(lo.shape[1]):
                    meets |= (lo[:, w] <= hi[:, w])[:, None] & (upper >= lo[:, w].astype(float)[:, None]) & (lower <= hi[:, w].astype(float)[:, None])
                ok &= meets
                if seeds:
                    top = hi.max(axis=1).astype(float)[:, None]
                    worth = upper if same else -np.abs((lower + upper) / 2 - top)
                    worth = np.where(ok, worth, -np.inf)
                    m = min(seeds, len(blocks))
                    best = np.argpartition(-worth, m - 1, axis=1)[:, :m]
                    at = np.repeat(np.arange(row.n), m)
                    chosen = best.ravel()
                    use = ok[at, chosen]
                    yield pd.DataFrame({"aq": row.aq, "pos": at[use].astype(np.int32), "block": blocks[chosen[use]], "worth": worth[at[use], chosen[use]]})
                else:
                    some = np.nonzero(ok.any(axis=0))[0]
                    yield pd.DataFrame({"aq": row.aq, "block": blocks[some], "at": [np.nonzero(ok[:, j])[0].astype(np.int32).tobytes() for j in some]})
    return run


def _send(batches):
    """Only the anchors that read the block."""
    for b in batches:
        out = []
        for row in b.itertuples(index=False):
            at = np.frombuffer(row.at, np.int32)
            lo, hi = _windows(row.windows, row.n)
            out.append((row.block, row.aq, at.tobytes(), longs(row.ids)[at].tobytes(), longs(row.labels)[at].tobytes(),
                        doubles(row.mat, row.n)[at].tobytes(), np.stack([lo[at], hi[at]]).tobytes()))
        yield pd.DataFrame(out, columns=["a_block", "aq", "at", "a_ids", "a_labels", "a_mat", "a_windows"])


def _read(same: bool, k: int):
    """The k best rows of a block for every anchor and window."""
    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                at, ids = np.frombuffer(row.at, np.int32), longs(row.ids)
                s = integer_scores(doubles(row.a_mat, len(at)), doubles(row.mat, row.n))
                fit = longs(row.a_labels)[:, None] == longs(row.labels)[None, :]
                s[(fit != same) | (longs(row.a_ids)[:, None] == ids[None, :])] = LEAST
                lo, hi = _windows(row.a_windows, len(at))
                for w in range(lo.shape[1]):
                    t = np.where((s >= lo[:, w][:, None]) & (s <= hi[:, w][:, None]), s, LEAST)
                    m = min(k, t.shape[1])
                    kth = np.partition(t, t.shape[1] - m, axis=1)[:, t.shape[1] - m]
                    i, j = np.nonzero((t >= kth[:, None]) & (t > LEAST))
                    order = np.lexsort((j, -t[i, j], i))                     # ids ascend with j
                    i, j = i[order], j[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[place < k], j[place < k]
                    yield pd.DataFrame({"aq": row.aq, "pos": at[i], "w": np.int32(w), "id": ids[j], "score": t[i, j]})
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("aq", "pos", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _search(anchors: DataFrame, blocks: DataFrame, zones: DataFrame, same: bool, k: int) -> DataFrame:
    """aq, pos, w, id, score, rank: for each window of each anchor the k best rows in it."""
    z = zones.select("blocks", "low", "high", F.col("labels").alias("z_labels"))

    def read(pairs: DataFrame, state: DataFrame) -> DataFrame:
        p = pairs.withColumnRenamed("aq", "p_aq")
        sent = p.join(state, F.col("p_aq") == F.col("aq")).drop("p_aq").mapInPandas(
            _send, "a_block long, aq long, at binary, a_ids binary, a_labels binary, a_mat binary, a_windows binary")
        met = salted_join(sent, blocks.select("block", "n", "ids", "labels", "mat"), "a_block", "block", "inner", F.col("aq"), 4)
        return materialise(_best(met.mapInPandas(_read(same, k), FOUND), k))

    slots = max(1, z.count())

    def beside(state: DataFrame) -> DataFrame:
        """Every block of anchors beside every group of zone maps, by an equi-join on slots."""
        groups = z.withColumn("z_slot", F.pmod(F.xxhash64("blocks"), F.lit(slots)).cast("int"))
        return state.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).join(groups, F.col("slot") == F.col("z_slot"))

    tried = beside(anchors).mapInPandas(_choose(same, 2), "aq long, pos int, block long, worth double")
    by = Window.partitionBy("aq", "pos").orderBy(F.col("worth").desc(), "block")
    first = tried.withColumn("r", F.row_number().over(by)).filter("r <= 2").groupBy("aq", "block").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    first = first.mapInPandas(lambda bs: (b.assign(at=[np.asarray(p, np.int32).tobytes() for p in b["p"]]).drop(columns="p") for b in bs if len(b)), "aq long, block long, at binary")
    floors = read(first, anchors).filter(F.col("rank") == k).select("aq", "pos", "w", F.col("score").alias("floor"))
    raised = _with_windows(anchors, floors)
    rest = beside(raised).mapInPandas(_choose(same, 0), "aq long, block long, at binary")
    return read(rest, raised)


def _with_windows(anchors: DataFrame, floors: DataFrame) -> DataFrame:
    """Windows with their lower ends raised to the k-th scores found."""
    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"f_aq": [pdf["aq"].iloc[0]], "f_at": [pdf[["pos", "w"]].to_numpy(np.int64).tobytes()], "f": [pdf["floor"].to_numpy(np.int64).tobytes()]})

    def run(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                w = longs(row.windows).reshape(2, row.n, -1).copy()
                if row.f is not None:
                    at = longs(row.f_at).reshape(-1, 2)
                    w[0, at[:, 0], at[:, 1]] = np.maximum(w[0, at[:, 0], at[:, 1]], longs(row.f))
                out.append(w.tobytes())
            yield b[["aq", "n", "ids", "labels", "mat"]].assign(windows=out)
    packed = floors.groupBy("aq").applyInPandas(gather, "f_aq long, f_at binary, f binary")
    return materialise(anchors.join(packed, F.col("aq") == F.col("f_aq"), "left").mapInPandas(run, "aq long, n int, ids binary, labels binary, mat binary, windows binary"))


def _score_windows(anchors: DataFrame, positives: DataFrame, k: int, near: int) -> DataFrame:
    """A window for each positive: from ``near`` percent of its score, rounded up, to its score."""
    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_aq": [pdf["aq"].iloc[0]], "p": [pdf[["pos", "rank", "score"]].to_numpy(np.int64).tobytes()]})

    def run(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                w = np.stack([np.full((row.n, k), np.iinfo(np.int64).max), np.full((row.n, k), LEAST)])
                if row.p is not None:
                    for pos, rank, score in longs(row.p).reshape(-1, 3).tolist():
                        w[:, pos, rank - 1] = -(-near * score // 100), score
                out.append(w.tobytes())
            yield b[["aq", "n", "ids", "labels", "mat"]].assign(windows=out)
    packed = positives.groupBy("aq").applyInPandas(gather, "p_aq long, p binary")
    return materialise(anchors.join(packed, F.col("aq") == F.col("p_aq"), "left").mapInPandas(run, "aq long, n int, ids binary, labels binary, mat binary, windows binary"))


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, near: int = 80, scale: float = 256.0, bits: int = BITS,
         anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``table`` has vec_id, embedding and label."""
    rows = usable(table.filter(F.col("label").isNotNull()), zero=True, more=[F.col("label").cast("long").alias("label")])
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.count_if(is_anchor).alias("a")).first()
    n, dim = size["n"], max(1, size["d"] or 0)
    stats = {r["d"]: r for r in rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}   # one row a dimension
    mean = np.array([stats[d]["m"] if d in stats else 0.0 for d in range(dim)])
    spread = np.array([stats[d]["s"] if d in stats and stats[d]["s"] > 0 and math.isfinite(stats[d]["s"]) else 1.0 for d in range(dim)])
    keyed = rows.mapInPandas(_with_key(mean, spread, dim, bits), "vec_id long, v array<double>, label long, key binary")
    ordered = keyed.repartitionByRange(max(1, math.ceil(n / row_block)), "label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id")
    blocks = materialise(ordered.select("vec_id", "label", "v").mapInPandas(_packed(dim, row_block, scale), BLOCKS))
    zones = materialise(_zone_groups(blocks, dim))
    chosen = rows.filter(is_anchor).repartition(max(1, math.ceil(size["a"] / anchor_block)))
    packed = chosen.select("vec_id", "label", "v").mapInPandas(_packed(dim, anchor_block, scale), BLOCKS)
    everything = lambda bs: (b.assign(windows=[np.stack([np.full((n, 1), LEAST + 1), np.full((n, 1), np.iinfo(np.int64).max)]).tobytes() for n in b["n"]]) for b in bs)      # noqa: E731
    anchors = materialise(packed.select(F.col("block").alias("aq"), "n", "ids", "labels", "mat").mapInPandas(
        everything, "aq long, n int, ids binary, labels binary, mat binary, windows binary"))

    pos = _search(anchors, blocks, zones, True, positives)
    neg = _search(_score_windows(anchors, pos, positives, near), blocks, zones, False, negatives)
    names = anchors.mapInPandas(lambda bs: (pd.DataFrame({"n_aq": row.aq, "n_pos": np.arange(row.n, dtype=np.int32), "anchor_id": longs(row.ids)}) for b in bs for row in b.itertuples(index=False)),
                                "n_aq long, n_pos int, anchor_id long")
    p = pos.select(F.col("aq").alias("p_aq"), F.col("pos").alias("p_pos"), F.col("rank").alias("p_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (neg.join(p, (F.col("aq") == F.col("p_aq")) & (F.col("pos") == F.col("p_pos")) & (F.col("w") + 1 == F.col("p_rank")))
            .join(names, (F.col("aq") == F.col("n_aq")) & (F.col("pos") == F.col("n_pos")))
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
