"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. The k-th best score of each query is located by histograms: each unit
bins its scores within the query's current interval, Spark adds the bins over all units, the bin in which the count
from above reaches k becomes the next interval, until an interval is a single integer. Then one pass keeps the rows above the
k-th score and, of those equal to it, the smallest ids. A unit reports only bins from its own best score down to its
own k-th: lower ones cannot hold the global k-th. What is shuffled is at most k bins a query and unit.

Defined results: vectors that are NULL or hold NULL or non-finite components, and rows without id, take no part; shorter vectors
count as padded with zeros; rows with the query's id are its own and no candidates; a query row that
is repeated is answered once for each row; fewer candidates than k are all returned; scores are exact
integers, and those beyond 64 bits are cut to the largest of them or its negative; an empty table gives no rows.
"""
from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import doubles, integer_scores, longs, pack, units, usable
from .common import materialise

BINS = 1024
WHOLE = "decimal(38,0)"
QUERY_BLOCK, INDEX_BLOCK = 1024, 8192


def quantise(scale: float):
    """Whole numbers as doubles; beyond the largest double they are cut to it."""
    def run(m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(scale * m), -np.finfo(float).max, np.finfo(float).max)
    return run


def _scores(row) -> np.ndarray:
    """Integer scores (query, candidate); own rows hold the lowest value."""
    s = integer_scores(doubles(row.mat, row.n), doubles(row.c_mat, row.c_n))
    s[longs(row.ids)[:, None] == longs(row.c_ids)[None, :]] = np.iinfo(np.int64).min
    return s


def _state(row) -> np.ndarray:
    """(query, 3): lowest and highest value of the interval, rows still wanted."""
    return np.frombuffer(row.state, np.int64).reshape(-1, 3)


def _histogram(k: int, width: int):
    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                s, st = _scores(row), _state(row)
                low, last, need = st[:, 0], st[:, 1], st[:, 2]
                s[(s > last[:, None]) | (s < low[:, None])] = np.iinfo(np.int64).min
                m = min(k, s.shape[1])
                best = -np.sort(-np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m:], axis=1)
                use = (best >= low[:, None]) & (np.arange(m)[None, :] < need[:, None])
                at, _ = np.nonzero(use)
                bins = ((best[use].view(np.uint64) - low[at].view(np.uint64)) // np.uint64(width)).astype(np.int64)       # differences of 64-bit numbers may need 64 bits
                pairs, n = np.unique(np.stack([at, bins]), axis=1, return_counts=True)
                yield pd.DataFrame({"block": row.block, "pos": pairs[0].astype(np.int32), "bin": pairs[1], "n": n})
    return run


def _final(k: int):
    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                s, st = _scores(row), _state(row)
                ids, own = longs(row.c_ids), longs(row.ids)
                out = []
                m = min(k, s.shape[1])
                floor = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                for i in range(len(own)):
                    kth = max(int(st[i, 0]), int(floor[i]))
                    if kth == np.iinfo(np.int64).min:
                        kth += 1
                    over = np.nonzero(s[i] > kth)[0]
                    ties = np.nonzero(s[i] == kth)[0]
                    if len(ties) > k:                      # only the smallest ids of a tie can be returned
                        ties = ties[np.argpartition(ids[ties], k - 1)[:k]]
                    at = np.concatenate([over, ties])
                    out.append(pd.DataFrame({"block": row.block, "pos": np.int32(i), "query_id": own[i], "vec_id": ids[at], "score": s[i][at]}))
                yield pd.concat(out, ignore_index=True)
    return run


def exact_topk(table: DataFrame, is_query: Column, k: int, scale: float = 256.0, bins: int = BINS,
               query_block: int = QUERY_BLOCK, index_block: int = INDEX_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product of ``floor(scale x)``) of each query's k best rows."""
    rows = usable(table, zero=True)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.count_if(is_query).alias("q"),
                    F.max(F.array_max(F.transform("v", lambda x: F.abs(x) * scale))).alias("m")).first()
    dim, largest = size["d"] or 1, float(size["m"] or 0) + 1
    bound = int(min(dim * largest * largest, 2.0 ** 64)) + 1
    bound = min(bound, (1 << 63) - 1)
    blocks = max(1, math.ceil(size["n"] / index_block))
    index = materialise(pack(rows.repartition(blocks), dim, index_block, quantise(scale)))
    queries = materialise(pack(rows.filter(is_query).repartition(max(1, math.ceil(size["q"] / query_block))), dim, query_block, quantise(scale)))
    n_index = max(1, index.count())

    width = 1
    while width * bins < 2 * bound + 1:
        width *= bins
    need = F.lit(k).cast("long")
    state = queries.select("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"),
                           F.lit(-bound).cast("long").alias("low"), F.lit(bound).cast("long").alias("last"), need.alias("need"))
    while width >= 1:
        hist = (units(_with_state(queries, state), index, n_index).mapInPandas(_histogram(k, width), "block long, pos int, bin long, n long")
                .groupBy("block", "pos", "bin").agg(F.sum("n").alias("n")))
        down = Window.partitionBy("block", "pos").orderBy(F.col("bin").desc())
        reach = hist.withColumn("cum", F.sum("n").over(down))
        s = state.select(F.col("block").alias("sb"), F.col("pos").alias("sp"), "low", "last", "need")
        hit = (reach.join(s, (F.col("block") == F.col("sb")) & (F.col("pos") == F.col("sp")))
               .filter((F.col("cum") >= F.col("need")) & (F.col("cum") - F.col("n") < F.col("need")))
               .select("sb", "sp", (F.col("low").cast(WHOLE) + F.col("bin").cast(WHOLE) * F.lit(Decimal(width)).cast(WHOLE)).alias("low2"), (F.col("need") - F.col("cum") + F.col("n")).alias("need2"))
               .withColumnsRenamed({"sb": "hb", "sp": "hp"}))
        # no bin reaches the count: there are fewer candidates than k, and all of them are wanted
        end = F.least(F.col("low2") + F.lit(Decimal(width - 1)).cast(WHOLE), F.lit(Decimal(bound)).cast(WHOLE)).cast("long")
        state = materialise(s.join(hit, (F.col("sb") == F.col("hb")) & (F.col("sp") == F.col("hp")), "left").select(
            F.col("sb").alias("block"), F.col("sp").alias("pos"), F.coalesce(F.col("low2").cast("long"), "low").alias("low"),
            F.when(F.col("low2").isNull(), F.col("low") - 1).otherwise(end).alias("last"), F.coalesce("need2", "need").alias("need")))
        if width == 1:
            break
        width //= bins
    best = units(_with_state(queries, state), index, n_index).mapInPandas(_final(k), "block long, pos int, query_id long, vec_id long, score long")
    w = Window.partitionBy("block", "pos").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_state(queries: DataFrame, state: DataFrame) -> DataFrame:
    """Query blocks with the states of their queries as one binary column (one block is a bounded number of queries)."""
    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"s_block": [pdf["block"].iloc[0]], "state": [np.ascontiguousarray(pdf[["low", "last", "need"]].to_numpy(np.int64)).tobytes()]})

    packed = state.groupBy("block").applyInPandas(gather, "s_block long, state binary")
    return queries.join(packed, F.col("block") == F.col("s_block")).drop("s_block")
