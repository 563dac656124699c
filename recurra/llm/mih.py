"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (iterative quantisation) turns each vector into a binary code. The code is split into
substrings; each block of the index has one table per substring, from its value to the rows that hold it. For a Hamming
radius r, substring j is probed at every value within t_j bits, where the t_j + 1 add up to r + 1: by the pigeonhole
principle every code within r agrees with the query to t_j bits in some substring j, so the probes retrieve all of them.
Retrieved codes within r are reranked by the double inner product of the original vectors.

How far a query must look is its own matter: on the sample, the Hamming distance is learned that ``recall`` of all pairs with a given
angle keep to (``reach``; for angles that the sample does not show, from the share of bits that random hyperplanes would differ in).
A query is done when it has k rows and the radius searched covers the angle of its k-th: what scores higher lies at a smaller angle. The others
are searched again with one more bit in every substring each time, until that holds or the radius is all bits. So lone queries, whose k-th
neighbour is far away, look further than those in clusters, and every query gets min(k, candidates) rows.

Inner products are turned into angles first: a row is divided by the largest norm and gets one more component that fills it up to
norm 1, a query gets 0 there. The first radius is the Hamming distance within which ``recall`` of the true neighbours in the
sample lie (at the rank in the sample that corresponds to ``k`` in all rows).

Copies of one vector are indexed once, with their k + 1 smallest ids: they score alike, so no further id can be returned.
Every row is indexed. ``sample`` (rows) and ``probes`` (sample queries) are the documented bounds of what is learned from.

Defined results: NULL or zero vectors, vectors with NULL or non-finite components and rows without id take no part; shorter
vectors count as padded with zeros; rows with the query's id are its own; a repeated query row is answered once for each
row; fewer candidates than k: all of them; an empty table gives no rows.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import BLOCK, doubles, longs, matrix, pack, units, usable
from .common import draw, materialise

BITS = 64                       # a code is one machine word
PART = 8                        # bits of a substring, about
ANGLES = 64                     # cosines are told apart in so many steps


@dataclass(frozen=True)
class Codes:
    rotation: np.ndarray        # (dim + 1, bits)
    norm: float                 # the largest norm
    radius: int
    reach: tuple[int, ...] = (BITS,) * ANGLES          # by cosine from -1 to 1

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def parts(self) -> list[tuple[int, int]]:
        """(first bit, width) of the substrings."""
        m = max(1, round(self.bits / PART))
        cuts = [self.bits * i // m for i in range(m + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def thresholds(self) -> list[int]:
        """t_j with the t_j + 1 adding up to radius + 1; -1: not probed."""
        m = len(self.parts())
        base, more = divmod(self.radius + 1, m)
        return [base - 1 + (j < more) for j in range(m)]

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1 - ((x / self.norm) ** 2).sum(1)))
        y = np.hstack([x / self.norm, last[:, None]]) @ self.rotation > 0
        return (y.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: principal axes, then the rotation that brings the signs closest to the values."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(7).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
        r = u @ w
    return axes @ r


def learn_reach(cosine: np.ndarray, ham: np.ndarray, bits: int, recall: float) -> tuple[int, ...]:
    """For every step of the cosine, the Hamming distance that ``recall`` of the pairs at or just above it keep to."""
    step = np.clip(((cosine + 1) / 2 * ANGLES).astype(np.int64), 0, ANGLES - 1)
    out = np.empty(ANGLES)
    for i in range(ANGLES):
        here = ham[step == i]
        p = math.acos(min(1.0, 2 * i / ANGLES - 1)) / math.pi
        out[i] = np.quantile(here, recall, method="higher") if len(here) >= 30 else bits * p + 2 * math.sqrt(bits * p * (1 - p))
    return tuple(int(min(bits, math.ceil(x))) for x in np.maximum.accumulate(out[::-1])[::-1])


def fit(distinct: DataFrame, dim: int, total: int, norm: float, k: int, sample: int = 8192, probes: int = 256, recall: float = 0.97) -> Codes:
    rows = distinct.filter(draw(F.col("first_id")) < F.lit(sample / max(1, total))).select("first_id", "v").orderBy("first_id").toPandas()
    if len(rows) < 2:
        return Codes(np.eye(dim + 1, min(dim, BITS)), norm, BITS)
    x = matrix(rows["v"], dim)
    full = np.hstack([x / norm, np.sqrt(np.maximum(0.0, 1 - ((x / norm) ** 2).sum(1)))[:, None]])
    codes = Codes(learn_rotation(full, min(dim, BITS)), norm, 0)
    at = np.random.default_rng(11).permutation(len(x))[:probes]
    scores = x[at] @ x.T
    scores[np.arange(len(at)), at] = -np.inf
    rank = min(len(x) - 1, max(1, math.ceil(k * len(x) / max(1, total))))
    best = np.argpartition(-scores, rank - 1, axis=1)[:, :rank]
    ham = np.bitwise_count(codes.encode(x[at], True)[:, None] ^ codes.encode(x, False)[None, :]).astype(np.int64)
    near = np.take_along_axis(ham, best, axis=1)
    length = np.linalg.norm(x[at], axis=1)[:, None] * norm
    other = np.isfinite(scores)
    reach = learn_reach((np.where(other, scores, 0.0) / length)[other], ham[other], codes.bits, recall)
    return Codes(codes.rotation, norm, int(np.quantile(near, recall, method="higher")), reach)


class Tables:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray, model: Codes) -> None:
        self.codes, self.model = codes, model
        self.tables = []
        for (first, width), t in zip(model.parts(), model.thresholds()):
            if t < 0:
                continue
            value = ((codes >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << width) + 1))
            all_values = np.arange(1 << width)
            near = all_values[np.bitwise_count(all_values) <= t]           # differences within t bits
            self.tables.append((first, width, order, starts, near))

    def within(self, query: np.uint64) -> np.ndarray:
        """Rows whose code is within the radius: probe, unite, check the whole code."""
        seen = np.zeros(len(self.codes), bool)
        for first, width, order, starts, near in self.tables:
            v = near ^ ((int(query) >> first) & ((1 << width) - 1))
            a, n = starts[v], starts[v + 1] - starts[v]
            ends = np.cumsum(n)
            if ends[-1]:
                seen[order[np.arange(ends[-1]) + np.repeat(a - ends + n, n)]] = True
        rows = np.nonzero(seen)[0]
        return rows[np.bitwise_count(self.codes[rows] ^ query) <= self.model.radius]


def _search(model: Codes, k: int):
    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                q, c = doubles(row.mat, row.n), doubles(row.c_mat, row.c_n)
                own, codes = longs(row.ids), model.encode(q, True)
                at, ids = longs(row.c_ids).reshape(2, -1)
                starts = np.searchsorted(at, np.arange(row.c_n + 1))
                tables = Tables(np.frombuffer(row.c_extra, np.uint64), model)
                out = []
                for i in range(row.n):
                    rows = tables.within(codes[i])
                    if not len(rows):
                        continue
                    s = c[rows] @ q[i]
                    if len(rows) > k + 1:                   # k + 1 distinct vectors, and all that tie with the last
                        keep = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        rows, s = rows[keep], s[keep]
                    n = starts[rows + 1] - starts[rows]
                    ends = np.cumsum(n)
                    got = ids[np.arange(ends[-1]) + np.repeat(starts[rows] - ends + n, n)]
                    s = np.repeat(s, n)
                    ok = got != own[i]
                    got, s = got[ok], s[ok]
                    first = np.lexsort((got, -s))[:k]
                    out.append(pd.DataFrame({"block": row.block, "pos": np.int32(i), "query_id": own[i], "vec_id": got[first], "score": s[first],
                                             "cosine": s[first] / (np.linalg.norm(q[i]) * model.norm)}))
                if out:
                    yield pd.concat(out, ignore_index=True)
    return run


def nearest(table: DataFrame, is_query: Column, k: int, query_block: int = 1024, index_block: int = 16384, **learning) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query row."""
    rows = usable(table, zero=False)
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = materialise(rows.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k + 1)
                           .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))          # at most k + 1 ids
                           .withColumn("first_id", F.col("ids")[0]))
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"),
                        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    dim, total = size["d"] or 1, size["n"]
    model = fit(distinct, dim, total, size["norm"] or 1.0, k, **learning)
    index = materialise(pack(distinct.repartition(max(1, math.ceil(total / index_block))), dim, index_block, extra=lambda m: model.encode(m, False).tobytes(), ids_col="ids"))
    queries = materialise(pack(rows.filter(is_query).repartition(max(1, math.ceil(rows.filter(is_query).count() / query_block))), dim, query_block))
    slots = max(1, index.count())
    w = Window.partitionBy("block", "pos").orderBy(F.col("score").desc(), "vec_id")
    done = None
    while True:
        found = units(queries, index, slots).mapInPandas(_search(model, k), "block long, pos int, query_id long, vec_id long, score double, cosine double")
        best = materialise(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        if model.radius >= model.bits:
            break
        step = F.greatest(F.lit(0), F.least(F.lit(ANGLES - 1), F.floor((F.col("cosine") + 1) / 2 * ANGLES))).cast("int")
        need = F.array(*[F.lit(r) for r in model.reach])[step]
        full = best.filter((F.col("rank") == k) & (need <= model.radius)).select(F.col("block").alias("f_block"), F.col("pos").alias("f_pos"))
        left = materialise(_without(queries, full))
        if left.isEmpty():
            break
        kept = best.join(full, (F.col("block") == F.col("f_block")) & (F.col("pos") == F.col("f_pos"))).drop("f_block", "f_pos")
        done = kept if done is None else done.unionByName(kept)
        queries, model = left, replace(model, radius=min(model.bits, model.radius + len(model.parts())))
    done = best if done is None else done.unionByName(best)
    return done.select("query_id", "rank", "vec_id", "score")


def _without(queries: DataFrame, full: DataFrame) -> DataFrame:
    """The query blocks without the queries that are in ``full`` (f_block, f_pos); a block of which nothing is left goes."""
    gone = full.groupBy("f_block").agg(F.collect_list("f_pos").alias("gone"))               # at most a block's queries

    def run(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                stay = np.ones(row.n, bool)
                if row.gone is not None:
                    stay[np.asarray(row.gone, np.int64)] = False
                if stay.any():
                    out.append({"block": row.block, "n": int(stay.sum()), "ids": longs(row.ids)[stay].tobytes(), "mat": doubles(row.mat, row.n)[stay].tobytes(), "extra": b""})
            if out:
                yield pd.DataFrame(out)

    return queries.join(gone, F.col("block") == F.col("f_block"), "left").select("block", "n", "ids", "mat", "gone").mapInPandas(run, BLOCK)
