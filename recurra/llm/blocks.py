"""Vectors in packed blocks: a query set against all rows as (query block, index block) units.

A block is one row that holds the ids and the matrix of a bounded number of vectors. A query block meets every index block
through an equi-join on a slot number, so each unit is one row of one task and what a unit returns is bounded by its queries.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = "block long, n int, ids binary, mat binary, extra binary"


def usable(table: DataFrame, zero: bool, more: Sequence[Column] = ()) -> DataFrame:
    """vec_id, v (and ``more``): rows with an id and a vector without NULL or non-finite components (and not all zero unless ``zero``)."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *more).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    ok = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(ok if zero else ok & F.exists("v", lambda x: x != 0.0))


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows as doubles; shorter vectors count as padded with zeros."""
    if all(len(x) == dim for x in column):
        return np.stack(column.to_list()).astype(np.float64).reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        out[i, :len(x)] = x
    return out


def pack(rows: DataFrame, dim: int, size: int, make: Callable[[np.ndarray], np.ndarray] | None = None,
         extra: Callable[[np.ndarray], bytes] | None = None, ids_col: str = "vec_id") -> DataFrame:
    """Blocks of at most ``size`` rows of each partition. ``make`` maps the matrix, ``extra`` adds bytes made from it.
    ``ids_col`` is a long or a list of longs (then ids are written as (row, id) pairs). Block numbers are unique;
    write the result before using them twice."""
    def run(batches):
        ctx = TaskContext.get()
        number = (ctx.partitionId() if ctx else 0) << 32
        held: list[pd.DataFrame] = []

        def block(part: pd.DataFrame, no: int) -> pd.DataFrame:
            m = matrix(part["v"], dim)
            m = make(m) if make else m
            if len(part) and not np.isscalar(part["ids"].iloc[0]):
                lens = part["ids"].map(len).to_numpy()
                ids = np.stack([np.repeat(np.arange(len(part)), lens), np.concatenate(part["ids"].to_list())])
            else:
                ids = part["ids"].to_numpy()
            return pd.DataFrame({"block": [no], "n": [len(part)], "ids": [np.ascontiguousarray(ids, np.int64).tobytes()], "mat": [m.tobytes()],
                                 "extra": [extra(m) if extra else b""]})

        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= size:
                all_rows = pd.concat(held, ignore_index=True)
                yield block(all_rows.iloc[:size].reset_index(drop=True), number)
                number += 1
                held = [all_rows.iloc[size:].reset_index(drop=True)]
        rest = pd.concat(held, ignore_index=True) if held else []
        if len(rest):
            yield block(rest, number)

    return rows.select(F.col(ids_col).alias("ids"), "v").mapInPandas(run, BLOCK)


def units(queries: DataFrame, index: DataFrame, n_index: int) -> DataFrame:
    """Every query block beside every index block (columns of the index block prefixed ``c_``), each pair once.
    The query block is sent to each of the slots, an index block sits in one."""
    slots = max(1, n_index)
    q = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(slots, "slot")
    c = index.select(*[F.col(x).alias(f"c_{x}") for x in ("block", "n", "ids", "mat", "extra")])
    c = c.withColumn("c_slot", F.pmod(F.xxhash64("c_block"), F.lit(slots)).cast("int")).repartition(slots, "c_slot")
    return q.join(c, F.col("slot") == F.col("c_slot")).drop("slot", "c_slot")


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def doubles(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, -1)


def integer_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products (query, candidate) of integers held as doubles, exact; what 64 bits do not hold is cut to their largest value or
    its negative. Doubles multiply where they are exact, 64-bit integers beyond, and whole numbers of any length for rows that need them."""
    top_q, top_c = np.abs(q).max(axis=1, initial=0), np.abs(c).max(axis=1, initial=0)
    most = float(top_q.max(initial=0)) * float(top_c.max(initial=0)) * max(1, q.shape[1])
    if most < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    side = np.sqrt(2.0 ** 62 / max(1, q.shape[1]))
    long_q, long_c = np.nonzero(top_q >= side)[0], np.nonzero(top_c >= side)[0]
    small_q, small_c = q.copy(), c.copy()
    small_q[long_q], small_c[long_c] = 0, 0
    s = small_q.astype(np.int64) @ small_c.astype(np.int64).T
    if len(long_q) or len(long_c):
        end = (1 << 63) - 1
        whole = np.frompyfunc(int, 1, 1)
        cut = np.frompyfunc(lambda x: max(-end, min(end, x)), 1, 1)
        wq, wc = whole(q), whole(c)
        if len(long_q):
            s[long_q] = cut(wq[long_q] @ wc.T).astype(np.int64)
        if len(long_c):
            s[:, long_c] = cut(wq @ wc[long_c].T).astype(np.int64)
    return s
