"""Line dedup by winnowing over line hashes.

A document is a sequence of lines. A *window* is a shortest run of consecutive lines with at least ``min_words`` words, read forward
from a line or backward from it. The line with the smallest hash in a window is its fingerprint, so any two documents that share a run of
at least ``min_words`` words share a window and therefore a fingerprint: none can be missed. Only fingerprints
that occur more than once in the corpus are followed: their positions are joined, each is extended both ways to the
windows that chose it, and windows with the same lines are matched. All occurrences of a window but the first (by document, then
position) are later repeats; their union is every maximal repeated run, and it is deleted. The first occurrence of a line is
never deleted, so no text is lost from the corpus.

Lines are compared without surrounding white space (space, tab to carriage return). Blank lines carry no word and are passed over; they
stay unless all lines around them go: a document left without any word is emptied.

What is shuffled: a hash and a position per fingerprint (about two in a window's length of lines), then windows around repeated
fingerprints only. Groups are never collected: the first occurrence is a minimum, pre-aggregated before the shuffle.

Defined results: NULL text counts as empty and comes back NULL; rows that agree in id and text are one document and get the same result;
the order of documents is (doc_id, NULL first, then the hash of the text); empty tables give no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import batches_of, materialise, salted_join, utf8

MIN_WORDS = 8


def line_facts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, hashes, words) of the lines that have a word; hashes are two columns of 64 bits. Bytes are split at exactly the white space of the word pattern."""
    at, h, n = [], [], []
    for i, line in enumerate(utf8(text).split(b"\n")):
        words = len(line.split())
        if words:
            at.append(i)
            h.append(xxhash.xxh3_128_digest(line.strip()))
            n.append(words)
    return np.array(at, np.int32), np.frombuffer(b"".join(h), np.uint64).reshape(-1, 2), np.array(n, np.int64)


def windows(n: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of all windows, forward ones then backward ones that differ from them."""
    ends = np.cumsum(n)
    begins = ends - n
    lines = np.arange(len(n))
    last = np.searchsorted(ends, begins + min_words)              # first line that completes the count
    fwd = last < len(n)
    first = np.searchsorted(begins, ends - min_words, side="right") - 1
    back = first >= 0
    pairs = np.concatenate([np.stack([lines[fwd], last[fwd]], 1), np.stack([first[back], lines[back]], 1)])
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs.reshape(0, 2)
    return pairs[:, 0], pairs[:, 1]


def minima(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The line each window chooses: the smallest hash, the rightmost of equal ones. Sparse table of range minima."""
    if not len(first):
        return first
    order = np.lexsort((-np.arange(len(h)), h))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    level, tables = rank, [rank]
    step = 1
    while step * 2 <= len(h):
        level = np.minimum(level[:-step], level[step:])
        tables.append(level)
        step *= 2
    k = np.log2(last - first + 1).astype(np.int64)
    out = np.empty(len(first), np.int64)
    for j in np.unique(k):
        m = k == j
        out[m] = np.minimum(tables[j][first[m]], tables[j][last[m] - (1 << j) + 1])
    return order[out]


def window_keys(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lines of each window, from prefix sums of a polynomial in the line hashes."""
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), base, np.uint64)]))
        pre = np.concatenate([[np.uint64(0)], np.cumsum((h | np.uint64(1)) * power[1:])])
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), inverse, np.uint64)]))
        x = (pre[last + 1] - pre[first]) * back[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: key tells texts of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"))


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """print, doc_id, key, first, last, win, also (two independent hashes of its lines), head: each window of a document with the line hash it chose. ``head`` marks one
    window of each chosen line, so that a sum counts positions."""
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out, rows = [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            at, h, n = line_facts(t or "")
            first, last = windows(n, min_words)
            if not len(first):
                continue
            chosen = minima(h[:, 0], first, last)
            head = np.zeros(len(chosen), bool)
            head[np.unique(chosen, return_index=True)[1]] = True
            out.append((h[chosen, 0].copy().view(np.int64), at[first], at[last], window_keys(h[:, 0], first, last), window_keys(h[:, 1], first, last), head))
            rows.append(np.full(len(first), i))
        if out:
            cols, rows = [np.concatenate(c) for c in zip(*out)], pa.array(np.concatenate(rows))
        else:
            cols, rows = [np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64, np.int64, bool)], pa.array([], pa.int64())
        names = ("print", "first", "last", "win", "also", "head")
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("key").take(rows), *map(pa.array, cols)], ["doc_id", "key", *names])

    return docs.mapInArrow(batches_of(one), "doc_id long, key long, print long, first int, last int, win long, also long, head boolean")


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, key, first, last: the windows that occurred earlier."""
    prints = materialise(fingerprints(keyed(docs), min_words))
    # joined positions: fingerprints at two places or more
    often = prints.groupBy("print").agg(F.count(F.when(F.col("head"), 1)).alias("places")).filter(F.col("places") > 1).select(F.col("print").alias("often"))
    place = F.struct("doc_id", "key", "first")
    near = salted_join(prints, often, "print", "often", "inner", place).select("doc_id", "key", "first", "last", "win", "also")
    owner = near.groupBy(F.col("win").alias("o_win"), F.col("also").alias("o_also")).agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("places")).filter(F.col("places") > 1)
    return salted_join(near, owner, "win", "o_win", "inner", place).filter((F.col("also") == F.col("o_also")) & (place > F.col("origin"))).select("doc_id", "key", "first", "last")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """x_doc, x_key, runs: the maximal runs of lines to delete, as sorted array<struct<first,last>>. A document's windows in
    order of their first line start a new run where the line is beyond all that was reached before."""
    order = Window.partitionBy("doc_id", "key").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeated_windows(docs, min_words).withColumn("new", F.when(F.coalesce(F.col("first") > reached + 1, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy(F.col("doc_id").alias("x_doc"), F.col("key").alias("x_key")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def cut(text: str, runs: list[int]) -> str:
    """A text without the lines of its runs (first, last, first, last, ...); without any word left it becomes empty."""
    lines = text.split("\n")
    kept, at = [], 0
    for first, last in zip(runs[::2], runs[1::2]):
        kept += lines[at:first]
        at = last + 1
    left = "\n".join(kept + lines[at:])
    return left if utf8(left).split() else ""


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, runs_name: str = "runs") -> DataFrame:
    """The columns of ``docs`` with the text cut, and a last column ``runs_name`` (the deleted runs of lines as first, last, first, last,
    ...; NULL where nothing went), which must not be a column of ``docs``."""
    if runs_name in docs.columns:
        raise ValueError(f"{runs_name} is a column of the input")
    gone = deletions(docs, min_words).select("x_doc", "x_key", F.flatten(F.transform("runs", lambda r: F.array(r["first"], r["last"]))).alias("x_runs"))
    text = F.col("text").cast("string")
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text.alias("body"), F.col("doc_id").cast("long").alias("d_doc"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("d_key"))
    joined = body.join(gone, F.col("d_doc").eqNullSafe(F.col("x_doc")) & (F.col("d_key") == F.col("x_key")), "left")
    flat = joined.select(*[F.col("body").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], F.col("x_runs").alias(runs_name))
    at = flat.columns.index("text")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        runs = b.column(b.num_columns - 1)
        if runs.null_count == b.num_rows:
            return b
        new = [t if r is None or t is None else cut(t, r) for t, r in zip(b.column(at).to_pylist(), runs.to_pylist())]
        columns = b.columns
        columns[at] = pa.array(new, b.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return flat.mapInArrow(batches_of(one), flat.schema)


SQL = f"""
WITH raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
every AS (SELECT doc_id, u.ln - 1 AS ln, ls[u.ln] AS line FROM raw, unnest(range(1, len(ls) + 1)) AS u(ln)),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY ln) AS c FROM (
  SELECT doc_id, ln, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
    len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS n FROM every) WHERE n > 0),
w AS (SELECT a.doc_id, a.i AS f, min(b.i) AS t FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {MIN_WORDS} AND b.c - a.c + a.n >= {MIN_WORDS} GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i), b.i FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - {MIN_WORDS} AND b.i AND b.c - a.c + a.n >= {MIN_WORDS} GROUP BY b.doc_id, b.i),
c AS (SELECT w.doc_id, f, t, min(l.ln) AS first, max(l.ln) AS last, string_agg(line, chr(10) ORDER BY l.i) AS body
  FROM w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN f AND t GROUP BY w.doc_id, f, t),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS nth FROM c),
d AS (SELECT DISTINCT e.doc_id, e.ln FROM every e JOIN o ON o.nth > 1 AND e.doc_id = o.doc_id AND e.ln BETWEEN o.first AND o.last),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(d.ln) AS n_deleted, string_agg(CASE WHEN d.ln IS NULL THEN e.line END, chr(10) ORDER BY e.ln) AS body
  FROM every e LEFT JOIN d ON e.doc_id = d.doc_id AND e.ln = d.ln GROUP BY e.doc_id)
SELECT doc_id, n_lines::INT AS n_lines, n_deleted::INT AS n_deleted,
  sha256(CASE WHEN n_deleted = 0 THEN coalesce(body, '') WHEN regexp_matches(coalesce(body, ''), '[^ \t\n\x0B\f\r]') THEN body ELSE '' END) AS text_sha256 FROM k
"""
