"""Secret scans with corpus-wide ownership frequency.

Every whole text is scanned for three base kinds of secrets and for further *candidates*: long runs of key
characters that look random. Each candidate value is hashed; the hashes are aggregated over the corpus by distinct
repositories (documents) and distinct owners (sources). A value that occurs under one owner only looks like a live
credential of that owner; one copied across owners is an example. Owner-specific candidates become extra spans;
base spans always stay, and each document also counts how many of its base values are owner-specific.

Defined results: NULL text counts as empty; a NULL owner is an owner of its own; repeated rows are scanned each for
itself but count as one repository; other columns of the input are ignored.
"""
from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark import TaskContext

from .common import batch, materialise, salted_join, slices, utf8

# The base kinds, in the order used for ties, and their patterns.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
HINTS = ("passw", "secret", "token", "api")          # every assign match contains one of them


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, leftmost and non-overlapping per kind.

    Runs of ``[A-Z0-9]`` and ``[0-9a-f]`` are maximal, so a length bound inside the pattern drops exactly the
    matches that are too short. For ``assign`` a failing match still consumes its text: it is dropped afterwards.
    """
    out = []
    low = text.lower() if text.isascii() else None
    if low is None or any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(value: str, min_bits: float = 3.0) -> bool:
    """Letters and digits mixed, and at least ``min_bits`` bits of entropy per character."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= min_bits


def further_candidates(text: str, base: list[tuple[int, int, int, str]], min_bits: float = 3.0) -> list[tuple[int, int, int, str]]:
    """Random-looking runs that overlap no base span."""
    out = []
    merged = sorted((s, e) for s, _, e, _ in base)
    starts, reached = [s for s, _ in merged], list(accumulate((e for _, e in merged), max))
    for m in RUN.finditer(text):
        s, e = m.span()
        before = bisect_left(starts, e)                      # base spans that start before the run ends
        if before and reached[before - 1] > s:
            continue
        if looks_live(m[0], min_bits):
            out.append((s, 3, e, m[0]))
    return out


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(utf8(value), digest_size=8).digest(), "little", signed=True)


SCAN = ("row long, doc_id long, owner string, n_assign long, n_access long, n_hex long, "
        "spans array<struct<start:int,kind:int,end:int,hash:long>>")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", min_bits: float = 3.0) -> DataFrame:
    """One row per document with its base spans and candidates (hashes only, no values)."""

    def run(batches):
        ctx = TaskContext.get()
        first = (ctx.partitionId() if ctx else 0) << 33
        n = 0
        for b in slices(batches):
            counts, spans = [], []
            for t in b.column("text").to_pylist():
                t = t or ""
                base = base_spans(t)
                kinds = Counter(x[1] for x in base)
                counts.append((kinds[0], kinds[1], kinds[2]))
                spans.append([(s, k, e, value_hash(v)) for s, k, e, v in sorted(base + further_candidates(t, base, min_bits))])
            assign, access, hexes = (pa.array(c, pa.int64()) for c in zip(*counts))
            yield batch(row=pa.array(range(first + n, first + n + b.num_rows), pa.int64()), doc_id=b.column("doc_id"), owner=b.column("owner"),
                        n_assign=assign, n_access=access, n_hex=hexes, spans=pa.array(spans, SPANS))
            n += b.num_rows

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(owner).cast("string").alias("owner"))
    return cols.mapInArrow(run, SCAN)


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of every candidate value. Counts are built in three steps (copies within a document,
    documents of an owner, owners), so a value that is everywhere is pre-aggregated at each."""
    seen = scanned.select("doc_id", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    per_doc = seen.distinct()
    per_owner = per_doc.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(docs: DataFrame, max_owners: int = 1, max_repos: int = 16, min_bits: float = 3.0, **columns: str) -> DataFrame:
    """Per document: base counts, all spans ``array<struct<start,kind,end>>``, and how many base values are owner-specific
    (``n_live``: at most ``max_owners`` owners and, all owners together, ``max_repos`` repositories have the value) or widely copied
    (``n_copied``: an example that one owner repeats in many repositories is copied, too). A document is a repository. The scan is written once; only hashes and spans are shuffled."""
    scanned = materialise(scan(docs, min_bits=min_bits, **columns))
    live = ownership(scanned).filter((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).select(F.col("hash").alias("live_hash"))
    each = scanned.select("row", F.inline("spans"))
    found = (salted_join(each, live, "hash", "live_hash", "inner", F.col("row"))
             .groupBy("row").agg(F.collect_list(F.when(F.col("kind") == 3, F.struct("start", "kind", "end"))).alias("added"),
                                 F.sum(F.when(F.col("kind") < 3, 1).otherwise(0)).alias("n_live"))
             .withColumnRenamed("row", "found_row"))
    base = F.transform(F.filter("spans", lambda s: s["kind"] < 3), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    n_live = F.coalesce("n_live", F.lit(0))
    return (scanned.join(found, F.col("row") == F.col("found_row"), "left")
            .select("doc_id", "owner", "n_assign", "n_access", "n_hex", base.alias("base"),
                    F.array_sort(F.concat(base, F.coalesce("added", none))).alias("spans"),
                    n_live.cast("long").alias("n_live"), (F.size(base) - n_live).cast("long").alias("n_copied")))


def joined(spans) -> "F.Column":
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
