"""Similarity seams and joins: word-set Jaccard, keyed, cosine over vectors.

Copies are folded first: the joins run over *distinct* word sets, so a text that
occurs a million times is compared once.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..session import materialise, release, small_batches

SCALE = 10_000           # scores are shown and binned at four decimals


# -- pair expressions ---------------------------------------------------------------
def jaccard(a: Column, b: Column) -> Column:
    """Word-set Jaccard of two arrays of distinct words: both empty 1, one empty 0."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / union)


def keyed(loc_a: Column, loc_b: Column, inner: Column) -> Column:
    """1 for the same location, 0 for different ones; ``inner`` when a side names none."""
    return F.when(loc_a.isNull() | loc_b.isNull(), inner).otherwise(F.when(loc_a == loc_b, 1.0).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 when a norm is zero."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


# -- exact Jaccard join ---------------------------------------------------------------
def word_sets(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members: key -> sid, sets: sid, ws, n): one row per distinct word set.

    Both are written once to the shared folder: the join below reads the sets several times,
    and splitting the texts is the expensive part. Words hold no space, so sets are kept and moved as text.
    """
    tagged = docs.select(key, F.array_join(F.sort_array(X.words(F.col(text))), " ").alias("w"))
    tagged = materialise(tagged.withColumn("sid", F.unhex(F.md5("w"))), codec="zstd")
    ws = F.when(F.col("w") == "", F.array().cast("array<string>")).otherwise(F.split("w", " "))
    sets = tagged.groupBy("sid").agg(F.first("w").alias("w")).select("sid", ws.alias("ws"))
    sets = materialise(sets.withColumn("n", F.size("ws")), codec="zstd")
    release(docs.sparkSession)
    return tagged.select(key, "sid"), sets


def distinct_sets(tagged: DataFrame) -> DataFrame:
    """(sid, ws, n) once per set, as a written table."""
    sets = tagged.groupBy("sid").agg(F.first("ws").alias("ws"))
    return materialise(sets.withColumn("n", F.size("ws")), codec="zstd")


SETS, MATCHES = 16_384, 500_000    # word sets of a block; matches of rare words, and counters of pairs, that a task holds at once
WORDS, RUN = 1_000_000, 8            # words of a block's sets; blocks that one task packs, in the order of their sets' sizes
BUCKETS, PARTS = 1 << 20, 16         # words are counted by hash in so many counters, which travel in so many parts
BAND = 1.25                          # sets whose sizes differ by less are probed together


def _token(ws: str) -> Column:
    """Words as 64-bit hashes; two words sharing one only add a candidate to verify."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def _tokens_of(tokens: pa.Array) -> np.ndarray:
    return tokens.flatten().to_numpy(zero_copy_only=False)


def _frequency(corpus: DataFrame) -> np.ndarray:
    """Quarter octaves of the number of sets of the words of each counter. A task returns its counters compressed, so what
    is shuffled follows from the tasks and not from the words."""
    def count(batches):
        total = np.zeros(BUCKETS, np.uint32)
        for b in batches:
            total += np.bincount(_tokens_of(b["tokens"]) & (BUCKETS - 1), minlength=BUCKETS).astype(np.uint32)
        for i, part in enumerate(np.split(total, PARTS)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // PARTS, np.uint32)
        for c in t["counts"]:
            total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        return pa.table({"part": t["part"][:1], "counts": pa.array([zlib.compress(np.minimum(4 * np.log2(np.maximum(total, 1)), 127).astype(np.uint8).tobytes())])})

    out = np.zeros((PARTS, BUCKETS // PARTS), np.uint8)
    parts = corpus.select(_token("ws").alias("tokens")).filter("tokens IS NOT NULL").mapInArrow(count, "part int, counts binary")
    with small_batches(corpus.sparkSession):
        for r in parts.groupBy("part").applyInArrow(add, "part int, counts binary").collect():
            out[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out.ravel()


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def _pack(sets: DataFrame, frequency, floor: float) -> DataFrame:
    """(block, lo, hi, head, words, names), written: a row holds up to ``SETS`` sets of lo to hi words, as (sid, n, o), and all their words as places in
    a list of names.

    ``o`` are the codes of the rarest n - ceil(floor n) + 1 words of a set, in order. A code is how frequent words of its counter are, above 25 bits of
    the word's hash, so all sets order their words alike; words that share a code only add to the matches counted below, also
    where a prefix ends between two of them. Blocks are cut where the sets lie, without a shuffle.
    """
    sets = sets.filter("sid IS NOT NULL AND n > 0").select("sid", "n", "ws")
    total = sets.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("words")).first()
    most = min(SETS, max(256, math.ceil(total["sets"] / RUN)))
    n_blocks = max(1, math.ceil(total["sets"] / most), math.ceil((total["words"] or 0) / WORDS))

    def run(batches):
        held, n_held, n_words = [], 0, 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            n = t["n"].to_numpy().astype(np.int64)
            token = _tokens_of(t["tokens"].chunk(0))
            code = frequency.value[token & (BUCKETS - 1)].astype(np.uint32) << 25 | (token >> 22 & 0x1FFFFFF).astype(np.uint32)
            of = np.repeat(np.arange(len(n)), n)
            code = (np.sort(of << 32 | code) & 0xFFFFFFFF).astype(np.uint32)
            keep = n - np.ceil(floor * n - 1e-9).astype(np.int64) + 1
            begin = np.cumsum(n) - n
            code = code[np.arange(len(code)) - np.repeat(begin, n) < np.repeat(keep, n)]
            o = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(keep)]), pa.array(code))
            ws = t["ws"].chunk(0).flatten()
            names = ws.unique()
            names = names.take(pc.sort_indices(names))
            step = np.diff(pc.index_in(ws, names).to_numpy(zero_copy_only=False), prepend=0).astype(np.int32)      # small numbers, as a set's words are in order
            parts = {"head": {"sid": t["sid"], "n": n, "o": o}, "words": {"step": step}, "names": {"name": names}}
            return pa.RecordBatch.from_pydict({"lo": pa.array(n[:1], pa.int32()), "hi": pa.array(n[-1:], pa.int32()), **{k: [_packed(pa.table(v))] for k, v in parts.items()}})

        for b in batches:
            sizes, at = np.cumsum(b["n"].to_numpy().astype(np.int64)), 0
            while at < b.num_rows:
                room = np.searchsorted(sizes, (sizes[at - 1] if at else 0) + WORDS - n_words, "right") - at
                take = min(b.num_rows - at, most - n_held, max(int(room), 0 if held else 1))
                if take > 0:
                    held.append(b.slice(at, take))
                    n_words += int(sizes[at + take - 1] - (sizes[at - 1] if at else 0))
                    n_held, at = n_held + take, at + take
                if at < b.num_rows or n_held >= most:
                    yield block()
                    held, n_held, n_words = [], 0, 0
        if held:
            yield block()

    rows = sets.coalesce(max(math.ceil(n_blocks / RUN), min(n_blocks, RUN))).sortWithinPartitions("n").select("*", _token("ws").alias("tokens"))
    with small_batches(sets.sparkSession):
        packed = materialise(rows.mapInArrow(run, "lo int, hi int, head binary, words binary, names binary"), codec="uncompressed")      # packed already
    return packed.withColumn("block", F.md5("head"))


def _flat(head: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, codes laid end to end, where each set's codes begin)."""
    o = head["o"].chunk(0)
    size = np.asarray(o.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return head["n"].to_numpy().astype(np.int64), o.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def _candidates(lt: pa.Table, rt: pa.Table, floor: float, one: bool):
    """Places (of the left, of the right) of pairs that may reach ``floor``, by what their prefixes share and what can follow. ``one``: a block with itself.

    Sets lie by size; those of about one size are probed together against the sets that may be similar by size, of which only as many words
    are looked at as a set of that size can miss, and a sixteenth more, which rules out pairs before they are verified."""
    (nl, cl, bl), (nr, cr, br) = _flat(lt), _flat(rt)
    share = floor / (1 + floor)
    doc_r = np.repeat(np.arange(len(nr)), np.diff(br))
    order = np.argsort(cr)
    code_r, doc_r = cr[order], doc_r[order]
    place_r = order - br[doc_r]
    keys = [np.repeat(np.arange(len(n)) << 32, np.diff(b)) | c for n, b, c in ((nl, bl, cl), (nr, br, cr))]
    end_l, left_l = cl[bl[1:] - 1], nl - np.diff(bl)
    order = np.argsort(cl)
    upto = np.empty((2, len(cl)), np.int64)                                            # where each code of the left begins and ends in the right
    for row, side in enumerate(("left", "right")):
        upto[row, order] = np.searchsorted(code_r, cl[order], side)
    lo = 0
    while lo < len(nl):
        hi = int(np.searchsorted(nl, max(nl[lo], int(nl[lo] * BAND)), "right"))
        used = np.minimum(nr - np.ceil(share * (nr + nl[lo]) - 1e-9).astype(np.int64) + 1 + nr // 16, np.diff(br))
        used[(nr < floor * nl[lo] - 1e-9) | (nl[hi - 1] < floor * nr - 1e-9)] = 0
        inside = place_r < used[doc_r]
        posting, kept = doc_r[inside], np.concatenate([[0], np.cumsum(inside)])
        used = np.maximum(used, 1)
        end_r, left_r = cr[br[:-1] + used - 1], nr - used
        first = kept[upto[0, bl[lo]:bl[hi]]]
        n_match = kept[upto[1, bl[lo]:bl[hi]]] - first
        sums = np.concatenate([[0], np.cumsum(n_match)])[bl[lo:hi + 1] - bl[lo]]       # matches before each set of the left
        first_r = int(posting.min()) if len(posting) else 0
        width = int(posting.max()) + 1 - first_r if len(posting) else 1
        a = lo
        while a < hi:
            b = max(a + 1, min(lo + int(np.searchsorted(sums, sums[a - lo] + MATCHES, "right")) - 1, a + max(1, MATCHES // width), hi))
            at = slice(bl[a] - bl[lo], bl[b] - bl[lo])
            k = n_match[at]
            ends = np.cumsum(k)
            if len(ends) and ends[-1]:
                place = np.arange(ends[-1]) + np.repeat(first[at] - ends + k, k)
                of = np.repeat(np.arange(b - a) * width - first_r, np.diff(bl[a:b + 1]))
                count = np.bincount(np.repeat(of, k) + posting[place])
                pair = np.nonzero(count)[0]
                c, i, j = count[pair], pair // width + a, pair % width + first_r
                x, y = nl[i], nr[j]
                need = np.ceil(share * (x + y) - 1e-9)
                low = end_l[i] <= end_r[j]                      # whose prefix ends first: all words up to there are in both prefixes
                ok = (x >= floor * y - 1e-9) & (y >= floor * x - 1e-9) & (c + np.where(low, left_l[i], left_r[j]) >= need)
                if one:
                    ok &= i < j
                c, i, j, x, y, need, low = (v[ok] for v in (c, i, j, x, y, need, low))
                # words of the other set behind that place
                upto_r = np.searchsorted(keys[1], j << 32 | end_l[i], "right") - br[j]
                upto_l = np.searchsorted(keys[0], i << 32 | end_r[j], "right") - bl[i]
                ok = c + np.where(low, y - upto_r, x - upto_l) >= need
                if ok.any():
                    yield i[ok], j[ok]
            a = b
        lo = hi


def _verified(candidates, lt: pa.Table, rt: pa.Table, left: tuple, right: tuple, floor: float):
    """(sid_l, sid_r, inter, union) of the candidates whose whole sets reach ``floor``."""
    words = None
    for i, j in candidates:
        if words is None:
            (names, words), (other, words_r) = ((_unpacked(names)["name"].chunk(0), np.cumsum(_unpacked(w)["step"].to_numpy(), dtype=np.int64)) for w, names in (left, right))
            words_r = pc.fill_null(pc.index_in(other, names), -1).to_numpy()[words_r]         # the same word has the same number now; -1: none
            nl, nr = lt["n"].to_numpy(), rt["n"].to_numpy()
            bl, br = (np.concatenate([[0], np.cumsum(n)]) for n in (nl, nr))
            mine, marked = np.zeros(len(names) + 1, bool), words[:0]
            last = -1
        inter = np.empty(len(i), np.int32)
        for at, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
            if p != last:
                mine[marked] = False
                last, marked = p, words[bl[p]:bl[p + 1]]
                mine[marked] = True
            inter[at] = np.count_nonzero(mine[words_r[br[q]:br[q + 1]]])
        union = (nl[i] + nr[j] - inter).astype(np.int32)
        ok = inter / union >= floor
        if ok.any():
            yield pa.RecordBatch.from_arrays([lt["sid"].chunk(0).take(pa.array(i[ok])), rt["sid"].chunk(0).take(pa.array(j[ok])), pa.array(inter[ok]), pa.array(union[ok])], ["sid_l", "sid_r", "inter", "union"])


def jaccard_set_join(left: DataFrame, right: DataFrame, floor: float, self_join: bool = False) -> DataFrame:
    """All pairs of word sets with Jaccard >= ``floor`` (> 0): sid_l, sid_r, inter, union.

    Words are ordered rarest first, and a set's prefix are its first n - ceil(floor n) + 1: two sets that similar share one there. Up to the place
    where the first of two prefixes ends all common words are in both, so what the prefixes share, and what is left behind that place, bound the
    overlap. Sets lie in packed blocks on the shared storage, and a task reads the two blocks that it compares: matches are counted, and candidates
    verified on the whole sets, inside it. Nothing is shuffled but the counters of words, so disk grows as the sets. Exact.
    """
    if not 0 < floor <= 1:
        raise ValueError("floor must be in (0, 1]")
    spark = left.sparkSession
    corpus = left.select("ws") if self_join else left.select("ws").unionByName(right.select("ws"))
    frequency = spark.sparkContext.broadcast(_frequency(corpus))
    columns = ("block", "lo", "hi", "head", "words", "names")
    l = _pack(left, frequency, floor)
    r = l if self_join else _pack(right, frequency, floor)
    l, r = (x.select(*[F.col(c).alias(f"{c}_{side}") for c in columns]) for x, side in ((l, "l"), (r, "r")))
    near = (F.col("hi_l") >= floor * F.col("lo_r") - 1e-9) & (F.col("hi_r") >= floor * F.col("lo_l") - 1e-9)        # blocks too unlike in size are not compared
    cells = l.join(r, near & (F.col("block_l") <= F.col("block_r")) if self_join else near)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                lh, lw, ln, rh, rw, rn = (c[row].as_py() for c in b.columns)
                lt = _unpacked(lh)
                one = self_join and lh == rh
                rt = lt if one else _unpacked(rh)
                yield from _verified(_candidates(lt, rt, floor, one), lt, rt, (lw, ln), (rw, rn), floor)

    cells = cells.select(*[f"{c}_{side}" for side in "lr" for c in columns[3:]])
    with small_batches(spark):                                                     # a pair of blocks at a time
        out = materialise(cells.mapInArrow(run, "sid_l binary, sid_r binary, inter int, union int"))
    if not self_join:      # two empty texts are identical
        empty = (left.filter("n = 0").select(F.col("sid").alias("sid_l"))
                 .join(right.filter("n = 0").select(F.col("sid").alias("sid_r")), F.col("sid_l") == F.col("sid_r")))
        out = out.unionByName(empty.select("sid_l", "sid_r", F.lit(1).alias("inter"), F.lit(1).alias("union")))
    return out


NEAR_ROWS, NEAR_SETS = 1024, 8192    # texts that meet a block of memories in one call, at least; word sets of such a block


def jaccard_nearest(candidates: DataFrame, key: str, memory: DataFrame, mem_key: str, text: str, floor: float) -> DataFrame:
    """Per candidate the most similar memory at or above ``floor``; ties go to the smallest ``mem_key``.

    Columns: key, nearest_id, max_similarity (both NULL when nothing reaches the floor). At a low floor nearly every text shares a word with nearly every
    memory, so no pairs are listed: a block of memories counts the words it shares with one text after the other, and only the best leaves the task.
    """
    words = F.array_join(F.sort_array(X.words(F.col(text))), " ")
    sets = memory.select(F.col(mem_key).alias("mid"), words.alias("ws")).groupBy("ws").agg(F.min("mid").alias("mid")).filter("ws IS NOT NULL AND mid IS NOT NULL")
    sets = materialise(sets)
    n_sets = sets.count()
    nm, rows = max(1, math.ceil(n_sets / NEAR_SETS)), max(NEAR_ROWS, min(n_sets, NEAR_SETS))
    nq = max(1, math.ceil(candidates.count() / rows))
    q = candidates.select(F.col(key).alias("id"), words.alias("ws")).withColumn("qb", F.pmod(F.xxhash64("id", "ws"), F.lit(nq)).cast("int"))
    q = q.withColumn("mb", F.explode(F.sequence(F.lit(0), F.lit(nm - 1))))
    m = sets.withColumn("mb", F.pmod(F.xxhash64("ws"), F.lit(nm)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    kind, mem_kind = candidates.schema[key].dataType.simpleString(), memory.schema[mem_key].dataType.simpleString()

    def best(q: pa.Table, m: pa.Table) -> pa.Table:
        m = m.sort_by("mid")                                     # the first of the most similar ones is the smallest
        where: dict[str, list[int]] = {}
        theirs = [t.split(" ") if t else [] for t in m["ws"].to_pylist()]
        for i, ws in enumerate(theirs):
            for w in ws:
                where.setdefault(w, []).append(i)
        lists, size = {w: np.array(p) for w, p in where.items()}, np.array([len(ws) for ws in theirs], np.int64)
        texts = q["ws"].to_pylist()
        at, sim = [None] * len(texts), [None] * len(texts)
        for i, t in enumerate(texts if len(size) else []):
            if t is None:
                continue
            mine = t.split(" ") if t else []
            hits = [lists[w] for w in mine if w in lists]
            inter = np.bincount(np.concatenate(hits), minlength=len(size)) if hits else np.zeros(len(size), np.int64)
            union = len(mine) + size - inter
            s = np.where(union == 0, 1.0, inter / np.maximum(union, 1))
            j = int(np.argmax(s))
            if s[j] >= floor:
                at[i], sim[i] = j, float(s[j])
        near = m["mid"].combine_chunks().take(pa.array(at, pa.int64()))
        digest = q["ws"] if nm > 1 else pa.nulls(len(texts), pa.string())         # tells rows of one key apart
        return pa.table({"id": q["id"], "ws": digest, "nearest_id": near, "max_similarity": pa.array(sim, pa.float64())})

    part = q.groupBy("qb", "mb").cogroup(m.groupBy("qb", "mb")).applyInArrow(best, f"id {kind}, ws string, nearest_id {mem_kind}, max_similarity double")
    if nm > 1:                                                     # a row has met every block once
        part = part.groupBy("id", F.md5("ws").alias("d")).agg(F.min(F.when(F.col("nearest_id").isNotNull(), F.struct((-F.col("max_similarity")).alias("neg"), "nearest_id"))).alias("b"), F.count(F.lit(1)).alias("n"))
        part = part.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / nm).cast("int")))).select("id", F.col("b.nearest_id").alias("nearest_id"), (-F.col("b.neg")).alias("max_similarity"))
    return part.select(F.col("id").alias(key), "nearest_id", "max_similarity")


def novelty_gate(candidates: DataFrame, key: str, memory: DataFrame, mem_key: str, text: str, theta: float) -> DataFrame:
    """Admit when surprise = 1 - max similarity exceeds ``theta``, strictly.

    Only similarities that can matter (>= 1 - theta) are searched for; below that the
    decision is known and ``max_similarity`` stays NULL.
    """
    near = jaccard_nearest(candidates, key, memory, mem_key, text, max(1 - theta - 1e-9, 1e-6))
    admitted = F.coalesce((1 - F.col("max_similarity")) > theta, F.lit(theta < 1))          # nothing similar: a surprise of 1
    return near.withColumn("admitted", admitted).withColumn("reason", F.when(admitted, F.lit("novel")).otherwise(F.lit("redundant to memory")))


# -- blocked cosine over dense vectors ------------------------------------------------
GRID, TILE = 32, 256     # blocks a table is cut into at most; rows of a block that are multiplied at once, within the cache


def _blocks(df: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
    n = max(1, min(GRID, math.ceil(df.count() / size)))
    return df.withColumn("__blk", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def _grid(queries: DataFrame, memory: DataFrame, key: str, vec: str, extra: list[str], size: int):
    """Pair every query block with every memory block; blocks hold about ``size`` vectors, more beyond ``GRID`` blocks.

    Dense exact search has to look at every pair; here the looking is a matrix product
    of two bounded blocks, and only the reduced result of a block pair leaves the task. A vector travels
    ``GRID`` times at most, so what is shuffled grows as the table.
    """
    q, nq = _blocks(queries.select(key, vec, *extra), key, size)
    # fresh columns: two sides of one table would otherwise share theirs, which a cogroup mixes up
    m, nm = _blocks(memory.select(*[F.col(c).alias(c) for c in (key, vec, *extra)]), key, size)
    q = q.withColumnRenamed("__blk", "qb").withColumn("mb", F.explode(F.sequence(F.lit(0), F.lit(nm - 1))))
    m = m.withColumnRenamed("__blk", "mb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return q.groupBy("qb", "mb").cogroup(m.groupBy("qb", "mb"))


def _half_grid(vectors: DataFrame, key: str, vec: str, extra: list[str], size: int):
    """Every unordered pair of blocks of one table, a block with itself too: a vector travels ``GRID`` + 1 times at most."""
    q, n = _blocks(vectors.select(key, vec, *extra).filter(F.col(key).isNotNull()), key, size)
    m = q.select(*[F.col(c).alias(c) for c in q.columns])
    q = q.withColumnRenamed("__blk", "qb").withColumn("mb", F.explode(F.sequence(F.col("qb"), F.lit(n - 1))))
    m = m.withColumnRenamed("__blk", "mb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("mb"))))
    return q.groupBy("qb", "mb").cogroup(m.groupBy("qb", "mb"))


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x, np.linalg.norm(x, axis=1)


def _scores(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Clamped cosine of all pairs."""
    (x, nx), (y, ny) = a, b
    s = x @ y.T
    s /= np.outer(np.where(nx > 0, nx, 1), np.where(ny > 0, ny, 1))
    s[~(nx > 0)] = 0
    s[:, ~(ny > 0)] = 0
    return np.clip(s, 0, 1, out=s)


def _tiles(n: int) -> list[slice]:
    return [slice(i, i + TILE) for i in range(0, n, TILE)]


def _pair_tiles(q: pd.DataFrame, m: pd.DataFrame, key: str, vec: str):
    """(rows of q, rows of m, their scores, which of them count) tile by tile: every unordered pair of different keys of a cell of
    the half grid. Both sides are sorted by key; other cells than those of one block with itself count all."""
    if q.empty or m.empty:
        return
    (x, nx), (y, ny), a, b = _matrix(q[vec]), _matrix(m[vec]), q[key].to_numpy(), m[key].to_numpy()
    one = q["qb"].iloc[0] == q["mb"].iloc[0]
    for i in _tiles(len(q)):
        for j in _tiles(len(m)):
            if not one or i.start <= j.start:
                s = _scores((x[i], nx[i]), (y[j], ny[j]))
                yield i, j, s, a[i][:, None] < b[j][None, :] if one else np.True_


def _bins(s: np.ndarray) -> np.ndarray:
    """Scores as whole ten-thousandths, for output and histograms only."""
    return np.floor(s * SCALE + 0.5).astype(np.int64)


def cosine_topk(queries: DataFrame, memory: DataFrame, key: str, vec: str, k: int, block: int = 2048) -> DataFrame:
    """The ``k`` most similar memories per query (ties by id): qid, rank, mid, score, s4 (score in
    ten-thousandths, for display: ranks and ties are by the score itself)."""
    def best(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({"qid": [], "mid": [], "score": [], "s4": []})
        m = m.sort_values(key)
        (x, nx), (y, ny), ids = _matrix(q[vec]), _matrix(m[vec]), m[key].to_numpy()
        out = []
        for i in _tiles(len(q)):
            top, mid = np.empty((len(x[i]), 0)), np.empty((len(x[i]), 0), ids.dtype)
            for j in _tiles(len(m)):                        # in the order of the ids, so that earlier ones win ties
                top = np.concatenate([top, _scores((x[i], nx[i]), (y[j], ny[j]))], axis=1)
                mid = np.concatenate([mid, np.broadcast_to(ids[j], (len(mid), len(ids[j])))], axis=1)
                take = np.argsort(-top, axis=1, kind="stable")[:, :k]
                top, mid = np.take_along_axis(top, take, 1), np.take_along_axis(mid, take, 1)
            out.append(pd.DataFrame({"qid": np.repeat(q[key].to_numpy()[i], top.shape[1]), "mid": mid.ravel(), "score": top.ravel(), "s4": _bins(top.ravel())}))
        return pd.concat(out)
    part = _grid(queries, memory, key, vec, [], block).applyInPandas(best, "qid long, mid long, score double, s4 long")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "mid")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cosine_pairs(vectors: DataFrame, key: str, vec: str, floor: float, block: int = 2048) -> DataFrame:
    """Unordered pairs with cosine >= ``floor``: a, b, s4."""

    def pairs(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        q, m = q.sort_values(key), m.sort_values(key)
        out = [pd.DataFrame({"a": [], "b": [], "s4": []}, dtype=np.int64)]
        for i, j, s, keep in _pair_tiles(q, m, key, vec):
            u, v = np.nonzero((s >= floor) & keep)
            a, b = q[key].to_numpy()[i][u], m[key].to_numpy()[j][v]
            out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "s4": _bins(s[u, v])}))
        return pd.concat(out)
    return _half_grid(vectors, key, vec, [], block).applyInPandas(pairs, "a long, b long, s4 long")


def cosine_histogram(vectors: DataFrame, key: str, vec: str, label: str, block: int = 2048) -> DataFrame:
    """Counts of unordered pairs per score and whether their labels match: s4, match, n.

    Pairs are counted inside each block pair, so what is shuffled is bounded by the
    number of score bins, not by the number of pairs. The counts are written: what reads them twice must not look at the pairs again.
    """
    def hist(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        q, m, n = q.sort_values(key), m.sort_values(key), np.zeros(2 * SCALE + 2, np.int64)
        la, lb = q[label].to_numpy(), m[label].to_numpy()
        for i, j, s, keep in _pair_tiles(q, m, key, vec):
            code = _bins(s) * 2 + (la[i][:, None] == lb[j][None, :])
            n += np.bincount((code if keep is np.True_ else code[keep]).ravel(), minlength=len(n))
        code = np.nonzero(n)[0]
        return pd.DataFrame({"s4": code // 2, "match": code % 2 == 1, "n": n[code]})
    part = _half_grid(vectors, key, vec, [label], block).applyInPandas(hist, "s4 long, match boolean, n long")
    return materialise(part.groupBy("s4", "match").agg(F.sum("n").alias("n")))


# -- statistics over a score histogram ---------------------------------------------------
def index_quantiles(hist: DataFrame, by: str, qs: dict[str, float], scale: int = SCALE) -> DataFrame:
    """``sorted[min(n - 1, int(q n))]`` per group, read off the running counts of the bins."""
    x = hist.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy("s4").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    pos = lambda q: F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total")))
    return x.groupBy(by).agg(F.max("total").alias("n_pairs"),
                             *[(F.min(F.when(F.col("upto") > pos(q), F.col("s4"))) / scale).alias(name) for name, q in qs.items()])


def threshold_curve(hist: DataFrame, step_bins: int = 500, scale: int = SCALE) -> DataFrame:
    """theta, n, n_match at every grid step: bins are multiplied by the grid, pairs are not."""
    steps = F.array(*[F.lit(i) for i in range(0, scale, step_bins)])
    grid = hist.groupBy("s4").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("match"), F.col("n")).otherwise(0)).alias("m")).select("*", F.explode(steps).alias("t4")).filter("s4 >= t4")
    return grid.groupBy("t4").agg(F.sum("n").alias("n"), F.sum("m").alias("n_match")).select((F.col("t4") / scale).alias("theta"), "n", "n_match")


def calibrate(hist: DataFrame, target: float = 0.5, step: float = 0.05, scale: int = SCALE) -> DataFrame:
    """Lowest grid threshold whose precision reaches ``target``; else the 90th-percentile
    non-matching score rounded to the grid. One row: tau, rule, n_pairs, n_match."""
    curve = threshold_curve(hist, int(step * scale), scale)
    first = curve.agg(F.min(F.when(F.col("n_match") >= target * F.col("n"), F.col("theta"))).alias("t1"))
    neg = index_quantiles(hist.filter("not match").select(F.lit(0).alias("g"), "s4", "n"), "g", {"q90": 0.9}, scale).agg(F.max("q90").alias("q90"))
    total = hist.agg(F.sum("n").alias("n_pairs"), F.sum(F.when(F.col("match"), F.col("n")).otherwise(0)).alias("n_match"))
    # grid rounding is half-to-even, as in the published rule
    return (total.select("*", first.scalar().alias("t1"), neg.scalar().alias("q90"))
            .select(F.coalesce("t1", F.round(F.bround(F.col("q90") / step) * step, 2)).alias("tau"),
                    F.when(F.col("t1").isNotNull(), "precision").otherwise("negative_p90").alias("rule"), "n_pairs", "n_match"))
