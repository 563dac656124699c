"""Substring dedup by recompression.

A text is a sequence of words. Rounds of recompression rename it: a round names maximal runs of one symbol, then pairs of neighbours
of which the first lies in the left and the second in the right half of all symbols (a bit of the name, another one each round). A name is a digest of
what it stands for, so every task of every Spark round gives equal things equal names, without a dictionary. Beside its name a
symbol carries its *reach*: the stretch of words that decided it, neighbours that were looked at included. Wherever these words
occur, this symbol occurs: equal substrings have the same interior symbols.

1. Reveal. Each window of ``window`` words is represented by one symbol whose reach lies inside it: of the highest level that has
   one, the one with the smallest digest. Equal windows choose equal symbols. Windows that follow each other mostly choose the same
   one, so few (symbol, document) rows are counted (a row is a symbol with the digest of its reach). Symbols of one document only are out.
2. The shared symbols go into a Bloom filter (12 bits a symbol, 32 MB at most: beyond that more windows pass, none is lost).
3. Verify. The rounds run again; windows whose symbol passes get the name of all their words (128 bits, built by naming pairs of
   halves). Windows in a row with one symbol are a run, named from them. For every run the smallest doc_id is found: in later documents it is a repeat as a whole. In
   the documents that have a run first, its windows are compared one by one with those of other runs of the same symbol.
4. Repeats go back to their documents as spans of words and are cut out.

Counts are pre-aggregated; runs and windows meet the smallest doc_id of their name in a join in which hot names are spread (``common.hot_join``).
Texts are only read; what is joined to them is a list of spans a document, by broadcast up to a checked size.

Defined results: a NULL text counts as empty; texts shorter than a window keep everything; rows with a NULL doc_id keep everything and
nothing is removed because of them; rows with the same doc_id are one document to others: none is repeated because of
the other; an empty table gives no rows. Very long texts are parsed in pieces that overlap by a window.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import hot_join, materialise, slices, utf8

U = np.uint64
PIECE = 1 << 17                       # words parsed at once
BLOOM_MOST = 1 << 28                  # bits
PROBES = 4
BROADCAST_MOST = 4 << 20              # integers in the spans of all documents


def mix(a: np.ndarray, b: np.ndarray | np.uint64, salt: int) -> np.ndarray:
    """A 64-bit digest of two names."""
    with np.errstate(over="ignore"):
        x = a * U(0x9E3779B97F4A7C15) + (b ^ U(salt)) * U(0xC2B2AE3D27D4EB4F)
        x ^= x >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        return x ^ (x >> U(32))


def word_names(words: list[bytes]) -> np.ndarray:
    """(words, 2): 128-bit names of words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), U).reshape(-1, 2)


def levels(names: np.ndarray, stop: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, first and last + 1 of the reach) of the symbols of each level; ``stop`` marks separators, which never join anything."""
    s = names.copy()
    a = np.arange(len(s), dtype=np.int32)
    b = a + np.int32(1)
    out = [(s[~stop], a[~stop], b[~stop])]
    for r in range(rounds):
        # runs: their neighbours decide where they end
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | stop[1:] | stop[:-1]
        at = np.nonzero(first)[0]
        n = np.diff(np.append(at, len(s)))
        last = at + n - 1
        inner = ~stop[at]
        s, a, b, stop = (np.where(n > 1, mix(s[at], n.astype(U), 2 * r + 1), s[at]), np.where(inner, a[np.maximum(at - 1, 0)], a[at]),
                         np.where(inner, b[np.minimum(last + 1, len(s) - 1)], b[last]), stop[at])
        # pairs: a left symbol never joins its left neighbour, a right symbol never its right one, so neither looks there
        right = (mix(s, U(r), 101) >> U(63)).astype(bool)
        head = np.nonzero(~right[:-1] & right[1:] & ~stop[:-1] & ~stop[1:])[0]
        tail = np.zeros(len(s), bool)
        tail[head + 1] = True
        alone = ~stop & ~tail
        alone[head] = False
        na, nb, ns = a.copy(), b.copy(), s.copy()
        i = np.nonzero(alone & right)[0]
        na[i] = a[np.maximum(i - 1, 0)]
        i = np.nonzero(alone & ~right)[0]
        nb[i] = b[np.minimum(i + 1, len(s) - 1)]
        nb[head] = b[head + 1]
        ns[head] = mix(s[head], s[head + 1], 2 * r + 2)
        s, a, b, stop = ns[~tail], na[~tail], nb[~tail], stop[~tail]
        out.append((s[~stop], a[~stop], b[~stop]))
    return out


def representatives(names: np.ndarray, stop: np.ndarray, starts: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (at ``starts``) a number that tells chosen symbols apart, and the digest of the chosen symbol and its reach."""
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(names), U(0x9E3779B97F4A7C15))]))
        back = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(names), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))]))
        total = np.concatenate([[U(0)], np.cumsum(names * power[:-1], dtype=U)])
    chosen = np.empty(len(starts), np.int64)
    key = np.empty(len(starts), U)
    todo, base = np.arange(len(starts)), 0
    for no, (s, a, b) in reversed(list(enumerate(levels(names, stop, rounds)))):
        fits = b - a <= window
        s, a, b = s[fits], a[fits], b[fits]
        if not len(todo) or not len(s):
            continue
        before = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))])         # reaches that begin before a position
        until = np.cumsum(np.bincount(b, minlength=len(names) + 1))                             # reaches that end at it at the latest
        low, high = before[starts[todo]], until[starts[todo] + window]
        has = high > low
        low, high = low[has], high[has]
        if len(low):
            with np.errstate(over="ignore"):
                whole = mix((total[b] - total[a]) * back[a], s, no)
            least = _range_least(whole, low, high)
            chosen[todo[has]] = least + base
            key[todo[has]] = whole[least]
        todo, base = todo[~has], base + len(s)
    return chosen, key


def _range_least(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the smallest value in x[low:high] for every pair, from tables of ranges of doubled length."""
    steps = np.frexp((high - low).astype(np.float64))[1] - 1
    best = np.empty(len(low), np.int64)
    t, size = np.arange(len(x)), 1
    for k in range(int(steps.max()) + 1):
        sel = np.nonzero(steps == k)[0]
        if len(sel):
            p, q = t[low[sel]], t[high[sel] - size]
            best[sel] = np.where(x[p] <= x[q], p, q)
        if len(t) > size:
            p, q = t[:-size], t[size:]
            t = np.where(x[p] <= x[q], p, q)
        size *= 2
    return best


def window_names(names: np.ndarray, window: int) -> np.ndarray:
    """(position, 2): names of all stretches of ``window`` words, by pairs of stretches of doubled length."""
    lanes, size = [names[:, 0], names[:, 1]], 1
    while size * 2 <= window:
        lanes = [mix(x[:-size], x[size:], 7 * size + j) for j, x in enumerate(lanes)]
        size *= 2
    if size < window:
        lanes = [mix(x[:len(x) - window + size], x[window - size:], 7 * window + 3 + j) for j, x in enumerate(lanes)]
    return np.stack(lanes, axis=1)


def _pieces(texts: list[str | None], window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, place of the first word, names of the words: texts, long ones in pieces that overlap by a window less a word."""
    for row, text in enumerate(texts):
        words = utf8(text or "").split()                     # bytes split at exactly these blanks
        for at in range(0, max(0, len(words) - window + 1), PIECE):
            part = words[at:at + PIECE + window - 1]
            yield row, at, word_names(part)


def _parsed(texts: list[str | None], window: int, rounds: int):
    """Groups of pieces: (rows and places of the windows, chosen symbol, digest, names, starts)."""
    held, size = [], 0
    for piece in _pieces(texts, window):
        held.append(piece)
        size += len(piece[2])
        if size >= PIECE:
            yield _parse(held, window, rounds)
            held, size = [], 0
    if held:
        yield _parse(held, window, rounds)


def _parse(pieces, window: int, rounds: int):
    blank = np.zeros((1, 2), U)
    names = np.concatenate([blank, *[x for _, _, p in pieces for x in (p, blank)]])
    count = np.array([len(p) for _, _, p in pieces])
    begin = 1 + np.concatenate([[0], np.cumsum(count + 1)[:-1]])
    stop = np.zeros(len(names), bool)
    stop[0] = True
    stop[begin + count] = True
    n = count - window + 1
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(begin, n) + offset
    rows = np.repeat([r for r, _, _ in pieces], n)
    places = np.repeat([at for _, at, _ in pieces], n) + offset
    chosen, key = representatives(names[:, 0], stop, starts, window, rounds)
    return rows, places, chosen, key, names, starts


def _symbols(window: int, rounds: int):
    def run(batches):
        for b in slices(batches):
            ids = b.column("doc_id")
            for rows, places, chosen, key, _, _ in _parsed(b.column("text").to_pylist(), window, rounds):
                new = np.ones(len(rows), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])
                at = np.unique(np.stack([rows[new].astype(U), key[new]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at[1].view(np.int64)), ids.take(pa.array(at[0].astype(np.int64)))], ["key", "doc_id"])
    return run


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    one, two = mix(keys, U(1), 11), mix(keys, U(2), 12) | U(1)
    with np.errstate(over="ignore"):
        return [(one + U(i) * two) & U(bits - 1) for i in range(PROBES)]


def _bloom(shared: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the symbols; its words are combined by Spark and come to the driver (a bounded number)."""
    bits = 1 << 16
    while bits < 12 * n and bits < BLOOM_MOST:
        bits *= 2

    def run(batches):
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column("key").to_numpy().view(U), bits)))
            word, first = np.unique(at >> U(6), return_index=True)
            value = np.bitwise_or.reduceat(U(1) << (at & U(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["word", "bits"])

    words = shared.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U)
    return out


def _passes(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for p in _places(keys, len(filled) * 64):
        out &= (filled[p >> U(6)] >> (p & U(63)) & U(1)).astype(bool)
    return out


def _runs(window: int, rounds: int, bloom):
    """A row for every run of windows with one representative that passes: its key, the name of the whole run, the names of its windows."""
    def run(batches):
        for b in slices(batches):
            ids, tags = b.column("doc_id"), b.column("tag")
            for rows, places, chosen, key, names, starts in _parsed(b.column("text").to_pylist(), window, rounds):
                new = np.ones(len(rows), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])
                first = np.nonzero(new)[0]
                n = np.diff(np.append(first, len(rows)))
                use = _passes(bloom.value, key[first])
                first, n = first[use], n[use]
                if not len(first):
                    continue
                ends = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(first - ends[:-1], n) + np.arange(ends[-1])
                w = window_names(names, window)[starts[at]]
                with np.errstate(over="ignore"):
                    power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(int(n.max()), U(0x9E3779B97F4A7C15))]))
                    terms = w * power[np.arange(ends[-1]) - np.repeat(ends[:-1], n)][:, None]
                    whole = mix(np.add.reduceat(terms, ends[:-1], axis=0), n.astype(U)[:, None], 21).view(np.int64)
                w = w.view(np.int64)
                offsets, row = pa.array(ends.astype(np.int32)), pa.array(rows[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first].view(np.int64)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), ids.take(row), tags.take(row), pa.array(places[first].astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.ListArray.from_arrays(offsets, pa.array(w[:, 0])), pa.ListArray.from_arrays(offsets, pa.array(w[:, 1]))],
                    ["key", "s1", "s2", "doc_id", "tag", "place", "n", "w1", "w2"])
    return run


def _with_key(bloom):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_passes(bloom.value, b.column("key").to_numpy().view(U))))
    return run


def _merged(window: int):
    """Overlapping and touching stretches of windows as spans of words."""
    def run(batches):
        for b in batches:
            out = []
            for stretches in b.column("stretches").to_pylist():
                p = np.array([(x["first"], x["last"]) for x in stretches], np.int64)
                p = p[np.argsort(p[:, 0], kind="stable")]
                end = np.maximum.accumulate(p[:, 1] + window)
                new = np.ones(len(p), bool)
                new[1:] = p[1:, 0] > end[:-1]
                first = np.nonzero(new)[0]
                out.append(np.stack([p[first, 0], end[np.append(first[1:], len(p)) - 1]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(out, pa.list_(pa.int32()))], ["g_doc", "g_tag", "gone"])
    return run


RUN = "key long, s1 long, s2 long, doc_id long, tag int, place int, n int, w1 array<long>, w2 array<long>"


def repeated_spans(docs: DataFrame, window: int = 50, rounds: int = 4) -> DataFrame:
    """g_doc, g_tag (hash of the text), gone: [first, last + 1, first, ...] of the words that later repeats cover, for documents that have any."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.hash("text").alias("tag")).filter(F.col("doc_id").isNotNull())
    seen = text.mapInArrow(_symbols(window, rounds), "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = materialise(seen.filter("low < high").select("key"))
    found = materialise(text.mapInArrow(_runs(window, rounds, spark.sparkContext.broadcast(_bloom(shared, shared.count()))), RUN))

    # whole runs that a smaller document has, too
    runs = found.select("s1", "s2", "doc_id", "tag", "place", "n")
    spans = materialise(found.groupBy(F.col("s1").alias("o1"), F.col("s2").alias("o2")).agg(F.min("key").alias("o_key"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    met = hot_join(runs, spans.filter("low < high").select("o1", "o2", "low"), ["s1", "s2"], ["o1", "o2"], F.struct("doc_id", "place"))
    later = met.filter("doc_id > low").select("doc_id", "tag", F.col("place").alias("first"), (F.col("place") + F.col("n") - 1).alias("last"))

    # windows of runs of which only a part is elsewhere: the first documents of all runs with the same representative
    parts = materialise(spans.groupBy(F.col("o_key").alias("key")).agg(F.count(F.lit(1)).alias("spans"), F.min("low").alias("a"), F.max("low").alias("b")).filter("spans > 1 AND a < b").select("key"))
    cut = materialise(found.mapInArrow(_with_key(spark.sparkContext.broadcast(_bloom(parts, parts.count()))), RUN))
    own = hot_join(cut, spans.select("o1", "o2", "low"), ["s1", "s2"], ["o1", "o2"], F.struct("doc_id", "place")).filter("doc_id = low")
    pairs = own.select("doc_id", "tag", "place", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
    windows = materialise(pairs.select(F.col("w.w1").alias("f1"), F.col("w.w2").alias("f2"), "doc_id", "tag", (F.col("place") + F.col("i")).alias("first")))
    least = windows.groupBy(F.col("f1").alias("l1"), F.col("f2").alias("l2")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high")
    single = hot_join(windows, least, ["f1", "f2"], ["l1", "l2"], F.struct("doc_id", "first")).filter("doc_id > low").select("doc_id", "tag", "first", F.col("first").alias("last"))
    gathered = later.unionByName(single).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("stretches"))      # at most two a word of the text
    return materialise(gathered.mapInArrow(_merged(window), "g_doc long, g_tag int, gone array<int>"))


def _cut(window_words):
    def run(batches):
        for b in slices(batches):
            n, removed, kept = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                words = utf8(text or "").split()
                n.append(len(words))
                left, at = [], 0
                for first, end in zip((gone or [])[::2], (gone or [])[1::2]):
                    left += words[at:first]
                    at = end
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield window_words(b, n, removed, kept)
    return run


def dedup_substrings(docs: DataFrame, window: int = 50, rounds: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that are left, joined by blanks) and gone (spans of words) of every document."""
    return _rows(docs, window, rounds, digest=False)


def digests(docs: DataFrame, window: int = 50, rounds: int = 4) -> DataFrame:
    """As ``dedup_substrings``, with kept_sha256 in the place of the text."""
    return _rows(docs, window, rounds, digest=True)


def _rows(docs: DataFrame, window: int, rounds: int, digest: bool) -> DataFrame:
    gone = repeated_spans(docs, window, rounds)
    size = gone.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("gone")).alias("ends")).first()
    if size["rows"] * 8 + (size["ends"] or 0) <= BROADCAST_MOST:             # beyond it the texts are shuffled to the spans
        gone = F.broadcast(gone)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("tag"))
    both = text.join(gone, (F.col("doc_id") == F.col("g_doc")) & (F.col("tag") == F.col("g_tag")), "left").select("doc_id", "text", "gone")
    name = "kept_sha256" if digest else "kept"

    def rows(b, n, removed, kept):
        if digest:
            kept = [hashlib.sha256(utf8(k)).hexdigest() for k in kept]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), b.column("gone")],
                                          ["doc_id", "n_words", "n_removed", name, "gone"])
    return both.mapInArrow(_cut(rows), f"doc_id long, n_words long, n_removed long, {name} string, gone array<int>")
