"""Token ids in grammar-compressed shards (Re-Pair).

Documents are brought into ascending order of id, encoded, and written in shards of about ``shard_tokens`` ids (whole documents). In a
shard, frequent pairs of neighbouring symbols are replaced by nonterminals, round after round. A round estimates
the frequency of every pair with hashed counters; a position is replaced when its pair is more frequent than the overlapping pairs at
both sides, every other one where such pairs are equally frequent (so replacements never overlap and the most frequent pair of a neighbourhood wins), and a pair that
is chosen at ``least`` places or more becomes a rule. Rounds end when no pair is left or after ``rounds``.

File format: Parquet, one row per shard: ``part, no`` (place in the global order), ``base`` (first nonterminal), ``n_tokens``,
``doc_ids``, ``doc_tokens`` (ids of each document), ``left, right`` (32-bit symbols of rule ``base + i``), ``lengths`` (expansion length of
each rule) and ``seq`` (32-bit symbols). The expansion lengths give random access: :func:`decode_range` finds the
symbols that cover a range of ids from running lengths and expands only those.

Defined results: NULL text is empty (a document of the end id alone); NULL ids come first; rows of one id are ordered by the hash
of their text and repeated rows are written each for itself; other columns are ignored; an empty table writes no shard.
"""
from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_dir
from .automaton import byte_letters
from .common import MEMO_LIMIT, Memo, batch, materialise, slices

# White space for Python alone; what is beyond Latin letters with one lower case of one letter; the splitting rule.
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
FAR = re.compile("[^\x00-\u012f\u0131-\u017f]")
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")

BROADCAST_SHARDS = 200_000           # rows of two integers and a long
SHARD = ("part int, no int, base int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
         "left binary, right binary, lengths binary, seq binary")


class Encoder:
    """The tokenizers library's ids, with memos for chunks between white space and for the words in them.

    For a tokenizer that lower-cases, drops white space and has one splitting rule, a text of Latin letters is lower-cased, cut at
    white space and split here, and the library's model encodes each new word once. Any other text (further
    scripts, odd blanks, added tokens) and any other tokenizer goes to the library whole."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"                # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        rules = json.loads(spec)
        self.added = [t["content"] for t in rules.get("added_tokens", [])]
        pre = json.dumps(rules.get("pre_tokenizer"))
        self.known = '"Lowercase"' in json.dumps(rules.get("normalizer")) and "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pre and '"ByteLevel"' in pre
        self.letter = {b: c for b, c in enumerate(byte_letters())}
        self.chunks = Memo(self._chunk, 2 * MEMO_LIMIT)                # its entries are half as large as others'
        self.model = self.library.model

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.letter)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) == 1 or chunk.isalpha():
            return self._word(chunk)
        chunks = self.chunks
        if chunk[:-1].isalpha():                                      # a word with one mark or digit behind it
            return chunks[chunk[:-1]] + chunks[chunk[-1]]
        words = PIECES.findall(chunk)
        if len(words) == 1:
            return self._word(words[0])
        return b"".join([chunks[w] for w in words])

    def near(self, text: str) -> bool:
        if not self.known or any(a in text for a in self.added) or any(b in text for b in ODD_BLANKS):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return FAR.search(text) is None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not self.near(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.lower().split()])


@lru_cache(1)
def encoder_of(spec: str) -> Encoder:
    return Encoder(spec)


def compress(ids: np.ndarray, base: int, rounds: int | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, lengths, seq) of a sequence of ids below ``base``."""
    seq = ids.astype(np.uint32)
    lefts, rights = [], []
    made, live = base, None
    length_of = np.ones(0, np.int64)
    while len(seq) > 1 and rounds != 0:
        rounds = rounds and rounds - 1
        # a pair of old symbols only becomes rarer: once below ``least`` it is looked at no more, until a new symbol touches it
        if live is None:
            live, (first, second) = np.arange(len(seq) - 1), (seq[:-1], seq[1:])
        else:
            first, second = seq[live], seq[live + 1]
        if not len(live):
            break
        bits = max(12, len(live).bit_length() - 1)
        h = (first * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
        h = (h >> np.uint32(32 - bits)).astype(np.int64)
        f = np.bincount(h, minlength=1 << bits).astype(np.int32)[h]
        often = np.nonzero(f >= least)[0]
        live, f = live[often], f[often]
        at = _places(live, f)
        rule, use, which = _rules((seq[at].astype(np.int64) << 32) | seq[at + 1], least)
        if not len(rule):
            break
        at, symbol = at[use], which + made
        left, right = rule >> 32, rule & 0xFFFFFFFF
        seq[at] = symbol
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        mark = np.zeros(len(seq), bool)
        mark[live] = True
        mark[at] = True
        keep = np.nonzero(keep)[0]
        mark = mark[keep]
        new = at - np.arange(len(at))                       # a symbol goes behind each replaced one before
        mark[np.maximum(new - 1, 0)] = True
        seq = seq[keep]
        live = np.nonzero(mark[:-1])[0]
        part = [np.where(s < base, 1, length_of[np.maximum(s - base, 0)] if len(length_of) else 1) for s in (left, right)]
        length_of = np.concatenate([length_of, part[0] + part[1]])
        lefts.append(left)
        rights.append(right)
        made += len(left)
    cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)          # noqa: E731
    return cat(lefts).astype("<u4"), cat(rights).astype("<u4"), length_of.astype("<u4"), seq.astype("<u4")


def _places(live: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Where a pair is replaced, given the ascending places of frequent pairs and their frequencies: places more frequent than both
    neighbours, and every other place of a run of equal ones between less frequent neighbours (a place not in ``live`` is less frequent)."""
    apart = np.diff(live) != 1
    up, down = (f[1:] > f[:-1]) | apart, (f[1:] < f[:-1]) | apart
    win = np.ones(len(live), bool)
    win[1:] &= up
    win[:-1] &= down
    tie = np.nonzero(~(up | down))[0]                                             # next to each other and equally frequent
    if not len(tie):
        return live[np.nonzero(win)[0]]
    new = np.concatenate([[True], np.diff(tie) > 1])
    first, last = tie[new], tie[np.append(np.nonzero(new)[0][1:] - 1, len(tie) - 1)] + 1
    ok = ((first == 0) | up[np.maximum(first - 1, 0)]) & ((last == len(live) - 1) | down[np.minimum(last, len(down) - 1)])
    first, n = first[ok], (last[ok] - first[ok]) // 2 + 1
    win[np.repeat(first, n) + 2 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))] = True
    return live[np.nonzero(win)[0]]


def _rules(pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur at ``least`` places or more, ascending; the places where one of them is; its number at each of these.

    Equal pairs fall into one slot of a hash table, so what is in a slot of fewer places is rare. A slot's last pair owns it; only pairs
    that do not own their slot are sorted place by place."""
    bits = len(pair).bit_length() + 1
    slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    use = np.nonzero(np.bincount(slot)[slot] >= least)[0]
    pair, slot = pair[use], slot[use]
    owner = np.full(1 << bits, -1, np.int64)
    owner[slot] = pair
    lost = np.nonzero(owner[slot] != pair)[0]
    used = np.nonzero(owner >= 0)[0]
    rest, which_rest = np.unique(pair[lost], return_inverse=True)
    rule = np.concatenate([owner[used], rest])
    owner[used] = np.arange(len(used))                                            # from here on the number of the slot's pair
    which = owner[slot]
    which[lost] = len(used) + which_rest
    good = np.nonzero(np.bincount(which, minlength=len(rule)) >= least)[0]
    good = good[np.argsort(rule[good])]
    place = np.full(len(rule), -1, np.int64)
    place[good] = np.arange(len(good))
    which = place[which]
    some = np.nonzero(which >= 0)[0]
    return rule[good], use[some], which[some]


class Grammar:
    """Rules of a shard, with expansions laid end to end. A rule's parts are terminals or earlier rules."""

    def __init__(self, base: int, left: bytes, right: bytes, lengths: bytes) -> None:
        self.base = base
        self.left, self.right = (np.frombuffer(x, "<u4").astype(np.int64) for x in (left, right))
        self.len = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.len)])
        self.text = np.zeros(self.offset[-1], np.uint32)
        done = 0
        while done < len(self.left):                        # as many rules at a time as need only earlier ones
            limit = base + done
            later = np.nonzero((self.left[done:] >= limit) | (self.right[done:] >= limit))[0]
            to = done + (later[0] if len(later) else len(self.left) - done)
            both = np.stack([self.left[done:to], self.right[done:to]], 1).ravel()
            self.text[self.offset[done]:self.offset[to]] = self.expand(both)
            done = to

    def lengths_of(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.len):
            return np.ones(len(symbols), np.int64)
        return np.where(symbols < self.base, 1, self.len[np.maximum(symbols - self.base, 0)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths_of(symbols)
        ends = np.cumsum(n)
        if not len(ends):
            return np.empty(0, np.uint32)
        rule = symbols >= self.base
        start = np.where(rule, self.offset[np.maximum(symbols - self.base, 0)] if len(self.len) else 0, 0)
        # where each id comes from: the symbol itself, written behind the rules' expansions, or a place in them
        own = len(self.text) + np.arange(len(symbols))
        place = np.repeat(np.where(rule, start, own) - ends + n, n)
        place += np.arange(ends[-1])
        return np.concatenate([self.text, symbols.astype(np.uint32)])[place]


def decode_range(grammar: Grammar, seq: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a shard, expanding only the symbols that cover them."""
    ends = np.cumsum(grammar.lengths_of(seq))
    a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, end, side="left") + 1
    first = int(ends[a - 1]) if a else 0
    return grammar.expand(seq[a:b])[begin - first:end - first]


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shard_tokens: int = 1 << 20, rounds: int | None = None, least: int = 4) -> None:
    """Encode every text and write the shards to ``path``. ``tokenizer`` is the path of a ``tokenizer.json`` on the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())               # a vocabulary: of fixed size
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ctx = TaskContext.get()
        part, no = ctx.partitionId() if ctx else 0, 0
        coder = encoder_of(shared.value)
        base = max(coder.size, end_id + 1)
        ids, data, held = [], [], 0

        def shard():
            tokens = [len(d) // 4 for d in data]
            left, right, lengths, seq = compress(np.frombuffer(b"".join(data), "<u4"), base, rounds, least)
            one = lambda x, t: pa.array([x], t)          # noqa: E731
            return batch(part=one(part, pa.int32()), no=one(no, pa.int32()), base=one(base, pa.int32()), n_tokens=one(sum(tokens), pa.int64()),
                         doc_ids=one(ids, pa.list_(pa.int64())), doc_tokens=one(tokens, pa.list_(pa.int64())),
                         **{k: one(v.tobytes(), pa.binary()) for k, v in (("left", left), ("right", right), ("lengths", lengths), ("seq", seq))})

        for b in slices(batches):
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                coded = coder.encode(t) + end
                ids.append(d)
                data.append(coded)
                held += len(coded) // 4
                if held >= shard_tokens:
                    yield shard()
                    ids, data, held, no = [], [], 0, no + 1
        if ids:
            yield shard()

    ranged.mapInArrow(run, SHARD).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, decoded from the shards."""
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "no", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t"))                # one row a partition of the writer
    before = parts.select(F.col("part").alias("p_part"), F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p_start"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(sizes.withColumn("inner", inner).join(before, F.col("part") == F.col("p_part"))
                         .select(F.col("part").alias("s_part"), F.col("no").alias("s_no"), (F.col("p_start") + F.col("inner")).alias("start")))
    if starts.count() <= BROADCAST_SHARDS:                                     # beyond it the shards are shuffled to their starts
        starts = F.broadcast(starts)
    placed = shards.join(starts, (F.col("part") == F.col("s_part")) & (F.col("no") == F.col("s_no"))).drop("s_part", "s_no")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in ("base", "doc_ids", "doc_tokens", "left", "right", "lengths", "seq", "start")}
                g = Grammar(row["base"], row["left"], row["right"], row["lengths"])
                data = g.expand(np.frombuffer(row["seq"], "<u4").astype(np.int64)).astype("<u4").tobytes()
                n = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(data[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield batch(doc_id=pa.array(row["doc_ids"], pa.int64()), start=pa.array(row["start"] + ends - n), n_tokens=pa.array(n), ids_crc32=pa.array(crc, pa.int64()))

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, **params) -> DataFrame:
    path = scratch_dir(docs.sparkSession)
    write_shards(docs, tokenizer, path, **params)
    return read_documents(docs.sparkSession, path)
