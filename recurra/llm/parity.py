"""Near-duplicate documents by a parity-sketch join on word shingles.

A document is its set of distinct shingles. Every shingle flips one bit of a sketch, so two sketches differ in at most as
many bits as the sets differ in elements: the Hamming distance is a lower bound of the symmetric difference. Sets of sizes a and b with
Jaccard similarity t or more differ in at most ``D = (a + b) (1 - t) / (1 + t)`` elements.

Join. Sizes fall into bands of ratio ``BAND``; a set joins in its own band and, when a set that is up to 1 / t times larger can be in the next
one, there too. In a size band with largest D the sketch is cut into D + 1 + s parts (each a very wide piece of the bit vector,
kept as the XOR of its set bits' hashes). At most D parts differ, so s + 1 agree, and the heaviest of those is not
among the s parts with the fewest shingles of either set: these are skipped, since nearly empty parts agree by chance.
Sets that share a key (band, part, value) are candidates.

Links. Identical sets are folded first. In a group of sets with one key, everyone is compared with the group's first and with
its predecessor; components of the verified links follow. What is left are pairs in different components inside groups of four or more:
they are compared block by block on narrow sketches inside a task, which reports only pairs whose Hamming distance allows a
link, never all pairs. Every reported pair that wide sketches (for long sets) allow too is verified on whole sets, and components are built again: no link is lost.

Shingles are compared by 64-bit hashes of their words (so are sets): a false match has a chance of about 2^-64 a pair of shingles.

Defined results: documents without words or with NULL text have size 0 and are linked with nothing; fewer words than a shingle are one
shingle; repeated rows are in one component; NULL ids have no say in component ids (a component of NULL ids alone has a
NULL id); other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import batch, batches_of, materialise
from .components import components

BAND = 1.5
NARROW = 1024                     # bits of the narrow sketch at least; long sets have three quarters of a bit an element or more
LONG = 400                        # from this size on a set also has a wide sketch, of two bits an element or more
BLOCK = 512
BROADCAST_ROWS = 250_000         # ids sent to every task at most; beyond it the join is shuffled
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    table = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            cls.table = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 64), _BASE, np.uint64)]))
        return cls.table


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text in UTF-8, A-Z lower-cased, in order."""
    solid = ~_BLANK[data]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(first):
        return np.empty(0, np.uint64)
    n = last - first
    body = _BYTE[_LOWER[data[solid]]]
    begin = np.cumsum(n) - n
    body *= _Powers.upto(int(n.max()))[np.arange(len(body)) - np.repeat(begin, n)]
    return mix(np.add.reduceat(body, begin) + n.astype(np.uint64))


def shingles(data: bytes, width: int) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    w = word_hashes(np.frombuffer(data, np.uint8))
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _BASE + w[j:len(w) - k + 1 + j]
    return np.unique(mix(h))


class Plan:
    """Sizes to bands, bands to numbers of parts, for a similarity of ``per`` hundredths."""

    def __init__(self, per: int) -> None:
        self.per = per
        self.gap = Fraction(100 - per, 100 + per)
        self.starts = [1]

    def differ(self, total: int) -> int:
        """The most elements in which two linked sets of ``total`` elements together can differ."""
        return int(self.gap * total)

    def _more(self) -> None:
        self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND)))

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self._more()
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def bands(self, n: int) -> list[int]:
        """The bands a set of n elements joins in: its own, and the next where its largest partner is."""
        own, top = self.band(n), self.band(n * 100 // self.per)
        return [own] if top == own else [own, own + 1]

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, skipped) of a band."""
        while len(self.starts) < band + 2:
            self._more()
        largest = self.starts[band + 1] - 1
        d = self.differ(2 * largest)
        skip = 0 if d == 0 else 1 + (d + 1) // 12
        return d + 1 + skip, skip


def part_keys(h: np.ndarray, plan: Plan) -> np.ndarray:
    """The join keys of a set."""
    out = []
    value = mix(h ^ U(0x5851F42D4C957F2D))
    for band in plan.bands(len(h)):
        parts, skip = plan.parts(band)
        at = ((h >> U(32)) * U(parts)) >> U(32)                      # the part of the bit a shingle flips
        at = at.astype(np.int64)
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=parts)
        x = np.zeros(parts, np.uint64)
        full = np.nonzero(count)[0]
        begin = (np.cumsum(count) - count)[full]
        x[full] = np.bitwise_xor.reduceat(value[order], begin)
        keep = np.sort(np.argsort(count, kind="stable")[skip:])       # without the lightest, ties by number
        out.append(mix(x[keep] + count[keep].astype(np.uint64) * U(0xD6E8FEB86659FD93) + keep.astype(np.uint64) * _BASE + U((band + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)))
    return np.concatenate(out).view(np.int64)


def sketch(h: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the elements that fall on each of ``bits`` bits (a power of two). The halves of a sketch, XORed, are the
    sketch of half as many bits."""
    odd = np.bincount(((h >> U(7)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def narrow_bits(n: int) -> int:
    return max(NARROW, 1 << (3 * n // 4).bit_length())


def wide_bits(n: int) -> int:
    return 1 << (2 * n - 1).bit_length()


def set_id(h: np.ndarray) -> int:
    return int(mix(np.array([mix(h ^ U(0xA24BAED4963EE407)).sum(dtype=np.uint64) + U(len(h))], np.uint64)).view(np.int64)[0])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


FACTS = "doc_id long, text_key long, n long, sid long, sketch array<long>, wide array<long>, keys array<long>"


def set_facts(docs: DataFrame, width: int, per: int) -> DataFrame:
    """Per document: size, id of its set, narrow sketch, and the join keys. A task gives the keys of a set once (as
    long as it remembers it): further copies have the same keys and would only be folded later."""

    def run(batches):
        plan, known = Plan(per), set()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            ns, sids, sketches, wides, keys = [], [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                h = shingles(t or b"", width)
                ns.append(len(h))
                s = set_id(h) if len(h) else None
                sids.append(s)
                if s is None or s in known:
                    sketches.append(None)
                    wides.append(None)
                    keys.append(None)
                    continue
                if len(known) >= 100_000:
                    known.clear()
                known.add(s)
                sketches.append(sketch(h, narrow_bits(len(h))))
                wides.append(sketch(h, wide_bits(len(h))) if len(h) >= LONG else None)
                keys.append(part_keys(h, plan))
            return batch(doc_id=b.column("doc_id"), text_key=b.column("text_key"), n=pa.array(ns, pa.int64()), sid=pa.array(sids, pa.int64()),
                         sketch=pa.array(sketches, pa.list_(pa.int64())), wide=pa.array(wides, pa.list_(pa.int64())), keys=pa.array(keys, pa.list_(pa.int64())))
        return batches_of(one)(batches)

    return _texts(docs).mapInArrow(run, FACTS)


def shared_keys(facts: DataFrame) -> DataFrame:
    """key, sid: keys that two or more sets have, each pair once. Rows come sorted by key; single ones are dropped as they pass."""
    rows = facts.filter(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "sid").repartition("key").sortWithinPartitions("key", "sid")

    def run(batches):
        keys, sids = np.empty(0, np.int64), np.empty(0, np.int64)          # rows whose key may go on in the next batch
        for b in batches:
            k = np.concatenate([keys, b.column("key").to_numpy(zero_copy_only=False)])
            s = np.concatenate([sids, b.column("sid").to_numpy(zero_copy_only=False)])
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            k, s = k[new], s[new]
            # of the last key keep two rows at most: enough to know that it is shared; the others leave
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if len(k) - cut > 2:
                cut = len(k) - 2
            out = _shared(k, s, cut)
            keys, sids = k[cut:], s[cut:]
            if len(out[0]):
                yield batch(key=pa.array(out[0]), sid=pa.array(out[1]))
        out = _shared(keys, sids, len(keys))
        if len(out[0]):
            yield batch(key=pa.array(out[0]), sid=pa.array(out[1]))

    return rows.mapInArrow(run, "key long, sid long")


def _shared(k: np.ndarray, s: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``upto`` rows that have a neighbour with their key."""
    same = k[1:] == k[:-1]
    near = np.zeros(len(k), bool)
    near[1:] |= same
    near[:-1] |= same
    near[upto:] = False
    return k[near], s[near]


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _folded(x: Column) -> Column:
    half = F.floor(F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def possible(pairs: DataFrame, sets: DataFrame, per: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out: narrow sketches first, wide ones for long sets that pass. Sizes
    are so near that two sketches have as many bits or one twice as many; then that one is folded once."""
    def sides(rows: DataFrame, what: str) -> DataFrame:
        side = lambda p: sets.select(F.col("sid").alias(f"{p}_sid"), F.col("n").alias(f"{p}_n"), F.col(what).alias(f"{p}_s"))          # noqa: E731
        return rows.join(side("a"), F.col("a") == F.col("a_sid")).join(side("b"), F.col("b") == F.col("b_sid"))

    def allowed(a: Column, b: Column) -> Column:
        a, b = F.when(F.size(a) > F.size(b), _folded(a)).otherwise(a), F.when(F.size(b) > F.size(a), _folded(b)).otherwise(b)
        return hamming(a, b) * (100 + per) <= (F.col("a_n") + F.col("b_n")) * (100 - per)

    a, b = F.col("a_s"), F.col("b_s")
    near = 100 * F.least("a_n", "b_n") >= per * F.greatest("a_n", "b_n")
    first = materialise(sides(pairs, "sketch").filter(near & allowed(a, b)).select("a", "b", (F.least("a_n", "b_n") >= LONG).alias("long")))
    long = sides(first.filter("long").select("a", "b"), "wide")
    return first.filter("NOT long").select("a", "b").unionByName(long.filter(allowed(a, b)).select("a", "b"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, per: int) -> DataFrame:
    """The pairs whose whole sets are similar: 100 x intersection >= per x union."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("w_sid")).distinct()
    ids = materialise(sets.join(need, F.col("sid") == F.col("w_sid"), "left_semi").select(F.col("first_id").alias("w_id"), F.col("no_id").alias("w_no")))
    few = ids.count() <= BROADCAST_ROWS
    ids = ids.distinct()
    rows = _texts(docs).join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")

    def run(batches):
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            hs = [shingles(t or b"", width) for t in b.column("text").cast(pa.binary()).to_pylist()]
            hs = [h for h in hs if len(h)]
            return batch(sid=pa.array([set_id(h) for h in hs], pa.int64()), h=pa.array([h.tobytes() for h in hs], pa.binary()))
        return batches_of(one)(batches)

    whole = materialise(rows.mapInArrow(run, "sid long, h binary").groupBy("sid").agg(F.any_value("h").alias("h")))
    side = lambda p: whole.select(F.col("sid").alias(f"{p}_sid"), F.col("h").alias(f"{p}_h"))          # noqa: E731
    both = pairs.join(side("a"), F.col("a") == F.col("a_sid")).join(side("b"), F.col("b") == F.col("b_sid")).select("a", "b", "a_h", "b_h")

    def compare(batches):
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(b.column("a_h"), b.column("b_h")):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * inter >= per * (len(x) + len(y) - inter))
            return pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        return batches_of(one)(batches)

    return both.mapInArrow(compare, "a long, b long")


def remaining(shared: DataFrame, comp: DataFrame, sets: DataFrame, per: int) -> DataFrame:
    """Pairs a, b of different components in groups of four or more whose narrow sketches allow a link. A group is cut into
    blocks; a task sees two blocks at a time and reports only what passes."""
    c = comp.select(F.col("node").alias("c_node"), "root")
    rows = shared.join(c, F.col("sid") == F.col("c_node"), "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    rows = materialise(rows)
    mixed = rows.groupBy(F.col("key").alias("m_key")).agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r1"), F.max("root").alias("r2")).filter("size > 3 AND r1 <> r2").select("m_key")
    open_rows = rows.join(mixed, F.col("key") == F.col("m_key"), "left_semi")
    placed = open_rows.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("key").orderBy("sid")) - 1) / BLOCK))
    facts = sets.select(F.col("sid").alias("f_sid"), "n", "sketch")
    full = placed.join(facts, F.col("sid") == F.col("f_sid"))
    blocks = materialise(full.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("sid", "root", "n", "sketch"))).alias("rows")))       # at most BLOCK
    other = blocks.select(F.col("key").alias("o_key"), F.col("block").alias("o_block"), F.col("rows").alias("o_rows"))
    two = blocks.join(other, (F.col("key") == F.col("o_key")) & (F.col("block") <= F.col("o_block"))).select("rows", "o_rows", (F.col("block") == F.col("o_block")).alias("same"))

    def unpack(group: pa.StructArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        sid, root, n, sketches = group.flatten()
        words, ends = sketches.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(sketches.value_lengths().to_numpy(zero_copy_only=False))
        return [x.to_numpy(zero_copy_only=False) for x in (sid, root, n)], np.split(words, ends[:-1])

    def fold_to(sketches: list[np.ndarray], words: int) -> np.ndarray:
        out = []
        for x in sketches:
            while len(x) > words:
                x = x[:len(x) // 2] ^ x[len(x) // 2:]
            out.append(x)
        return np.stack(out)

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                ((sa, ra, na), ha), ((sb, rb, nb), hb) = (unpack(b.column(x)[i].values) for x in ("rows", "o_rows"))
                words = min(map(len, ha + hb))
                ha, hb = fold_to(ha, words), fold_to(hb, words)
                ham = np.zeros((len(sa), len(sb)), np.int64)
                for j in range(words):
                    ham += np.bitwise_count(ha[:, j][:, None] ^ hb[:, j][None, :])
                ok = (ra[:, None] != rb[None, :]) & (ham * (100 + per) <= (na[:, None] + nb[None, :]) * (100 - per))
                ok &= 100 * np.minimum(na[:, None], nb[None, :]) >= per * np.maximum(na[:, None], nb[None, :])
                if b.column("same")[i].as_py():
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                out.append((np.minimum(sa[x], sb[y]), np.maximum(sa[x], sb[y])))
            if out:
                a, z = (np.concatenate(v) for v in zip(*out))
                yield batch(a=pa.array(a), b=pa.array(z))

    return two.mapInArrow(run, "a long, b long").distinct()


def _groups(docs: DataFrame, width: int, per: int) -> tuple[DataFrame, DataFrame]:
    """(facts of the documents, sid -> root and smallest id of its component)."""
    facts = materialise(set_facts(docs, width, per))
    sets = materialise(facts.filter(F.col("sid").isNotNull()).groupBy("sid").agg(
        F.min("doc_id").alias("first_id"), F.bool_and(F.col("doc_id").isNull()).alias("no_id"), F.any_value("n").alias("n"), F.any_value("sketch", F.lit(True)).alias("sketch"), F.any_value("wide", F.lit(True)).alias("wide")))
    shared = materialise(shared_keys(facts))
    by_key = Window.partitionBy("key").orderBy("sid")
    pairs = (shared.select("sid", F.first("sid").over(by_key).alias("first"), F.lag("sid").over(by_key).alias("before"))
             .select(F.explode(F.array("first", "before")).alias("a"), F.col("sid").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    links = materialise(verified(materialise(possible(pairs, sets, per)), docs, sets, width, per))
    comp = materialise(components(links))
    # an eighth of the keys first: sets that share one key mostly share several, and what is joined by then is not compared again
    share = F.pmod(F.xxhash64("key"), F.lit(8))
    for keys in (shared.filter(share == 0), shared.filter(share != 0)):
        more = materialise(possible(materialise(remaining(keys, comp, sets, per)), sets, per))
        if more.limit(1).count():
            links = materialise(links.union(verified(more, docs, sets, width, per)))
            comp = materialise(components(links))
    of_set = sets.join(comp, F.col("sid") == F.col("node"), "left").select("sid", "first_id", F.coalesce("root", "sid").alias("root"))
    ids = of_set.groupBy(F.col("root").alias("g_root")).agg(F.min("first_id").alias("component_id"))
    return facts, of_set.join(ids, F.col("root") == F.col("g_root")).select(F.col("sid").alias("s_sid"), "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, per: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, root: one row per document. ``text_key`` tells rows of one id apart;
    ``root`` names the component (NULL for documents without words)."""
    facts, groups = _groups(docs, width, per)
    plain = facts.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "sid")
    return (plain.join(groups, F.col("sid") == F.col("s_sid"), "left")
            .select("doc_id", "text_key", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root"))


def keep_one(docs: DataFrame, width: int = 5, per: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (NULL last, then by hash of the text). Documents
    without words all stay."""
    found = materialise(near_duplicates(docs, width, per).filter(F.col("root").isNotNull()).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("who")))
    best = found.groupBy(F.col("root").alias("b_root")).agg(F.min("who").alias("best"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    inside = materialise(found.join(best, F.col("root") == F.col("b_root")).select("who", (F.col("who") == F.col("best")).alias("stays")))
    gone = materialise(inside.filter(~F.col("stays")).select("who.*").distinct())
    twice = materialise(inside.filter("stays").groupBy("who").count().filter("count > 1").select("who.*"))

    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("k_doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k_text"))

    def matching(left: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("i_doc"), F.col("text_key").alias("i_text"))
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        return left.join(ids, F.col("k_doc").eqNullSafe(F.col("i_doc")) & (F.col("k_text") == F.col("i_text")), how)

    kept = matching(rows, gone, "left_anti")
    if twice.limit(1).count():                       # repeated rows of a document that stays: one of them
        kept = matching(kept, twice, "left_anti").unionByName(matching(kept, twice, "left_semi").dropDuplicates(["k_doc", "k_text"]))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
