"""Hash-chained ledgers, run identity and table differences."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.digest import set_digest
from ..functions.running import position

GENESIS = "0" * 64
SEGMENT = 256


FIELDS = ("seq", "event", "payload", "clock")


def _field(c: Column) -> Column:
    """Length-prefixed text, '-' for NULL: no two lists of fields have the same text."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def entry_hash(seq: Column, prev: Column, event: Column, payload: Column, clock: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in (seq.cast("string"), prev, event, payload, clock)]), 256)


def _link(rows: DataFrame, chain: str, segment: int) -> DataFrame:
    """Chain rows (chain, seq, event, payload, clock) inside segments of fixed length."""
    seg = F.floor(F.col("seq") / segment)
    groups = rows.groupBy(chain, seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "event", "payload", "clock"))).alias("es"))
    start = F.expr(f"named_struct('prev', '{GENESIS}', 'out', cast(array() as array<struct<seq:bigint,event:string,payload:string,clock:string,prev_hash:string,hash:string>>))")

    def step(acc: Column, e: Column) -> Column:
        prev = acc.getField("prev")
        h = entry_hash(e.getField("seq"), prev, e.getField("event"), e.getField("payload"), e.getField("clock"))
        item = F.struct(*[e.getField(f).alias(f) for f in FIELDS], prev.alias("prev_hash"), h.alias("hash"))
        return F.struct(h.alias("prev"), F.concat(acc.getField("out"), F.array(item)).alias("out"))
    return groups.select(chain, "seg", F.inline(F.aggregate("es", start, step, lambda a: a.getField("out"))))


def _clocked(entries: DataFrame) -> DataFrame:
    return entries if "clock" in entries.columns else entries.withColumn("clock", F.lit(None).cast("string"))


def build(entries: DataFrame, chain: str, order: Sequence[str], bucket: str, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(entries, heads). ``entries`` has ``chain``, event, payload, optionally a clock (text), and the order columns.

    A hash chain is sequential, so it is built in segments of fixed length; the segment heads of a chain with more than one
    segment form the entries of the next level, chained the same way, until one segment is left. Each task sees at
    most ``segment`` entries of a chain however long the chain is.
    """
    seq = position(_clocked(entries), [chain], order, bucket, "seq").withColumn("seq", F.col("seq") - 1)
    linked = _link(seq.select(chain, *FIELDS), chain, segment)
    longest = seq.groupBy(chain).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return linked, levels_above(linked, chain, segment, longest)


def levels_above(linked: DataFrame, chain: str, segment: int, longest: int) -> DataFrame:
    """The upper levels: entries of kind 'segment' with ``level`` (from 1)."""
    heads, below, level, left = None, linked, 0, -(-longest // segment)
    while left > 1 or heads is None:
        level += 1
        h = segment_heads(below, chain)
        several = h.groupBy(F.col(chain).alias("__c")).agg(F.count(F.lit(1)).alias("segs")).filter("segs > 1")
        up = h.join(several, F.col(chain).eqNullSafe(F.col("__c"))).select(
            chain, F.col("seg").alias("seq"), F.lit("segment").alias("event"), F.col("head").alias("payload"), F.lit(None).cast("string").alias("clock"))
        below = _link(up, chain, segment)
        out = below.withColumn("level", F.lit(level))
        heads = out if heads is None else heads.unionByName(out)
        left = -(-left // segment)
    return heads


def append(linked: DataFrame, heads: DataFrame, more: DataFrame, chain: str, order: Sequence[str], bucket: str, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """A ledger continued from its stored head: ``more`` comes after everything in ``linked``. Only the last, unfinished segment of
    a chain is linked again; the levels above are rebuilt from segment heads."""
    ends = linked.groupBy(F.col(chain).alias("__c")).agg((F.max("seq") + 1).alias("__n"))
    added = position(_clocked(more), [chain], order, bucket, "seq").join(ends, F.col(chain).eqNullSafe(F.col("__c")), "left")
    added = added.withColumn("seq", F.col("seq") - 1 + F.coalesce("__n", F.lit(0))).select(chain, *FIELDS)
    grown = added.groupBy(F.col(chain).alias("__c")).agg(F.floor(F.min("seq") / segment).alias("__from"))
    old = linked.join(grown, F.col(chain).eqNullSafe(F.col("__c")), "left")
    again = F.coalesce(F.col("seg") >= F.col("__from"), F.lit(False))
    tail = _link(old.filter(again).select(chain, *FIELDS).unionByName(added), chain, segment)
    whole = old.filter(~again).select(*tail.columns).unionByName(tail)
    longest = whole.agg(F.max("seq") + 1).first()[0] or 0
    return whole, levels_above(whole, chain, segment, longest)


def segment_heads(linked: DataFrame, chain: str) -> DataFrame:
    """Last hash of every segment."""
    return linked.groupBy(chain, "seg").agg(F.max_by("hash", "seq").alias("head"), F.count("*").alias("n"))


def chain_heads(linked: DataFrame, heads: DataFrame, chain: str) -> DataFrame:
    """What has to be stored elsewhere to trust a ledger: the head of each chain (last hash of its top level) and its length."""
    every = linked.select(chain, "seq", "hash", F.lit(0).alias("level")).unionByName(heads.select(chain, "seq", "hash", "level"))
    return every.groupBy(chain).agg(F.max_by("hash", F.struct("level", "seq")).alias("head"), F.max(F.when(F.col("level") == 0, F.col("seq") + 1)).alias("length"))


def verify(linked: DataFrame, heads: DataFrame, stored: DataFrame, chain: str, segment: int = SEGMENT) -> DataFrame:
    """(chain, ok, first_bad_seq) against the ``stored`` heads and lengths.

    On every level each entry's hash and its link inside the segment are recomputed, numbers must run from 0 without a gap
    and lie in their segment, and each segment head must be the payload above it, both ways. A chain that is missing, unknown
    or has another head or length than stored fails too. ``first_bad_seq`` is that of an entry of the chain where there is one
    (0 when only an upper level is wrong, the length found when the chain is too short).
    """
    every = linked.select(chain, "seg", *FIELDS, "prev_hash", "hash", F.lit(0).alias("level")).unionByName(heads.select(chain, "seg", *FIELDS, "prev_hash", "hash", "level"))
    w = Window.partitionBy(chain, "level", "seg").orderBy("seq")
    follows = F.coalesce(F.lag("seq").over(w) + 1, F.col("seg") * segment)
    bad = ((F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)) != F.col("prev_hash")) | (F.col("seq") != follows) | (F.floor(F.col("seq") / segment) != F.col("seg"))
           | (entry_hash(F.col("seq"), F.col("prev_hash"), F.col("event"), F.col("payload"), F.col("clock")) != F.col("hash")))
    at = F.when(F.col("level") == 0, F.col("seq")).otherwise(F.lit(0))
    flags = every.select(chain, at.alias("seq"), F.coalesce(bad, F.lit(True)).alias("bad"))

    got = every.groupBy(chain, "level", "seg").agg(F.max_by("hash", "seq").alias("got"), F.min(at).alias("seq"))
    tops = got.groupBy(F.col(chain).alias("__tc"), F.col("level").alias("__tl")).agg(F.count(F.lit(1)).alias("segs"))
    below = got.join(tops, F.col(chain).eqNullSafe(F.col("__tc")) & (F.col("level") == F.col("__tl"))).filter("segs > 1").select(chain, "level", "seg", "got", "seq")
    above = every.filter("level > 0").select(F.col(chain).alias("a_chain"), (F.col("level") - 1).alias("a_level"), F.col("seq").alias("a_seg"), F.col("payload").alias("want"))
    pairs = below.join(above, F.col(chain).eqNullSafe(F.col("a_chain")) & (F.col("level") == F.col("a_level")) & (F.col("seg") == F.col("a_seg")), "full_outer")
    flags = flags.unionByName(pairs.select(F.coalesce(chain, "a_chain").alias(chain), F.coalesce("seq", F.lit(0)).alias("seq"), (~F.col("want").eqNullSafe(F.col("got"))).alias("bad")))

    have = chain_heads(linked, heads, chain)
    want = stored.select(F.col(chain).alias("s_chain"), F.col("head").alias("s_head"), F.col("length").alias("s_length"))
    ends = have.join(want, F.col(chain).eqNullSafe(F.col("s_chain")), "full_outer")
    same = F.col("head").eqNullSafe(F.col("s_head")) & F.col("length").eqNullSafe(F.col("s_length"))
    flags = flags.unionByName(ends.select(F.coalesce(chain, "s_chain").alias(chain), F.least(F.coalesce("length", F.lit(0)), F.coalesce("s_length", F.lit(0))).alias("seq"), (~same).alias("bad")))
    return flags.groupBy(chain).agg(F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad_seq")).withColumn("ok", F.col("first_bad_seq").isNull())


def run_identity(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Are two runs the same rows? Order-free digests of both and the rows on one side only."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    mine = a.agg(set_digest(row).alias("da"), F.count("*").alias("n_a"))
    other = b.agg(F.struct(set_digest(row).alias("d"), F.count("*").alias("n")).alias("o"))
    only_a = a.select(*columns).exceptAll(b.select(*columns)).agg(F.count("*").alias("c"))
    only_b = b.select(*columns).exceptAll(a.select(*columns)).agg(F.count("*").alias("c"))
    x = mine.select("da", "n_a", other.scalar().alias("o"), only_a.scalar().alias("only_a"), only_b.scalar().alias("only_b"))
    return x.select("n_a", F.col("o.n").alias("n_b"), "only_a", "only_b", (F.col("da") == F.col("o.d")).alias("same_digest"))


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Null-safe difference of two tables by key: keys, column, a, b (text). A row on one side
    only is reported once, as column '(row)'."""
    cols = [c for c in a.columns if c not in keys and c not in ignore]
    x = a.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in cols]).join(
        b.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in cols]), list(keys), "full_outer")
    one_sided = F.col("__a").isNull() | F.col("__b").isNull()
    cells = [F.when(~one_sided & ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")),
                    F.struct(F.lit(c).alias("column"), F.col(f"__a_{c}").cast("string").alias("a"), F.col(f"__b_{c}").cast("string").alias("b"))) for c in cols]
    row = F.when(one_sided, F.struct(F.lit("(row)").alias("column"), F.when(F.col("__a"), "present").alias("a"), F.when(F.col("__b"), "present").alias("b")))
    return x.select(*keys, F.inline(F.array_compact(F.array(row, *cells))))
