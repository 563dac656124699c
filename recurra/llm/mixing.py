"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words. The sources, in order of code points with NULL last, have weights that repeat, and share
``share`` times all words; a target stops at ``cap`` times its source's words and the excess is shared again by weight. The mix is
made of blocks of about ``block`` words. Seats (blocks) go to sources by the highest quotients ``target / (2 s + 1)``, then a
source's seats go to its shards by the shards' words in the same way, which gives every shard an integer quota. Inside a
shard the documents lie end to end in seeded order and are cut into blocks of equal length; the quota takes every
block ``quota div blocks`` times and, by a seeded permutation of the block numbers, some of them once more.

Shards are cut by hash into about ``shard_docs`` documents, so a source that holds a third of all rows is many small cells. Each
source is cut by the number of its own documents that have words (those without lie in cells of their own), so a cell is not shorter
than a block unless its whole source is. A source's seats are words then: they become blocks of the length that its cells really
have, a cell takes at most ``cap`` times its blocks, and what is above goes to the next quotients.

The highest quotients are found without listing them: the threshold quotient is bracketed by counting seats at ``POINTS`` values at
a time, then only the quotients inside the last bracket are ranked.

Defined results: NULL text has size 0 and nothing is taken; a source without words has target 0; rows that agree in id, source and
text are one plan row with ``copies``, each of which is taken alike; NULL ids are ids; an empty table gives no rows.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, batches_of, materialise
from .order import running_total

_WORD = re.compile(WORD)
POINTS = 24
ROUNDS = 8
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743)      # fixed values: primes above 2^31, multipliers of the permutation


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def plan_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (of the text), size, copies."""
    text = F.col("text").cast("string")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_key(text).alias("key"), size_of(text).alias("size"))
            .groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("copies")))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Add weight and target to (source, source_size, ...). Each round fixes the sources whose share reaches their cap."""
    ranked = running_total(sources, [F.col("source").asc_nulls_last()], F.lit(1), "place")
    ranked = materialise(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).drop("part", "place"))
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    limit, level, capped = cap * F.col("source_size"), 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= limit if capped >= 0 else F.lit(False)
        now = ranked.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, limit).otherwise(0.0)).alias("fixed"),
                         F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if now["n"] == capped:
            break
        capped = now["n"]
        if not now["open"]:
            break
        level = (total - now["fixed"]) / now["open"]
    return ranked.withColumn("target", F.when(F.col("weight") * F.lit(level) >= limit, limit).otherwise(F.col("weight") * F.lit(level)))


def _seats(weight: Column, threshold: Column, limit: str | None = None) -> Column:
    """How many quotients weight / (2 s + 1) are at least the threshold; at most ``limit``."""
    n = F.when((weight > 0) & (threshold > 0), F.floor((weight / threshold + 1) / 2)).otherwise(F.lit(0)).cast("long")
    return F.least(n, F.col(limit)) if limit else n


def apportion(cells: DataFrame, group: str, weight: str, house: str, order: list[str], limit: str | None = None) -> DataFrame:
    """Add ``seats``: the group's ``house`` seats by the highest quotients weight / (2 s + 1), ties by ``order``; a cell gets at most
    ``limit`` seats (a column), the others go to the next quotients. ``group`` must not be NULL; ``house`` is the same in all rows of a group."""
    positive = F.when(F.col(weight) > 0, F.col(weight))
    groups = cells.groupBy(group).agg(F.max(house).alias("a_house"), F.sum(weight).alias("w"), F.min(positive).alias("least"),
                                      *([F.sum(F.when(F.col(weight) > 0, F.col(limit))).alias("room")] if limit else []))
    if limit:
        groups = groups.withColumn("a_house", F.least("a_house", "room"))
    # at the smallest weight / (2 h + 2) every cell has h seats or its limit; above w / h there are fewer than h, since a cell has at most weight / threshold
    state = groups.select(F.col(group).alias("a_group"), "a_house", (F.col("least") / (2 * F.col("a_house") + 2)).alias("a_low"), (F.col("w") / F.greatest(F.lit(1), "a_house") * 1.01).alias("a_high"))
    state = materialise(state.filter((F.col("a_house") > 0) & (F.col("w") > 0)))
    for _ in range(ROUNDS):
        at = [F.col("a_low") + (F.col("a_high") - F.col("a_low")) * (i / POINTS) for i in range(POINTS + 1)]
        counts = (cells.select(group, weight, *([limit] if limit else [])).join(state, F.col(group) == F.col("a_group"))
                  .groupBy("a_group", "a_house", "a_low", "a_high").agg(F.array(*[F.sum(_seats(F.col(weight), p, limit)) for p in at]).alias("n")))
        # the last point that still gives at least h seats, and the first that gives fewer
        last = F.greatest(F.lit(0), F.size(F.filter("n", lambda c: c >= F.col("a_house"))) - 1)
        step = (F.col("a_high") - F.col("a_low")) / POINTS
        state = materialise(counts.select("a_group", "a_house", (F.col("a_low") + step * last).alias("a_low"), (F.col("a_low") + step * F.least(F.lit(POINTS), last + 1)).alias("a_high")))
    held = cells.join(state, F.col(group) == F.col("a_group"), "left").withColumn("sure", _seats(F.col(weight), F.col("a_high"), limit)).withColumn("may", _seats(F.col(weight), F.col("a_low"), limit))
    held = materialise(held)
    sure = held.groupBy(group).agg(F.sum("sure").alias("given")).withColumnRenamed(group, "sg")
    contested = (held.filter(F.col("may") > F.col("sure")).withColumn("s", F.explode(F.sequence(F.col("sure"), F.col("may") - 1)))
                 .withColumn("quotient", F.col(weight) / (2 * F.col("s") + 1)))
    rank = Window.partitionBy(group).orderBy(F.col("quotient").desc(), *order)
    won = (contested.withColumn("r", F.row_number().over(rank)).join(sure, F.col(group) == F.col("sg")).filter(F.col("r") <= F.col("a_house") - F.col("given"))
           .groupBy(*[F.col(c).alias(f"w_{c}") for c in [group, *order]]).agg(F.count(F.lit(1)).alias("won")))
    same = F.lit(True)
    for c in [group, *order]:
        same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    return held.join(won, same, "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0))).select(*cells.columns, "seats")


def quotas(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float, block: int) -> DataFrame:
    """(source, shard) cells of written plan rows with target, blocks and quota."""
    cells = rows.groupBy("sid", "source", "shard").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("copies")).alias("all_words"))
    sources = cells.groupBy("sid", "source").agg(F.sum("words").alias("distinct_size"), F.sum("all_words").alias("source_size"))
    wanted = targets(sources, weights, share, cap)
    # what the mix takes of each distinct word is target / source_size; the seats count blocks of distinct words
    wanted = materialise(wanted.withColumn("claim", F.when(F.col("source_size") > 0, F.col("target") * F.col("distinct_size") / F.col("source_size")).otherwise(0.0)).withColumn("one", F.lit(1)))
    claims = float(wanted.agg(F.sum("claim")).first()[0] or 0)
    seated = apportion(wanted.withColumn("house", F.lit(math.floor(claims / block + 0.5)).cast("long")), "one", "claim", "house", ["sid"])
    seated = materialise(seated.select(F.col("sid").alias("s_sid"), "source_size", "target", F.col("seats").alias("source_seats")))
    blocks = F.greatest(F.lit(1), F.floor(F.col("words") / block + 0.5)).cast("long")
    cells = (cells.join(seated, F.col("sid") == F.col("s_sid")).withColumn("blocks", blocks).withColumn("limit", F.floor(F.col("blocks") * cap).cast("long"))
             .select("sid", "source", "shard", "words", "blocks", "limit", "source_size", "target", "source_seats"))
    cells = materialise(cells.withColumn("w", F.when(F.col("words") > 0, F.col("blocks")).otherwise(0).cast("double")))
    lengths = cells.groupBy("sid").agg(F.try_divide(F.sum("w"), F.sum("words")).alias("per_word")).withColumnRenamed("sid", "l_sid")
    house = F.floor(F.col("source_seats") * block * F.coalesce("per_word", F.lit(0.0)) + 0.5).cast("long")
    cells = cells.join(lengths, F.col("sid") == F.col("l_sid")).withColumn("house", house).drop("l_sid", "per_word")
    return apportion(materialise(cells), "sid", "w", "house", ["shard"], "limit").withColumnRenamed("seats", "quota")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 64,
        shard_docs: int = 1024, seed: str = "mix") -> DataFrame:
    """Per distinct (doc_id, source, key): size, copies, source_size, target, taken (words the mix takes of one copy), and
    where it lies: ``first`` (words before it in its shard), ``words``, ``blocks``, ``quota``, ``turn`` of the shard."""
    rows = materialise(plan_rows(docs).withColumn("sid", F.md5(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
                       .withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "key", "sid"))))
    number = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    n_shards = lambda n: F.greatest(F.lit(1), F.ceil(n / shard_docs)).cast("long")              # noqa: E731
    own = materialise(rows.groupBy(F.col("sid").alias("n_sid")).agg(n_shards(F.count(F.when(F.col("size") > 0, 1))).alias("n_full"), n_shards(F.count(F.when(F.col("size") == 0, 1))).alias("n_empty")))
    rows = (rows.join(own, F.col("sid") == F.col("n_sid"))
            .withColumn("shard", F.when(F.col("size") > 0, number % F.col("n_full")).otherwise(-1 - number % F.col("n_empty"))).drop("n_sid", "n_full", "n_empty"))
    cells = quotas(rows, weights, share, cap, block).select(F.col("sid").alias("c_sid"), F.col("shard").alias("c_shard"), "words", "source_size", "target", "blocks", "quota")
    w = Window.partitionBy("sid", "shard").orderBy("draw", "doc_id", "source", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("size").over(w), F.lit(0)))
    placed = (placed.join(cells, (F.col("sid") == F.col("c_sid")) & (F.col("shard") == F.col("c_shard")))
              .withColumn("turn", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "sid", F.col("shard").cast("string"))), 1, 7), 16, 10).cast("long")))
    return placed.withColumn("taken", taken()).select("doc_id", "source", "key", "size", "copies", "source_size", "target", "taken", "first", "words", "blocks", "quota", "turn")


def times(j: Column) -> Column:
    """How often block ``j`` of a shard is taken."""
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.col("turn") % len(PRIMES) + 1).cast("int"))
    again = (j * prime + F.col("turn")) % F.col("blocks") < F.col("quota") % F.col("blocks")
    return F.floor(F.col("quota") / F.col("blocks")) + F.when(again, 1).otherwise(0)


def taken() -> Column:
    """Words of a document in the blocks taken: block ``j`` covers words ``j words div blocks`` up to the next block's first."""
    size, first, words, blocks = (F.col(c) for c in ("size", "first", "words", "blocks"))

    def start(j: Column) -> Column:
        return F.floor(j * words / blocks).cast("long")

    low = F.greatest(F.lit(0), F.floor(first * blocks / words) - 1).cast("long")
    high = F.least(blocks - 1, F.floor((first + size) * blocks / words) + 1).cast("long")
    part = F.aggregate(F.sequence(low, high), F.lit(0).cast("long"), lambda a, j: a + times(j).cast("long") * F.greatest(
        F.lit(0).cast("long"), F.least(first + size, start(j + 1)) - F.greatest(first, start(j))))
    return F.when((size > 0) & (F.col("quota") > 0), part).otherwise(F.lit(0)).cast("long")


def block_times(first_block: int, last_block: int, blocks: int, quota: int, turn: int) -> np.ndarray:
    """:func:`times` for the blocks of a document, inside a task."""
    j = np.arange(first_block, last_block + 1)
    again = (j * PRIMES[turn % len(PRIMES)] + turn) % blocks < quota % blocks
    return quota // blocks + again


def taken_text(text: str, size: int, first: int, words: int, blocks: int, quota: int, turn: int) -> str:
    """The words a mix takes of a text, with the white space between them: passes follow each other on a new line, and so do
    parts that are not next to each other."""
    if not size or not quota:
        return ""
    a, z = first * blocks // words, min(blocks - 1, (first + size) * blocks // words + 1)
    a = max(0, a - 1)
    n = block_times(a, z, blocks, quota, turn)
    j = np.arange(a, z + 1)
    begin = np.maximum(j * words // blocks - first, 0)
    end = np.minimum((j + 1) * words // blocks - first, size)
    use = end > begin
    n, begin, end = n[use], begin[use], end[use]
    if n.min() == n.max():
        return "\n".join([text] * int(n[0]))
    at = [m.span() for m in _WORD.finditer(text)]
    out = []
    for turn_no in range(1, int(n.max()) + 1):
        held = None
        for i in np.nonzero(n >= turn_no)[0]:
            if held is not None and held[1] == begin[i]:
                held = (held[0], end[i])
            else:
                if held is not None:
                    out.append(text[at[held[0]][0]:at[held[1] - 1][1]])
                held = (begin[i], end[i])
        if held is not None:
            out.append(text[at[held[0]][0]:at[held[1] - 1][1]])
    return "\n".join(out)


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """The columns of ``docs``: each row's text cut to the words the mix takes of it (more than once, where the mix repeats
    them); rows of which nothing is taken go."""
    plan = materialise(mix(docs, **params).filter(F.col("taken") > 0).select(
        F.col("doc_id").alias("p_doc"), F.col("source").alias("p_source"), F.col("key").alias("p_key"),
        F.struct("size", "first", "words", "blocks", "quota", "turn").alias("plan")))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text.alias("body"),
                       F.col("doc_id").cast("long").alias("r_doc"), F.col("source").cast("string").alias("r_source"), text_key(text).alias("r_key"))
    met = rows.join(plan, F.col("r_doc").eqNullSafe(F.col("p_doc")) & F.col("r_source").eqNullSafe(F.col("p_source")) & (F.col("r_key") == F.col("p_key")))
    name = "plan"
    while name in docs.columns:
        name += "_"
    flat = met.select(*[F.col("body").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], F.col("plan").alias(name))
    at = docs.columns.index("text")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        new = [taken_text(t, **p) for t, p in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
        columns = b.columns[:-1]
        columns[at] = pa.array(new, b.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return flat.mapInArrow(batches_of(one), flat.drop(name).schema)


SQL = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS size FROM documents),
keyed AS (SELECT doc_id, source, key, size, count(*) AS copies, md5(coalesce('=' || source, '')) AS sid FROM raw GROUP BY ALL),
drawn AS (SELECT *, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || key || '|' || sid) AS draw FROM keyed),
own AS (SELECT sid, greatest(1, ceil(count(*) FILTER (WHERE size > 0) / 1024))::BIGINT AS n_full, greatest(1, ceil(count(*) FILTER (WHERE size = 0) / 1024))::BIGINT AS n_empty FROM drawn GROUP BY sid),
rows_ AS (SELECT d.*, CASE WHEN size > 0 THEN ('0x' || substr(draw, 1, 8))::BIGINT % n_full ELSE -1 - ('0x' || substr(draw, 1, 8))::BIGINT % n_empty END AS shard FROM drawn d JOIN own o ON d.sid = o.sid),
cells AS (SELECT sid, source, shard, sum(size)::BIGINT AS words, sum(size * copies)::BIGINT AS all_words FROM rows_ GROUP BY ALL),
sources AS (SELECT sid, source, sum(words)::BIGINT AS distinct_size, sum(all_words)::BIGINT AS source_size FROM cells GROUP BY ALL),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sources),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS t FROM sources),
-- water filling: the level at which the sources with the smallest cap for their weight are full
steps AS (SELECT *, coalesce(sum(2.0 * source_size) OVER w, 0)::DOUBLE AS fixed, sum(weight) OVER (ORDER BY 2.0 * source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open
  FROM weighed WINDOW w AS (ORDER BY 2.0 * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(first(((SELECT t FROM total) - fixed) / open ORDER BY 2.0 * source_size / weight, sid) FILTER (WHERE ((SELECT t FROM total) - fixed) / open * weight < 2.0 * source_size), 0)::DOUBLE AS l FROM steps),
wanted AS (SELECT *, CASE WHEN weight * l >= 2.0 * source_size THEN 2.0 * source_size ELSE weight * l END::DOUBLE AS target FROM weighed, level),
claimed AS (SELECT *, CASE WHEN source_size > 0 THEN target * distinct_size / source_size ELSE 0 END::DOUBLE AS claim FROM wanted),
house AS (SELECT floor(sum(claim) / 64 + 0.5)::BIGINT AS h FROM claimed),
seats AS (SELECT sid, count(*) AS source_seats FROM (
  SELECT sid, row_number() OVER (ORDER BY claim / (2 * s + 1) DESC, sid) AS r FROM claimed, unnest(range((claim / 64 * 1.1 + 20)::BIGINT)) AS u(s) WHERE claim > 0)
  WHERE r <= (SELECT h FROM house) GROUP BY sid),
blocked AS (SELECT c.sid, c.shard, c.words, greatest(1, floor(c.words / 64 + 0.5))::BIGINT AS blocks, CASE WHEN c.words > 0 THEN greatest(1, floor(c.words / 64 + 0.5)) ELSE 0 END::DOUBLE AS w FROM cells c),
houses AS (SELECT b.sid, floor(source_seats * 64 * (sum(w) / sum(words)) + 0.5)::BIGINT AS house FROM blocked b JOIN seats q ON b.sid = q.sid GROUP BY b.sid, source_seats),
cell_seats AS (SELECT sid, shard, count(*) AS seats FROM (
  SELECT b.sid, shard, house, row_number() OVER (PARTITION BY b.sid ORDER BY w / (2 * s + 1) DESC, shard) AS r
  FROM blocked b JOIN houses h ON b.sid = h.sid, unnest(range(2 * blocks)) AS u(s) WHERE w > 0)
  WHERE r <= house GROUP BY sid, shard),
quota AS (SELECT c.sid, c.shard, c.words, c.blocks, coalesce(q.seats, 0) AS quota,
    ('0x' || substr(md5('mix|' || c.sid || '|' || c.shard), 1, 7))::BIGINT AS turn
  FROM blocked c LEFT JOIN cell_seats q ON c.sid = q.sid AND c.shard = q.shard),
placed AS (SELECT r.*, q.words, q.blocks, q.quota, q.turn,
    coalesce(sum(size) OVER (PARTITION BY r.sid, r.shard ORDER BY draw, doc_id NULLS FIRST, r.source NULLS FIRST, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM rows_ r JOIN quota q ON r.sid = q.sid AND r.shard = q.shard),
cut AS (SELECT sid, shard, turn, blocks, quota, j, floor(j * words / blocks)::BIGINT AS a, floor((j + 1) * words / blocks)::BIGINT AS b,
    quota // blocks + CASE WHEN (j * [{", ".join(map(str, PRIMES))}][(turn % 4 + 1)::INT] + turn) % blocks < quota % blocks THEN 1 ELSE 0 END AS times
  FROM quota, unnest(range(blocks)) AS u(j)),
took AS (SELECT doc_id, source, key, size, sum(times * greatest(0, least(first + size, b) - greatest(first, a)))::BIGINT AS taken
  FROM placed p JOIN cut c ON p.sid = c.sid AND p.shard = c.shard AND c.a < p.first + p.size AND c.b > p.first AND size > 0 GROUP BY ALL)
SELECT p.doc_id, p.size, w.source_size, w.target, coalesce(t.taken, 0) AS taken, u.copy::INT AS copy
FROM placed p JOIN wanted w ON p.sid = w.sid
LEFT JOIN took t ON t.doc_id IS NOT DISTINCT FROM p.doc_id AND t.source IS NOT DISTINCT FROM p.source AND t.key = p.key,
unnest(range(1, p.copies + 1)) AS u(copy)
"""
