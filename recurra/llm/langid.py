"""Language identification by bit-sliced Bloom filters of character n-grams.

One table holds a Bloom filter per language: slot ``i`` is a bitmask with bit ``l`` set when language ``l`` has a key that
hashes to ``i``. And-ing the slots of an n-gram's hashes returns all languages that contain it at once. A text is decided
by the popcount of each language's bit over its n-grams, corrected for the filter's false positives:
``(hits - n f) / (1 - f)`` with ``f`` the language's exact fill to the power of the number of hashes.

Which n-grams a language contains is learned from a bounded, documented sample: about ``per_lang`` documents of each
language by hash of the id (``per_lang`` is the bound), counted over whole texts; an n-gram belongs to a language when its relative
frequency there is at least ``rare`` and at least ``contrast`` times its mean relative frequency over all languages.

Defined results: text that is NULL or has no letter is ``und`` with score 0; with nothing to learn from every text is
``und``; ties go to the language first by name; repeated rows score alike; other columns are ignored. A mask has as many 64-bit words
as the languages need.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import batch, batches_of, bounded_sample, fold, held_out, materialise

BROADCAST_ROWS = 250_000          # ids of rejected rows sent to every task at most

ORDERS = (2, 3, 4)
HASHES = 3
PRIMES = tuple(np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
U = np.uint64


@cache
def letters() -> np.ndarray:
    """True where a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters of a text with every run of other characters as one space, spaces at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[c]
    if not keep.any():
        return np.empty(0, U)
    c = np.where(keep, c, 32).astype(U)
    edge = np.concatenate(([True], keep[1:] | keep[:-1])) & ~keep | keep      # first of each run of others
    return np.concatenate((np.array([32], U), c[edge], np.array([32], U)))


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of all n-grams of a text, in order."""
    c = code_points(text or "")
    if not len(c):
        return c
    parts = []
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, U)
            for j in range(n):
                h = (h ^ c[j:len(c) - n + 1 + j]) * PRIMES[j]
                h ^= h >> U(29)
            parts.append(h)
    return np.concatenate(parts)


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    second = (h * PRIMES[1]) | U(1)
    return [((h + U(i) * second) >> U(64 - bits)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    langs: tuple[str, ...]
    table: np.ndarray             # (slots, words): one mask per slot
    bits: int

    @property
    def false_positive(self) -> np.ndarray:
        return np.array([((self.table[:, i >> 6] >> U(i & 63)) & U(1)).mean() ** HASHES for i in range(len(self.langs))])

    def languages(self, h: np.ndarray) -> np.ndarray:
        """The mask of all languages that contain each n-gram."""
        a, b, c = slots(h, self.bits)
        return self.table[a] & self.table[b] & self.table[c]

    def counts(self, h: np.ndarray) -> np.ndarray:
        masks = self.languages(h)
        if len(self.langs) <= 12:                          # one histogram of masks serves all languages
            hist = np.bincount(masks[:, 0].astype(np.int64), minlength=1 << len(self.langs))
            values = np.arange(len(hist))
            return np.array([hist[(values >> i) & 1 == 1].sum() for i in range(len(self.langs))], float)
        return np.array([((masks[:, i >> 6] >> U(i & 63)) & U(1)).sum() for i in range(len(self.langs))], float)


def build(pairs: list[tuple[str, int]], bits: int) -> Filters:
    """Filters from (language, n-gram hash) pairs."""
    langs = tuple(sorted({p[0] for p in pairs}))
    table = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), U)
    learned: dict[str, list[int]] = {lang: [] for lang in langs}
    for lang, g in pairs:
        learned[lang].append(g)
    for i, lang in enumerate(langs):
        for s in slots(np.array(learned[lang], np.int64).view(U), bits):
            table[s, i >> 6] |= U(1) << U(i & 63)
    return Filters(langs, table, bits)


def fit(docs: DataFrame, per_lang: int = 1500, rare: float = 3e-5, contrast: float = 0.5, bits: int = 20) -> Filters:
    """Learn from rows outside the held-out fold with a language and a text."""
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter((fold(F.col("id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = bounded_sample(known.select("id", "lang"), "lang", "id", per_lang)
    rows = known.join(F.broadcast(chosen.distinct().withColumnsRenamed({"id": "cid", "lang": "clang"})),     # about per_lang ids a language
                      (F.col("id") == F.col("cid")) & (F.col("lang") == F.col("clang")))

    def count(batches):
        for b in batches:
            for (lang, _), part in b.groupby(["lang", b["text"].str.len().cumsum() // (1 << 20)]):          # hashes of a bounded part at once
                h = [grams(t) for t in part["text"]]
                g, n = np.unique(np.concatenate(h) if h else np.empty(0, U), return_counts=True)
                yield pd.DataFrame({"lang": lang, "g": g.view(np.int64), "n": n.astype(np.int64)})

    counted = rows.select("lang", "text").mapInPandas(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    counted = materialise(counted)                          # read three times below
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "tlang")
    freq = counted.join(F.broadcast(totals), F.col("lang") == F.col("tlang")).withColumn("f", F.col("n") / F.col("total"))   # one row a language
    n_langs = max(1, totals.count())
    mean = freq.groupBy("g").agg((F.sum("f") / n_langs).alias("mean")).withColumnRenamed("g", "mg")
    kept = freq.filter(F.col("f") >= rare).join(mean, F.col("g") == F.col("mg")).filter(F.col("f") >= contrast * F.col("mean"))
    # at most 1 / rare n-grams of each order a language reach the frequency: the model's size is bounded
    return build([(r.lang, r.g) for r in kept.select("lang", "g").collect()], bits)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score: the share of the text's n-grams that the language contains (corrected, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        f = shared.value
        fp = f.false_positive

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = [], []
            for t in b.column("text").to_pylist():
                h = grams(t)
                if not len(h) or not f.langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                share = (f.counts(h) - len(h) * fp) / (1 - fp) / len(h)
                i = int(np.argmax(share))
                names.append(f.langs[i])
                scores.append(float(min(1.0, max(0.0, share[i]))))
            return batch(doc_id=b.column("doc_id"), lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))
        return batches_of(one)(batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def classify(docs: DataFrame, **params) -> DataFrame:
    found = identify(docs, fit(docs, **params))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, filters: Filters, min_score: float = 0.3) -> DataFrame:
    """The documents whose language is recognised (not ``und``, score at least ``min_score``), all columns and rows
    as they came. The decision depends on a row's own text. Rejected rows are written as (id, hash of the text) and, up to
    ``BROADCAST_ROWS`` of them, sent to every task, so that no text passes through Python twice; if there are more, rows are
    decided as they pass. Neither way shuffles texts, and both keep the same rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)

    def recognised(texts: pa.Array) -> pa.Array:
        f = shared.value
        fp = f.false_positive
        keep = []
        for t in texts.to_pylist():
            h = grams(t)
            keep.append(bool(len(h) and f.langs and ((f.counts(h) - len(h) * fp) / (1 - fp)).max() >= min_score * len(h)))
        return pa.array(keep, pa.bool_())

    def rejected(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.select(["r_doc", "r_key"]).filter(pc.invert(recognised(b.column("text"))))

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(recognised(b.column(at)))

    text = F.col("text").cast("string")
    doc, key = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit("")))
    gone = materialise(docs.select(doc.alias("r_doc"), key.alias("r_key"), text.alias("text")).mapInArrow(batches_of(rejected), "r_doc long, r_key long")).distinct()
    if gone.count() > BROADCAST_ROWS:
        at = docs.columns.index("text")
        return docs.mapInArrow(batches_of(rows), docs.schema)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc.alias("k_doc"), key.alias("k_key"))
    left = named.join(F.broadcast(gone), F.col("k_doc").eqNullSafe(F.col("r_doc")) & (F.col("k_key") == F.col("r_key")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
