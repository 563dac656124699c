"""Quality and language: accuracy on held-out rows, and the defined results of odd input."""
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from recurra.llm import langid, quality
from recurra.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
WORDS = {"en": "the of and to in is that it was for".split(), "de": "der die und ist nicht ein zu das mit für".split(), "fr": "le la les des est une dans que pour été".split()}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "n", "e"]) for _ in range(n))


def test_quality_separates_held_out_rows(spark):
    labels = table(spark, SF, "labels")
    rows = quality.classify(table(spark, SF, "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93


def test_quality_of_odd_input(spark, make):
    docs = make([(None, "text"), (1, None), (2, ""), (3, "word " * 200_000), (3, "word " * 200_000), (4, "ok")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_labels_never_reach_the_score(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert a == {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}


def test_languages_of_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    rows = langid.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98


def test_language_of_odd_input(make):
    docs = make([(i, prose(lang, 60, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 12)] +
                [(100, None, "en"), (101, "", None), (102, "123 --- 456", "de"), (None, prose("de", 50, 99), None), (103, prose("fr", 40_000, 5), None), (103, prose("fr", 40_000, 5), None)])
    found = [(r.doc_id, r.lang_pred, r.score) for r in langid.classify(docs).collect()]
    by = {d: (p, s) for d, p, s in found}
    assert all(by[d] == ("und", 0.0) for d in (100, 101, 102))
    assert by[None][0] == "de" and by[103][0] == "fr" and len(found) == 42
    assert all(0 <= s <= 1 for _, _, s in found)
    assert all(p == "und" for _, p, _ in [(r.doc_id, r.lang_pred, r.score) for r in langid.classify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()])
    assert langid.classify(docs.limit(0)).count() == 0


def test_keep_identified_returns_rows_as_they_are(make):
    docs = make([(i, prose("en", 60, i), "en", "s") for i in range(30)] + [(40, "12 34", "en"), (41, None, "en")])
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_keep_identified_is_the_same_where_ids_are_not_broadcast(make, monkeypatch):
    docs = make([(i, prose("en", 60, i), "en", "s") for i in range(30)] + [(40, "12 34", "en"), (41, None, "en"), (None, prose("en", 60, 3), "en"), (None, None, None)])
    filters = langid.fit(docs)
    few = sorted(map(str, langid.keep_identified(docs, filters).collect()))
    monkeypatch.setattr(langid, "BROADCAST_ROWS", -1)
    assert few and few == sorted(map(str, langid.keep_identified(docs, filters).collect()))
    assert not any("12 34" in r for r in few)



def test_filters_return_every_language_of_a_gram():
    h = langid.grams("abcdef")
    f = langid.build([("x", int(g)) for g in h.view("int64")] + [("y", int(g)) for g in h[:2].view("int64")], 16)
    assert (f.languages(h) & 1 == 1).all() and (f.languages(h[:2]) == 3).all()
    assert f.counts(h)[0] == len(h) and f.counts(h)[1] >= 2


def test_seventy_languages():
    h = langid.grams("abcdefghij")
    f = langid.build([(f"l{i:02}", int(g)) for i in range(70) for g in (h[:5] if i % 7 else h).view("int64")], 14)
    assert f.table.shape[1] == 2 and len(f.langs) == 70
    assert all(f.counts(h)[i] == len(h) for i in range(0, 70, 7)) and all(5 <= f.counts(h)[i] < len(h) for i in range(70) if i % 7)


def test_languages_equal_exact_sets(spark):
    """Every document against n-gram sets counted in one process; the Bloom filters may only move near-ties."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    counts, used = defaultdict(Counter), Counter()
    for d, t, lang in docs:
        if zlib.crc32(str(d).encode()) % 3 != 1 and lang is not None and t is not None:
            counts[lang].update(langid.grams(t).tolist())
            used[lang] += 1
    assert max(used.values()) <= 1500                              # the sample is everything here
    total = {k: sum(c.values()) for k, c in counts.items()}
    mean = defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            mean[g] += n / total[k] / len(counts)
    sets = {k: {g for g, n in c.items() if n / total[k] >= 3e-5 and n / total[k] >= 0.5 * mean[g]} for k, c in counts.items()}
    got = {r.doc_id: r for r in langid.classify(table(spark, SF, "documents")).collect()}
    for d, t, _ in docs:
        h = langid.grams(t).tolist()
        if not h:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        share = {k: sum(g in s for g in h) / len(h) for k, s in sets.items()}
        assert share[got[d].lang_pred] >= max(share.values()) - 0.02 and abs(got[d].score - share[got[d].lang_pred]) < 0.05


def test_scores_equal_a_plain_scorer(spark):
    docs = table(spark, SF, "documents")
    m = quality.fit(docs, table(spark, SF, "labels"))
    by = []
    for raw in (m.good, m.bad):
        by.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), level=m.level, write_content_size=False, write_dict_id=False))
    got = {r.doc_id: r for r in quality.score(docs, m).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        data = (t or "").encode()
        good, bad = (sum(len(c.compress(data[i:i + m.piece])) for i in range(0, len(data), m.piece)) for c in by)
        x = [(bad - good) / (bad + good), (bad - good) / len(data), math.log(min(good, bad) / len(data))] if data else [0.0, 0.0, 0.0]
        z = [min(6, max(-6, (v - a) / b)) for v, a, b in zip(x, m.mean, m.scale)]
        s = 1 / (1 + math.exp(-sum(w * v for w, v in zip(m.weights, z + [v * v for v in z])) - m.bias))
        assert abs(got[d].score - s) < 1e-6 and got[d].predicted == int(got[d].score >= 0.5)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 20, 31, 47, 400])
def test_pieces_are_spread_over_the_text(n):
    data = b"".join(i.to_bytes(4, "big") for i in range(n))
    at = [int.from_bytes(p, "big") for p in quality.spread(data, 4, 16)]
    assert len(at) == len(set(at)) == min(16, n) and at == sorted(at)
    if n > 16:
        assert at[0] == 0 and at[-1] >= n - 1 - n / 16 and max(b - a for a, b in zip(at, at[1:])) <= n / 16 + 1
