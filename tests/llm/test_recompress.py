"""Substring dedup by recompression against windows compared as lists of words."""
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from recurra.llm import queries, recompress

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    first = {}
    for d, t in docs:
        ws = WORD.findall(t or "")
        for i in range(len(ws) - window + 1):
            if d is not None:
                k = tuple(ws[i:i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        ws = WORD.findall(t or "")
        gone = {j for i in range(len(ws) - window + 1) if d is not None and first[tuple(ws[i:i + window])] < d for j in range(i, i + window)}
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def deduped(df, **kw):
    return sorted((tuple(r) for r in recompress.dedup_substrings(df, **kw).select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


@pytest.mark.parametrize("seed,window,rounds,vocabulary", [(0, 50, 4, 300), (1, 12, 3, 3), (2, 7, 6, 2), (3, 3, 1, 4), (4, 20, 0, 2), (5, 50, 4, 1), (6, 1, 2, 40)])
def test_dedup_equals_brute_force(make, monkeypatch, seed, window, rounds, vocabulary):
    monkeypatch.setattr(recompress, "PIECE", 64)                       # long texts in pieces
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"                        # noqa: E731
    pool = [[word() for _ in range(r.randint(1, 3 * window))] for _ in range(12)]
    docs = []
    for i in range(70):
        ws = []
        while len(ws) < r.randint(0, 6 * window):
            ws += r.choice(pool) if r.random() < 0.5 else [word() for _ in range(r.randint(1, window))]
            ws += ["ab", "ba"] * r.randint(0, window) if r.random() < 0.2 else []
        docs.append((i, r.choice([" ", "\n", "\t "]).join(ws)))
    docs += [(100 + i, docs[7][1]) for i in range(25)]                  # copies
    assert deduped(make(docs), window=window, rounds=rounds) == brute(docs, window)


def test_equal_windows_choose_equal_symbols():
    r = np.random.default_rng(0)
    for vocabulary, rounds in ((50, 4), (2, 6), (1, 5)):
        words = r.integers(1, vocabulary + 1, (40, 2), np.uint64)
        names = np.zeros(200, np.uint64)
        passage = recompress.mix(words[:30, 0], np.uint64(0), 5)
        names[10:40], names[120:150] = passage, passage
        names[40:119] = recompress.mix(r.integers(1, vocabulary + 1, 79).astype(np.uint64), np.uint64(0), 5)
        stop = names == 0
        starts = np.array([10, 120, 15, 125])
        _, key = recompress.representatives(names, stop, starts, 25, rounds)
        assert key[0] == key[1] and key[2] == key[3]


def test_dedup_of_odd_input(make):
    long = " ".join(f"x{i}" for i in range(60))
    docs = [(3, long), (3, long), (3, "a " + long), (None, long), (1, None), (2, ""), (5, "  " + long.replace(" ", "\r\n")), (-4, "one two"), (6, "y" * 100_000), (7, long + " " + "z " * 70)]
    assert deduped(make(docs)) == brute(docs, 50)
    assert deduped(make(docs).limit(0)) == []
    assert deduped(make([(None, None)])) == [(None, 0, 0, "")]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = queries.QUERIES["op11_recompression_dedup"](spark, "/root/testdata/sf0.01")
    cur = con.execute(queries.SQL["op11_recompression_dedup"])
    cols = [c[0] for c in cur.description]
    got = sorted(tuple(r) for r in df.select(*cols).collect())
    assert got == sorted(cur.fetchall()) and sum(r[cols.index("n_removed")] for r in got) > 0
    assert hashlib.sha256(b"").hexdigest() in {r[cols.index("kept_sha256")] for r in got}
