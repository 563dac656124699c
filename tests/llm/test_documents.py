"""Line dedup, near duplicates, components, mixing, secrets and the pipeline against brute-force versions."""
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recurra.llm import lines, mixing, parity, queries, secrets
from recurra.llm.common import table
from recurra.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_sainte_lague_mix", "op7_exact_topk", "op8_parity_sketch_join"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


# -- lines ---------------------------------------------------------------------------------------
def dedup_by_hand(docs, min_words):
    """Windows as lists of lines, first owner by (id, line)."""
    owner, found = {}, []
    for d, t in sorted(docs, key=lambda x: x[0]):
        ls = [(i, " ".join([x.strip(" \t\r\x0b\x0c")]), len(WORD.findall(x))) for i, x in enumerate(t.split("\n"))]
        ls = [x for x in ls if x[2]]
        spans = set()
        for a in range(len(ls)):
            for step in (1, -1):
                n, b = 0, a
                while 0 <= b < len(ls) and n < min_words:
                    n, b = n + ls[b][2], b + step
                if n >= min_words:
                    spans.add((min(a, b - step), max(a, b - step)))
        for a, b in sorted(spans):
            found.append((d, ls[a][0], ls[b][0], tuple(x[1] for x in ls[a:b + 1])))
    for d, a, b, body in sorted(found):
        owner.setdefault(body, (d, a))
    gone = defaultdict(set)
    for d, a, b, body in found:
        if owner[body] != (d, a):
            gone[d].update(range(a, b + 1))
    out = {}
    for d, t in docs:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        out[d] = t if not gone[d] else left if WORD.search(left) else ""
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_brute_force(make, seed):
    r = random.Random(seed)
    pool = [" ".join(words(r, r.randint(1, 6), 30)) for _ in range(25)]
    docs = [(i, "\n".join(r.choice(pool + ["", "  "]) if r.random() < 0.7 else " ".join(words(r, 4)) for _ in range(r.randint(1, 25)))) for i in range(60)]
    got = {x.doc_id: x.text for x in lines.dedup_lines(make(docs), min_words=8, runs_name="gone").collect()}
    assert got == dedup_by_hand(docs, 8)


def test_shared_passage_goes_and_clean_lines_stay(make):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"own {i} line\n{passage}\nend {i}") for i in range(50)]
    got = {x.doc_id: x.text for x in lines.dedup_lines(make(docs), runs_name="gone").collect()}
    assert passage in got[0] and all(got[i] == f"own {i} line\nend {i}" for i in range(1, 50))


def test_line_dedup_of_odd_input(make):
    long = "\n".join(f"line {i} of a very long text indeed it is" for i in range(20_000))
    docs = make([(None, "a b c d e f g h i"), (1, None), (2, ""), (3, "a b c d e f g h i"), (3, "a b c d e f g h i"), (4, long), (5, long), (6, "\n \n")])
    rows = lines.dedup_lines(docs, runs_name="gone").collect()
    assert len(rows) == 8 and set(docs.columns) < set(rows[0].asDict())
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x.text)
    assert by[None] == ["a b c d e f g h i"] and by[3] == ["", ""] and by[1] == [None] and by[2] == [""] and by[4] == [long] and by[5] == [""] and by[6] == ["\n \n"]
    assert lines.dedup_lines(docs.limit(0), runs_name="gone").count() == 0


# -- near duplicates -----------------------------------------------------------------------------------
def sets_of(t, width):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components_by_hand(docs, width, per):
    s = {d: sets_of(t, width) for d, t in docs}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(s), 2):
        i = len(s[a] & s[b])
        if i and 100 * i >= per * (len(s[a]) + len(s[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s[d]), find(d)) for d in s}


def near_copies(seed):
    """Families whose members are edited more and more, so that similarities lie on both sides of the threshold."""
    r = random.Random(seed)
    docs, n = [], 0
    for size in (3, 5, 8, 20, 60, 150, 400):
        base = words(r, size)
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 25))):
                w[r.randrange(len(w))] = f"x{r.randrange(50)}"
            if r.random() < 0.3:
                w = w[:int(len(w) * r.uniform(0.8, 1))] or w
            docs.append((n, " ".join(w)))
            n += 1
    return docs + [(n, ""), (n + 1, "one"), (n + 2, "One")]


@pytest.mark.parametrize("seed,width,per", [(0, 4, 85), (1, 5, 80), (2, 4, 85)])
def test_components_equal_brute_force(make, seed, width, per):
    docs = near_copies(seed)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity.near_duplicates(make(docs), width, per).collect()}
    assert got == components_by_hand(docs, width, per)


def test_hot_family_loses_no_link(make, monkeypatch):
    """A family in which most pairs are unlike: only exhaustive comparison inside its groups finds all links."""
    monkeypatch.setattr(parity, "BLOCK", 8)
    r = random.Random(5)
    base = words(r, 120)
    docs = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = f"y{r.randrange(10_000)}"
        docs.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity.near_duplicates(make(docs), 4, 85).collect()}
    assert got == components_by_hand(docs, 4, 85)


def test_near_duplicates_of_odd_input(make):
    text = " ".join(f"w{i}" for i in range(50))
    docs = make([(None, text), (5, text), (5, text), (7, text.upper()), (8, None), (9, ""), (10, " \n"), (11, "long " * 300_000)])
    rows = parity.near_duplicates(docs).collect()
    assert len(rows) == 8
    assert {x.component_id for x in rows if x.doc_id in (None, 5, 7)} == {5}
    assert sorted((x.n_shingles, x.component_id) for x in rows if x.doc_id in (8, 9, 10)) == [(0, 8), (0, 9), (0, 10)]
    kept = parity.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == [5, 8, 9, 10, 11]
    assert parity.near_duplicates(docs.limit(0)).count() == 0 and parity.keep_one(docs.limit(0)).count() == 0


def test_parts_agree_as_the_pigeonhole_says():
    plan = parity.Plan(85)
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 13, 40, 300, 3000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(20):
            drop = r.integers(0, plan.differ(2 * n) // 2 + 1)
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                assert set(parity.part_keys(a, plan)) & set(parity.part_keys(b, plan))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# -- mixing ---------------------------------------------------------------------------------------------
def test_mix_meets_targets(make):
    r = random.Random(2)
    docs = make([(i, " ".join(words(r, r.randint(0, 400))), None, r.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(600)])
    plan = mixing.mix(docs).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for x in plan:
        assert 0 <= x.taken <= 2 * x.size
        by[x.source][0] += x.size
        by[x.source][1] = x.target
        by[x.source][2] += x.taken
    assert all(s == next(x.source_size for x in plan if x.source == k) for k, (s, _, _) in by.items())
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * sum(s for s, _, _ in by.values())) < 1e-6
    assert all(abs(n - t) < 0.02 * t + 200 for _, t, n in by.values())
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    free = {k: t / weight[k] for k, (s, t, _) in by.items() if t < 2 * s - 1e-6}
    assert max(free.values()) - min(free.values()) < 1e-6
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, plan), key=repr)


def test_apply_mix_takes_the_planned_words(make):
    r = random.Random(4)
    docs = make([(i, "\n".join(" ".join(words(r, 30)) for _ in range(r.randint(0, 12))), None, r.choice("aaab")) for i in range(200)])
    plan = {x.doc_id: x.taken for x in mixing.mix(docs).collect()}
    done = mixing.apply_mix(docs)
    assert done.columns == docs.columns
    got = {x.doc_id: len(WORD.findall(x.text)) for x in done.collect()}
    assert got == {d: n for d, n in plan.items() if n}


def test_mix_of_odd_input(make):
    docs = make([(None, "a b c", None, None), (1, None, None, "x"), (2, "", None, "x"), (3, "q " * 300_000, None, "y"), (4, "same", None, "z"), (4, "same", None, "z")])
    rows = mixing.mix(docs).collect()
    assert sum(x.copies for x in rows) == 6 and all(x.taken <= 2 * x.size for x in rows)
    assert {x.doc_id: x.taken for x in rows if not x.size} == {1: 0, 2: 0}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.limit(0)).count() == 0


def test_seats_go_to_the_highest_quotients(spark):
    r = random.Random(8)
    cells = [("g1", i, float(r.randint(0, 500))) for i in range(20)] + [("g2", i, 7.0) for i in range(9)] + [("g3", 0, 0.0)]
    house = {"g1": 137, "g2": 5, "g3": 3}
    df = spark.createDataFrame([(g, i, w, house[g]) for g, i, w in cells], "g string, i int, w double, h long")
    got = {(x.g, x.i): x.seats for x in mixing.apportion(df, "g", "w", "h", ["i"]).collect()}
    for g, h in house.items():
        q = sorted(((-w / (2 * s + 1), i) for gg, i, w in cells if gg == g and w for s in range(h)))[:h]
        want = Counter(i for _, i in q)
        assert {i: got[g, i] for gg, i, _ in cells if gg == g} == {i: want[i] for gg, i, _ in cells if gg == g}


def test_all_seats_are_given_when_cells_outnumber_them(spark):
    df = spark.createDataFrame([("g", i, 1.0 if i else 1e6, 400) for i in range(500)] + [("k", i, 5.0, 7) for i in range(3000)], "g string, i int, w double, h long")
    got = {x.g: x.n for x in mixing.apportion(df, "g", "w", "h", ["i"]).groupBy("g").agg(F.sum("seats").alias("n")).collect()}
    assert got == {"g": 400, "k": 7}


def test_seats_above_a_limit_go_to_other_cells(spark):
    df = spark.createDataFrame([("g", 0, 90.0, 12, 4), ("g", 1, 9.0, 12, 20), ("g", 2, 1.0, 12, 20), ("f", 0, 5.0, 9, 2), ("f", 1, 5.0, 9, 3)], "g string, i int, w double, h long, most long")
    got = {(x.g, x.i): x.seats for x in mixing.apportion(df, "g", "w", "h", ["i"], "most").collect()}
    assert got == {("g", 0): 4, ("g", 1): 7, ("g", 2): 1, ("f", 0): 2, ("f", 1): 3}


def test_mix_of_a_source_of_short_documents_among_many(make):
    """A source of 300 short documents in a table of 6,000 keeps its target, however many shards the others have."""
    r = random.Random(11)
    docs = make([(i, " ".join(words(r, 5 if i % 20 == 0 else 12)), None, "z" if i % 20 == 0 else "a") for i in range(6000)] + [(9000 + i, "", None, "z") for i in range(300)])
    plan = mixing.mix(docs, shard_docs=16).filter("source = 'z'").collect()
    assert len(plan) == 600 and all(x.taken <= 2 * x.size for x in plan)
    assert abs(sum(x.taken for x in plan) - plan[0].target) <= 0.05 * plan[0].target


# -- secrets ------------------------------------------------------------------------------------------------
def spans_by_hand(t):
    """The contract's patterns as written."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    bits = ["password", "Token", "SECRET", "api_key", "APIKEY", "passwd", "=", ":", " ", "'", '"', "abcdef12", "abc", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "é", "ſecret", "toKen", "-", ".", "\n"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert [x[:3] for x in secrets.base_spans(t)] == spans_by_hand(t), t


def test_ownership_separates_live_from_copied(make):
    live, copied = "Zx9Qw7Er5Ty3Ui1Op8As6Df", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op"
    docs = make([(1, f"key {live} here", None, "a"), (2, f"again {live}", None, "a")] + [(10 + i, f"x {copied} token={live}", None, f"s{i % 3}") for i in range(6)] +
                [(30, None, None, None), (31, "", None, "a"), (32, "x " * 500_000, None, "a"), (None, "password = hunter2hunter2", None, None)])
    rows = {x.doc_id: x for x in secrets.find_secrets(docs).withColumn("text", secrets.joined("spans")).collect()}
    assert rows[1].text == "" and rows[10].text == "assign:26:55"          # the value is under several owners
    only = {x.doc_id: x for x in secrets.find_secrets(docs.filter("doc_id < 3 OR doc_id IS NULL")).withColumn("text", secrets.joined("spans")).collect()}
    assert only[1].text == f"owned:4:{4 + len(live)}" and only[None].text == "assign:0:25" and only[None].n_live == 1
    assert rows[30].n_assign == rows[31].n_assign == rows[32].n_assign == 0 and len(rows) == 12
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_an_example_of_one_owner_is_copied(make):
    """Many repositories of one hot owner hold the example, few the live key."""
    live, example = "Zx9Qw7Er5Ty3Ui1Op8As6Df", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op"
    docs = make([(i, f"see {example} and token={example}x", None, "hot") for i in range(300)] + [(900 + i, f"use {live}", None, "hot") for i in range(3)])
    rows = secrets.find_secrets(docs).withColumn("text", secrets.joined("spans")).collect()
    assert {x.text for x in rows if x.doc_id < 300} == {"assign:32:62"} and {(x.n_live, x.n_copied) for x in rows if x.doc_id < 300} == {(0, 1)}
    assert {x.text for x in rows if x.doc_id >= 900} == {f"owned:4:{4 + len(live)}"}
    assert all(x.text.startswith("owned:4:27,assign") for x in secrets.find_secrets(docs, max_repos=1000).withColumn("text", secrets.joined("spans")).filter("doc_id < 300").collect())


def test_secrets_equal_a_plain_scan(spark):
    """Base and further spans of every document, with owners and repositories counted in one process."""
    rows = table(spark, SF, "documents").select("doc_id", "text", "source").collect()
    repos, owners, per = Counter(), defaultdict(set), {}
    for d, t, o in rows:
        t = t or ""
        base = spans_by_hand(t)
        more = []
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t):
            v = m[0]
            bits = -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())
            if bits >= 3 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not any(a < m.end() and e > m.start() for a, _, e in base):
                more.append((m.start(), 3, m.end()))
        value = lambda a, k, e: spans_value(t[a:e]) if k == 0 else t[a:e]              # noqa: E731
        per[d] = (base, [(x, value(*x)) for x in more])
        seen = {value(*x) for x in base} | {v for _, v in per[d][1]}
        repos.update(seen)
        for v in seen:
            owners[v].add(o)
    got = {x.doc_id: x.spans for x in queries.QUERIES["op10_secret_scan"](spark, SF).collect()}
    for d, (base, more) in per.items():
        spans = sorted(base + [x for x, v in more if len(owners[v]) <= 1 and repos[v] <= 16])
        assert got[d] == ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in spans)


def spans_value(match):
    return re.fullmatch(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", match, re.I | re.A)[1]


def test_further_spans_of_a_text_full_of_hits():
    t = " ".join(f"token={i:08}abc {'Q1w2E3r4T5y6U7i8O9p0' + str(i)}" for i in range(20_000))
    base = secrets.base_spans(t)
    assert len(base) == 20_000 and len(secrets.further_candidates(t, base)) == 20_000


def test_secret_query_digest(spark):
    got = {x.doc_id: x for x in queries.QUERIES["op10_secret_scan"](spark, SF).collect()}
    for d, t in table(spark, SF, "documents").select("doc_id", "text").collect():
        base = spans_by_hand(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(text.split(",")) - {""} <= set(got[d].spans.split(","))


# -- the pipeline ---------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, make):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count()
        assert docs.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0 or name in ("language_id", "near_duplicates")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(x.doc_id for x in out.collect()) == sorted(x.doc_id for x in docs.collect())
    again = {x.doc_id: x.ids_sha256 for x in corpus_pipeline.run(spark, SF).collect()}
    assert again == {x.doc_id: x.ids_sha256 for x in out.collect()}


def test_pipeline_of_odd_input(spark, make):
    r = random.Random(0)
    base = [(i, "\n".join(" ".join(words(r, 20)) for _ in range(5)), "en", "s") for i in range(40)]
    docs = make(base + [(100, None, "en", None), (None, base[0][1], "en", "s"), (101, "", None, "s"), (7, base[7][1], "en", "s")])
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.materialise(stage(spark, rows, SF))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
    # clean documents are still there, repeated rows and copies once
    assert sorted(x.doc_id for x in docs.collect() if x.doc_id is not None) + [None] * docs.filter("doc_id IS NULL").count() == [*range(1, 40), None]
