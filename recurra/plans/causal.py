"""Clock, ledger, identity and difference queries."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.digest import canonical as json_of
from ..operators import causal as V, consolidate as C, ledger as L
from ..session import materialise, scratch_dir
from ..sources import state
from .bindings import with_views
from .registry import query

ROLES = ("assistant", "system", "user")
CV_SQL = """WITH r AS (SELECT conv_id, turn, role, count(*) FILTER (role='assistant') OVER w AS a, count(*) FILTER (role='user') OVER w AS u, count(*) FILTER (role='system') OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT conv_id, turn, role, CASE WHEN role='system' THEN 0 ELSE a END AS a, CASE WHEN role='system' THEN s ELSE 0 END AS s, CASE WHEN role='system' THEN 0 ELSE u END AS u,
    turn * 60 + CASE role WHEN 'assistant' THEN -115 WHEN 'system' THEN 125 ELSE 0 END AS wall FROM r),
  pr AS (SELECT m.conv_id, m.turn AS m_turn, x.turn AS a_turn, m.a AS ma, m.s AS ms, m.u AS mu, x.a AS xa, x.s AS xs, x.u AS xu, m.wall AS m_wall, x.wall AS a_wall FROM c m JOIN c x ON m.conv_id = x.conv_id
    WHERE m.turn = (SELECT min(f.turn) FROM conversations f WHERE f.conv_id = m.conv_id AND f.text IS NOT DISTINCT FROM (SELECT g.text FROM conversations g WHERE g.conv_id = m.conv_id AND g.turn = m.turn)))"""
TEXT_SQL = "concat_ws(',', CASE WHEN {p}a > 0 THEN 'assistant:' || {p}a END, CASE WHEN {p}s > 0 THEN 'system:' || {p}s END, CASE WHEN {p}u > 0 THEN 'user:' || {p}u END)"


def clocks(t):
    c = V.turn_clocks(t.raw("conversations").select("conv_id", "turn", "role"), ROLES, isolated=("system",))
    skew = F.when(F.col("role") == "assistant", -115).when(F.col("role") == "system", 125).otherwise(0)
    return c.withColumn("wall", F.col("turn") * 60 + skew)


def pairs(t):
    """Memories are content-addressed: a conversation has one for each text, with the turn that said it first. Every turn meets all of them."""
    c = materialise(clocks(t).select("conv_id", "turn", "role", "clock", "wall"))
    said = t.raw("conversations").groupBy("conv_id", F.sha2("text", 256).alias("memory_id")).agg(F.min("turn").alias("turn")).select("conv_id", "turn")
    first = c.join(said, ["conv_id", "turn"]).select("conv_id", "turn", "clock", "wall")
    return V.with_memories(c, first, "conv_id", ["turn", "clock", "wall"])


@query("vclock_turns", CV_SQL + f" SELECT conv_id, turn, {TEXT_SQL.format(p='')} AS clock FROM c")
def vclock_turns(t):
    return clocks(t).select("conv_id", "turn", V.canonical(F.col("clock")).alias("clock"))


@query("vclock_merge", CV_SQL + f", m AS (SELECT conv_id, max(a) AS a, max(s) AS s, max(u) AS u FROM c GROUP BY 1) SELECT conv_id, {TEXT_SQL.format(p='')} AS clock FROM m")
def vclock_merge(t):
    return V.merge_rows(clocks(t), ["conv_id"], "clock").select("conv_id", V.canonical(F.col("clock")).alias("clock"))


@query("causal_relation", CV_SQL + """ SELECT conv_id, m_turn, a_turn, CASE WHEN ma = xa AND ms = xs AND mu = xu THEN 'equal' WHEN ma <= xa AND ms <= xs AND mu <= xu THEN 'before' WHEN ma >= xa AND ms >= xs AND mu >= xu THEN 'after' ELSE 'concurrent' END AS relation FROM pr""")
def causal_relation(t):
    return pairs(t).select("conv_id", "m_turn", "a_turn", V.relation(F.col("m_clock"), F.col("a_clock")).alias("relation"))


@query("causal_join", CV_SQL + " SELECT conv_id, m_turn, a_turn FROM pr WHERE ma <= xa AND ms <= xs AND mu <= xu")
def causal_join(t):
    return V.causal_join(pairs(t)).select("conv_id", "m_turn", "a_turn")


@query("clock_skew_disagreement", CV_SQL + " SELECT ma <= xa AND ms <= xs AND mu <= xu AS knew_causal, a_wall >= m_wall AS knew_wall, count(*) AS n FROM pr GROUP BY 1, 2")
def clock_skew_disagreement(t):
    return V.skew_disagreement(pairs(t))


@query("causal_known", CV_SQL + """ SELECT x.conv_id, x.turn, (SELECT count(*) FROM pr WHERE pr.conv_id = x.conv_id AND pr.a_turn = x.turn AND ma <= xa AND ms <= xs AND mu <= xu) AS known FROM c x""")
def causal_known(t):
    """How many of its conversation's memories does each turn know?"""
    said = t.raw("conversations").groupBy("conv_id", F.sha2("text", 256).alias("memory_id")).agg(F.min("turn").alias("turn")).select("conv_id", "turn", F.lit(True).alias("memory"))
    held = clocks(t).join(said, ["conv_id", "turn"], "left")
    return V.known_before(held, F.coalesce("memory", F.lit(False)), ROLES).select("conv_id", "turn", "known")


@query("clock_skew_all", CV_SQL + " SELECT m.a <= x.a AND m.s <= x.s AND m.u <= x.u AS knew_causal, x.wall >= m.wall AS knew_wall, count(*) AS n FROM c m JOIN c x ON m.conv_id = x.conv_id GROUP BY 1, 2")
def clock_skew_all(t):
    """The disagreement matrix with every turn as a memory, from running counts."""
    return V.skew_counts(materialise(clocks(t).select("conv_id", "turn", "role", "clock", "wall")), F.lit(True), ROLES)


@query("causal_known_all", CV_SQL + """ SELECT x.conv_id, x.turn, (SELECT count(*) FROM c m WHERE m.conv_id = x.conv_id AND m.a <= x.a AND m.s <= x.s AND m.u <= x.u) AS known FROM c x""")
def causal_known_all(t):
    """Every turn is a memory; how many does each turn know?"""
    return V.known_before(clocks(t), F.lit(True), ROLES).select("conv_id", "turn", "known")


SEG = 4
LEVELS = 8
def _hash_sql(seq: str, prev: str, event: str, payload: str, clock: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in (f"({seq})::VARCHAR", prev, event, payload, clock)) + ")"


ZERO = "repeat('0', 64)"
LED_SQL = f"""le AS (SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY ts, record_id) - 1 AS seq, 'ingest' AS event, to_json({{'content': content, 'label': label, 'record_id': record_id}})::VARCHAR AS payload, agent_id || ':' || (d + 1) AS clock FROM rec),
  hc AS (SELECT chain_id, seq, payload, {ZERO} AS prev_hash, {_hash_sql('seq', ZERO, 'event', 'payload', 'clock')} AS hash FROM le WHERE seq % {SEG} = 0
    UNION ALL SELECT le.chain_id, le.seq, le.payload, hc.hash, {_hash_sql('le.seq', 'hc.hash', 'le.event', 'le.payload', 'le.clock')} FROM hc JOIN le ON le.chain_id = hc.chain_id AND le.seq = hc.seq + 1 WHERE le.seq % {SEG} <> 0)"""


def _levels_sql() -> str:
    """Levels one above the other, each with the chains that still have several segments; the head is that of the highest."""
    out = [f"s0 AS (SELECT chain_id, seq // {SEG} AS seg, arg_max(hash, seq) AS h FROM hc GROUP BY 1, 2)"]
    fold = _hash_sql("split_part(x, '|', 1)", "p", "'segment'", "split_part(x, '|', 2)", "NULL::VARCHAR")
    for i in range(1, LEVELS):
        out.append(f"""g{i} AS (SELECT chain_id, seg // {SEG} AS sg, list(seg || '|' || h ORDER BY seg) AS items FROM s{i - 1} WHERE chain_id IN (SELECT chain_id FROM s{i - 1} GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2),
  s{i} AS (SELECT chain_id, sg AS seg, list_reduce(list_prepend({ZERO}, items), lambda p, x: {fold}) AS h FROM g{i})""")
    tops = " UNION ALL ".join(f"SELECT chain_id, {i} AS level, arg_max(h, seg) AS h FROM s{i} GROUP BY 1" for i in range(LEVELS))
    return ",\n  ".join(out) + f",\n  tp AS (SELECT chain_id, arg_max(h, level) AS head FROM ({tops}) GROUP BY 1)"


def entries(t):
    return t.rec.select("chain_id", "ts", "record_id", F.lit("ingest").alias("event"), json_of("record_id", "content", "label").alias("payload"),
                        F.concat("agent_id", F.lit(":"), (F.col("d") + 1).cast("string")).alias("clock"))


def ledger(t):
    return L.build(entries(t), "chain_id", ["ts", "record_id"], "to_date(ts)", SEG)


@query("ledger_build", with_views("rec", LED_SQL + " SELECT chain_id, seq, prev_hash, hash FROM hc", recursive=True))
def ledger_build(t):
    return ledger(t)[0].select("chain_id", "seq", "prev_hash", "hash")


@query("ledger_head", with_views("rec", LED_SQL + ",\n  " + _levels_sql() + " SELECT chain_id, head, (SELECT count(*) FROM le WHERE le.chain_id = tp.chain_id) AS length FROM tp", recursive=True))
def ledger_head(t):
    return L.chain_heads(*ledger(t), "chain_id")


@query("ledger_append", with_views("rec", LED_SQL + ",\n  " + _levels_sql() + " SELECT chain_id, head, (SELECT count(*) FROM le WHERE le.chain_id = tp.chain_id) AS length FROM tp", recursive=True))
def ledger_append(t):
    """The first half of the calendar is built and stored, the rest appended from the stored heads: the same head as in one go."""
    e = entries(t)
    old = F.col("ts") < "2024-01-16"
    linked, heads = (materialise(x) for x in L.build(e.filter(old), "chain_id", ["ts", "record_id"], "to_date(ts)", SEG))
    return L.chain_heads(*L.append(linked, heads, e.filter(~old), "chain_id", ["ts", "record_id"], "to_date(ts)", SEG), "chain_id")


@query("ledger_verify", with_views("rec", """le AS (SELECT chain_id, record_id, row_number() OVER (PARTITION BY chain_id ORDER BY ts, record_id) - 1 AS seq FROM rec) SELECT chain_id, min(seq) FILTER (record_id % 397 = 0) AS first_bad_seq, count(*) FILTER (record_id % 397 = 0) = 0 AS ok FROM le GROUP BY 1"""))
def ledger_verify(t):
    """Some payloads are altered after the chain was built; verification must find the first."""
    built, heads = (materialise(x) for x in ledger(t))
    stored = materialise(L.chain_heads(built, heads, "chain_id"))
    rid = F.get_json_object("payload", "$.record_id").cast("long")
    tampered = built.withColumn("payload", F.when(rid % 397 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return L.verify(tampered, heads, stored, "chain_id", SEG).select("chain_id", "ok", "first_bad_seq")


@query("ledger_missing_segment", with_views("rec", f"""le AS (SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY ts, record_id) - 1 AS seq FROM rec), n AS (SELECT chain_id, max(seq) // {SEG} AS last_seg FROM le GROUP BY 1)
  SELECT chain_id, NOT (chain_id % 3 = 0 AND last_seg >= 2 OR chain_id % 3 = 1 AND last_seg >= 1) AS ok FROM n"""))
def ledger_missing_segment(t):
    """Every third chain loses its second segment with the row above it, every other third its last one with the row above:
    neither may verify, and the untouched chains must."""
    built, heads = (materialise(x) for x in ledger(t))
    stored = materialise(L.chain_heads(built, heads, "chain_id"))
    last = built.groupBy(F.col("chain_id").alias("lc")).agg(F.max("seg").alias("last_seg"))
    m = F.col("chain_id") % 3
    gone = lambda at: ((m == 0) & (F.col("last_seg") >= 2) & (at == 1)) | ((m == 1) & (F.col("last_seg") >= 1) & (at == F.col("last_seg")))          # noqa: E731
    cut = lambda df, at: df.join(last, F.col("chain_id") == F.col("lc")).filter(~gone(at)).select(*df.columns)          # noqa: E731
    upper = cut(heads.filter("level = 1"), F.col("seq")).unionByName(heads.filter("level > 1"))
    return L.verify(cut(built, F.col("seg")), upper, stored, "chain_id", SEG).select("chain_id", "ok")


@query("ledger_events", with_views("rec", "SELECT chain_id, count(*) AS n FROM rec WHERE label = 'bad' GROUP BY 1"))
def ledger_events(t):
    built, _ = ledger(t)
    return built.filter((F.col("event") == "ingest") & (F.get_json_object("payload", "$.label") == "bad")).groupBy("chain_id").agg(F.count("*").alias("n"))


@query("run_identity", "SELECT count(*) AS n_a, count(*) AS n_b, 0::BIGINT AS only_a, 0::BIGINT AS only_b, true AS same_digest FROM events")
def run_identity(t):
    """The closed form and the per-tick fold (with an expiry beyond the calendar) must agree row by row."""
    a = C.outcomes(t.rec, C.promotion_ticks(t.rec, C.TUNED))
    b = C.ttl_outcomes(t.rec.repartition(13), C.ttl_states(t.rec.repartition(13), replace(C.TUNED, ttl=1000)))
    return L.run_identity(a, b, ["record_id", "outcome"])


@query("table_diff", """WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 83 = 0 THEN NULL ELSE p_name END AS p_name, p_brand, CASE WHEN p_partkey % 97 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 89 <> 0)
  SELECT a.p_partkey, '(row)' AS "column", 'present' AS a, NULL AS b FROM part a WHERE p_partkey % 89 = 0
  UNION ALL SELECT a.p_partkey, 'p_name', a.p_name, b.p_name FROM part a JOIN b USING (p_partkey) WHERE a.p_name IS DISTINCT FROM b.p_name UNION ALL SELECT a.p_partkey, 'p_size', a.p_size::VARCHAR, b.p_size::VARCHAR FROM part a JOIN b USING (p_partkey) WHERE a.p_size IS DISTINCT FROM b.p_size""")
def table_diff(t):
    a = t.raw("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    b = (a.filter("p_partkey % 89 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 83 != 0, F.col("p_name")))
         .withColumn("p_size", F.when(F.col("p_partkey") % 97 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_retailprice", F.col("p_retailprice") + 1))
    return L.table_diff(a, b, ["p_partkey"], ignore=["p_retailprice"])


@query("state_roundtrip", with_views("rec", LED_SQL + """, pmx AS (SELECT chain_id, loc, min(d) AS d FROM (SELECT chain_id, loc, d, count(*) OVER w AS e, dense_rank() OVER (PARTITION BY chain_id, loc ORDER BY input_hash) AS i FROM rec WHERE label = 'bad' WINDOW w AS (PARTITION BY chain_id, loc ORDER BY d)) GROUP BY 1, 2 HAVING max(e) >= 2 AND max(i) >= 2)
  SELECT 'ledger' AS name, count(*) AS n, count(DISTINCT hash) AS distinct_values FROM hc UNION ALL SELECT 'promotions', count(*), count(DISTINCT chain_id || '/' || loc) FROM pmx""", recursive=True))
def state_roundtrip(t):
    path = scratch_dir(t.spark)
    config = C.TUNED.digest()
    built, heads = ledger(t)
    state.save_state({"promotions": C.promotion_ticks(t.rec, C.TUNED), "ledger": built, "ledger_heads": heads}, config, path)
    back = state.load_state(t.spark, ["promotions", "ledger"], config, path, segment=SEG)
    values = (back["promotions"].select(F.lit("promotions").alias("name"), F.concat(F.col("chain_id").cast("string"), F.lit("/"), "loc").alias("v"))
              .unionByName(back["ledger"].select(F.lit("ledger").alias("name"), F.col("hash").alias("v"))))
    return values.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("v").alias("distinct_values"))
