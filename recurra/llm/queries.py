"""The registered queries of this folder: each applies its operator to a whole table and derives the contract's columns."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import automaton, grammar, hardneg, langid, lines, mih, mixing, parity, quality, recompress, secrets, topk, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents"))


@query
def op3_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before")))
    n_lines = F.size(F.split(F.coalesce("before", F.lit("")), "\n", -1))
    ends = F.coalesce("runs", F.array().cast("array<int>"))            # first, last, first, last, ...
    gone = F.aggregate(F.transform(ends, lambda x, i: F.when(i % 2 == 1, x + 1).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    return done.select("doc_id", n_lines.alias("n_lines"), gone.alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL["op5_line_dedup"] = lines.SQL


@query
def op6_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


SQL["op6_sainte_lague_mix"] = mixing.SQL


@query
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL["op7_exact_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query
def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.near_duplicates(table(spark, sf_dir, "documents"), width=4, per=85).select("doc_id", "n_shingles", "component_id")


SQL["op8_parity_sketch_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[u.i : u.i + 3], ' ') END AS sh
  FROM w, unnest(range(1, greatest(2, len(ws) - 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON r.reach = b.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) m ON m.node = d.doc_id
"""


@query
def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = automaton.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
                        secrets.joined("spans").alias("spans"), "n_live", "n_copied")


@query
def op11_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digests(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op11_recompression_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
g AS (SELECT doc_id, u.i, array_to_string(ws[u.i : u.i + 49], ' ') AS s FROM w, unnest(range(1, len(ws) - 48)) AS u(i)),
m AS (SELECT s, min(doc_id) AS d FROM g GROUP BY s),
h AS (SELECT DISTINCT doc_id, g.i + u.k AS i FROM g JOIN m USING (s), unnest(range(0, 50)) AS u(k) WHERE m.d < g.doc_id),
c AS (SELECT doc_id, list(i) AS gone FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string([x FOR x, i IN ws IF gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id"""


@query
def op12_hilbert_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL["op12_hilbert_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) p
WHERE rank <= 5"""


@query
def op13_blockmatrix_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
