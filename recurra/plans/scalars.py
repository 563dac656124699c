"""Scalar-function queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, digest, keys, text as X
from ..operators.embedding import sparse_hash_embedding
from .bindings import class_sql, file_sql, with_views
from .registry import query

WS_SQL = "' '||chr(9)||chr(13)||chr(10)"
TOK_SQL = r"list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]'), lambda x: lower(x))"


@query("content_digest", with_views("rec", "SELECT record_id, sha256(to_json({'content': content, 'label': label, 'record_id': record_id})) AS id FROM rec"))
def content_digest(t):
    return t.rec.select("record_id", digest.content_digest("record_id", "content", "label").alias("id"))


@query("issue_head", f"""SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS_SQL})), lambda x: x <> '')[1],1,200),'') AS head FROM documents""")
def issue_head(t):
    return t.raw("documents").select("doc_id", X.first_line(F.col("text")).alias("head"))


PART_CONTENT_SQL = """SELECT p_partkey, p_name || ' => ' || replace(replace(lower(p_type) || '/' || p_brand || '.py', '/', ' / '), '.py', '')
  || CASE WHEN p_size % 2 = 0 THEN ' # S' || p_size ELSE '' END || ' :: size ' || p_size AS content FROM part"""


def _part_content(t):
    return t.raw("part").select("p_partkey", X.record_content(
        F.col("p_name"), F.concat(F.lower("p_type"), F.lit("/"), F.col("p_brand"), F.lit(".py")),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("S"), F.col("p_size").cast("string"))), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("content"))


@query("record_content", PART_CONTENT_SQL)
def record_content(t):
    return _part_content(t)


@query("location_of", with_views("rec", f"""u AS (SELECT 'p' || p_partkey AS id, content FROM ({PART_CONTENT_SQL}) UNION ALL SELECT 'e' || record_id, content FROM rec UNION ALL SELECT 'd' || doc_id, text FROM documents)
  SELECT id, nullif(trim(regexp_extract(content, '=> (.+?) ::', 1)), '') AS location FROM u"""))
def location_of(t):
    u = (_part_content(t).select(F.concat(F.lit("p"), "p_partkey").alias("id"), "content")
         .unionByName(t.rec.select(F.concat(F.lit("e"), "record_id").alias("id"), "content"))
         .unionByName(t.raw("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("content"))))
    return u.select("id", X.location_in(F.col("content")).alias("location"))


@query("clean_message", f"""WITH d AS (SELECT doc_id, text || ' (#' || doc_id || ')' AS subject, 'Signed-off-by: a' || chr(10) || text || chr(10) || ' Reviewed-By: b' AS body FROM documents),
  e AS (SELECT doc_id, trim(regexp_replace(subject, '\\s*\\(#\\d+\\)\\s*$', ''), {WS_SQL}) AS head,
    trim(array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: rtrim(x, ' ')), lambda x: NOT regexp_matches(trim(x, {WS_SQL}), '^(?i)(co-authored-by|signed-off-by|reviewed-by|see-also):')), chr(10)), {WS_SQL}) AS txt FROM d)
  SELECT doc_id, md5(trim(head || CASE WHEN txt <> '' THEN chr(10) || chr(10) || txt ELSE '' END, {WS_SQL})) AS message_md5 FROM e""")
def clean_message(t):
    subject = F.concat(F.col("text"), F.lit(" (#"), F.col("doc_id").cast("string"), F.lit(")"))
    body = F.concat(F.lit("Signed-off-by: a\n"), F.col("text"), F.lit("\n Reviewed-By: b"))
    return t.raw("documents").select("doc_id", F.md5(X.clean_message(subject, body)).alias("message_md5"))


@query("coerce_list", """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '["a","b' || o_custkey || '",3]' ELSE o_orderpriority END AS v FROM orders)
  SELECT o_orderkey, CASE WHEN coalesce(v,'') = '' THEN [] WHEN v LIKE '[%' THEN from_json(v, '["VARCHAR"]') ELSE [v] END AS items FROM v""")
def coerce_list(t):
    v = (F.when(F.col("o_orderkey") % 4 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 4 == 1, "")
         .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit('["a","b'), F.col("o_custkey").cast("string"), F.lit('",3]'))).otherwise(F.col("o_orderpriority")))
    return t.raw("orders").select("o_orderkey", X.coerce_list(v).alias("items"))


DATE_SQL = r"""CASE WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?([Zz]|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$') THEN try_cast(substr(s,1,10) AS DATE)
    WHEN regexp_matches(s, '^\d{8}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?([Zz]|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$') THEN try_cast(substr(s,1,4) || '-' || substr(s,5,2) || '-' || substr(s,7,2) AS DATE) END"""


@query("parse_dates", r"""WITH s AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts,'%Y-%m-%d') WHEN 1 THEN strftime(ts,'%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S') || '+09:00'
    WHEN 3 THEN 'not a date' WHEN 4 THEN '2024-02-3' || (event_id % 10) WHEN 5 THEN strftime(ts,'%Y%m%d') WHEN 6 THEN strftime(ts,'%Y-%m-%dT%H:%M') || ' rubbish' ELSE NULL END AS s FROM events)
  SELECT event_id, """ + DATE_SQL + " AS day FROM s")
def parse_dates(t):
    m = F.col("event_id") % 8
    s = (F.when(m == 0, F.date_format("ts", "yyyy-MM-dd")).when(m == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
         .when(m == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))).when(m == 3, "not a date")
         .when(m == 4, F.concat(F.lit("2024-02-3"), (F.col("event_id") % 10).cast("string")))
         .when(m == 5, F.date_format("ts", "yyyyMMdd")).when(m == 6, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit(" rubbish"))))
    return t.raw("events").select("event_id", dates.literal_date(s).alias("day"))


@query("cutoff_for", "SELECT event_id, to_timestamp(floor(epoch(ts)))::TIMESTAMP::DATE AS cutoff FROM events")
def cutoff_for(t):
    return t.raw("events").select("event_id", dates.cutoff_from_epoch(F.unix_timestamp("ts")).alias("cutoff"))


@query("key_levels", with_views("ln", f"SELECT DISTINCT fkey, {file_sql('fkey')} AS file_key, {class_sql('fkey')} AS class_key, {file_sql('fkey')} AS dir_key FROM ln"))
def key_levels(t):
    k = F.col("fkey")
    return t.ln.select("fkey").distinct().select("fkey", keys.file_of(k).alias("file_key"), keys.class_of(k).alias("class_key"), keys.dir_of(k).alias("dir_key"))


@query("path_class", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || CASE page_id % 7 WHEN 0 THEN '/tests/x.py' WHEN 1 THEN '/src/a_test.py' WHEN 2 THEN '/test_b.py' WHEN 3 THEN '/lib/c.spec.ts' WHEN 4 THEN '/core/d.py' ELSE '' END AS path FROM pages),
  q AS (SELECT *, lower(path) AS p, string_split(lower(path), '/') AS parts FROM p)
  SELECT page_id, path, (contains(parts[1],'test') OR contains('/'||p,'/tests/') OR contains('/'||p,'/test/') OR contains('/'||p,'/__tests__/') OR contains('/'||p,'/e2e/') OR starts_with(parts[-1],'test_')
     OR suffix(p,'_test.py') OR suffix(p,'conftest.py') OR contains(parts[-1],'.test.') OR contains(parts[-1],'.spec.') OR starts_with(parts[-1],'playwright.config')) AS is_test,
   (len(list_filter(parts[1:len(parts)-1], lambda x: x IN ('test','tests','testing'))) > 0 OR starts_with(parts[-1],'test_') OR suffix(parts[-1],'_test.py') OR parts[-1] = 'conftest.py') AS is_test_strict,
   suffix(path,'.py') AS is_source FROM q""")
def path_class(t):
    m = F.col("page_id") % 7
    extra = (F.when(m == 0, "/tests/x.py").when(m == 1, "/src/a_test.py").when(m == 2, "/test_b.py").when(m == 3, "/lib/c.spec.ts").when(m == 4, "/core/d.py").otherwise(""))
    p = t.raw("pages").select("page_id", F.concat(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), extra).alias("path"))
    c = F.col("path")
    return p.select("page_id", "path", keys.is_test_path(c).alias("is_test"), keys.is_test_path_strict(c).alias("is_test_strict"), keys.has_suffix(c, (".py",)).alias("is_source"))


@query("id_transform", """SELECT p_partkey, lower(replace(id, '__', '_1776_')) AS image, CASE WHEN contains(id,'__') THEN substr(id,1,instr(id,'__')-1) || '/' || substr(id,instr(id,'__')+2) ELSE id END AS grp
  FROM (SELECT p_partkey, p_type || CASE WHEN p_size % 5 = 0 THEN '-' ELSE '__' END || p_brand || '__' || p_partkey AS id FROM part)""")
def id_transform(t):
    i = F.concat(F.col("p_type"), F.when(F.col("p_size") % 5 == 0, "-").otherwise("__"), F.col("p_brand"), F.lit("__"), F.col("p_partkey").cast("string"))
    return t.raw("part").select("p_partkey", keys.image_name(i).alias("image"), keys.group_from_file(i).alias("grp"))


@query("tokens_bigrams", f"""WITH d AS (SELECT doc_id, {TOK_SQL} AS tk FROM documents)
  SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, '|')) AS tokens_md5, greatest(len(tk)-1,0) AS n_bigrams,
    md5(coalesce(array_to_string(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i+1]), '|'),'')) AS bigrams_md5 FROM d""")
def tokens_bigrams(t):
    d = t.raw("documents").select("doc_id", X.tokens(F.col("text")).alias("tk")).withColumn("bg", X.bigrams(F.col("tk")))
    return d.select("doc_id", F.size("tk").alias("n_tokens"), F.md5(F.array_join("tk", "|")).alias("tokens_md5"), F.size("bg").alias("n_bigrams"), F.md5(F.array_join("bg", "|")).alias("bigrams_md5"))


@query("hash_embed", f"""WITH d AS (SELECT doc_id, {TOK_SQL} AS tk FROM documents),
  f AS (SELECT doc_id, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i+1]))) AS f FROM d),
  b AS (SELECT doc_id, ('0x'||substr(md5(f),1,15))::BIGINT % 512 AS bucket, sum(CASE WHEN substr(md5(f),16,1) >= '8' THEN 1 ELSE -1 END) AS v FROM f GROUP BY 1, 2)
  SELECT doc_id, count(*) AS nnz, sum(v*v)::BIGINT AS norm2, sum(bucket*v)::BIGINT AS dot_bucket FROM b WHERE v <> 0 GROUP BY 1""")
def hash_embed(t):
    sparse = sparse_hash_embedding(t.raw("documents"), "doc_id", "text", 512)
    return sparse.groupBy("doc_id").agg(F.count("*").alias("nnz"), F.sum(F.col("v") * F.col("v")).alias("norm2"), F.sum(F.col("bucket") * F.col("v")).alias("dot_bucket"))


SALVAGE_SQL = """r AS (SELECT record_id, '{"files":[{"path":"' || label || '","reason":"r"},{"path":"' || loc || '","reason":"x"}]}' AS full_text FROM rec),
  s AS (SELECT record_id, CASE WHEN record_id % 3 = 0 THEN substr(full_text, 1, length(full_text) - 5 - (record_id % 31)) ELSE full_text END AS resp FROM r)"""


@query("json_salvage", with_views("rec", SALVAGE_SQL + """
  SELECT record_id, NOT json_valid(resp) AS salvaged, CASE WHEN json_valid(resp) THEN array_to_string(json_extract_string(resp, '$.files[*].path'), '|')
    ELSE coalesce(array_to_string(regexp_extract_all(resp, '"path"\\s*:\\s*"([^"\\n]+)"', 1), '|'), '') END AS paths FROM s"""))
def json_salvage(t):
    full = F.concat(F.lit('{"files":[{"path":"'), F.col("label"), F.lit('","reason":"r"},{"path":"'), F.col("loc"), F.lit('","reason":"x"}]}'))
    cut = F.length("full_text") - 5 - (F.col("record_id") % 31).cast("int")
    s = t.rec.select("record_id", full.alias("full_text")).select("record_id", F.when(F.col("record_id") % 3 == 0, F.substring(F.col("full_text"), F.lit(1), cut)).otherwise(F.col("full_text")).alias("resp"))
    return s.select("record_id", *X.ranked_paths(F.col("resp")))


@query("json_salvage_functions", with_views("rec", """r AS (SELECT record_id, '{"functions":[{"path":"' || label || '","qualname":"q' || d || '"},{"path":"' || loc || '","qualname":"x"}]}' AS full_text FROM rec),
  s AS (SELECT record_id, record_id % 3 AS m, label, loc, d, CASE record_id % 3 WHEN 0 THEN substr(full_text, 1, length(full_text) - 3) WHEN 1 THEN 'Here: ```json' || chr(10) || full_text || '```' ELSE '{"note":"none"}' END AS resp FROM r JOIN rec USING (record_id))
  SELECT record_id, m <> 1 AS salvaged, CASE WHEN m = 2 THEN '' ELSE label || '::q' || d || '|' || loc || '::x' END AS paths FROM s"""))
def json_salvage_functions(t):
    """Answers that name functions: broken ones, fenced ones, and valid ones without a list."""
    full = F.concat(F.lit('{"functions":[{"path":"'), F.col("label"), F.lit('","qualname":"q'), F.col("d").cast("string"), F.lit('"},{"path":"'), F.col("loc"), F.lit('","qualname":"x"}]}'))
    m = F.col("record_id") % 3
    s = t.rec.select("record_id", full.alias("f"))
    resp = F.when(m == 0, F.expr("substr(f, 1, length(f) - 3)")).when(m == 1, F.concat(F.lit("Here: ```json\n"), F.col("f"), F.lit("```"))).otherwise('{"note":"none"}')
    return s.select("record_id", *X.ranked_paths(resp))
