"""Chains of requests, names that must be free, cascades, constraints, typed rows and feedback over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import typed
from textloom.operators import chains, core, integrity
from textloom.plans import SQL, query
from textloom.plans.relational import table
from textloom.plans.texts import w8
from textloom.storage import checkpoint_folder


@query("d3_request_chains", """
WITH RECURSIVE r AS (
  SELECT l_orderkey AS id, l_linenumber::BIGINT AS seq, l_linestatus AS expected, (l_suppkey % 2)::VARCHAR AS attempt, CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'A' THEN 'P' ELSE 'O' END AS new,
         CASE WHEN l_partkey % 3 > 0 THEN (l_partkey % 2)::VARCHAR END AS new_attempt FROM lineitem
), q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, expected, attempt, new, new_attempt NULLS FIRST) AS n FROM r), s AS (
  SELECT o_orderkey AS id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BOOLEAN AS accepted, o_orderstatus AS status, (o_custkey % 2)::VARCHAR AS attempt FROM orders WHERE o_custkey % 20 > 0
  UNION ALL
  SELECT s.id, q.n, q.seq, s.status IS NOT DISTINCT FROM q.expected AND s.attempt IS NOT DISTINCT FROM q.attempt,
         CASE WHEN s.status IS NOT DISTINCT FROM q.expected AND s.attempt IS NOT DISTINCT FROM q.attempt THEN new ELSE status END,
         CASE WHEN s.status IS NOT DISTINCT FROM q.expected AND s.attempt IS NOT DISTINCT FROM q.attempt THEN new_attempt ELSE s.attempt END
  FROM s JOIN q ON q.id = s.id AND q.n = s.n + 1
)
SELECT id, seq, accepted, status, attempt FROM s WHERE n > 0
UNION ALL SELECT l_orderkey, l_linenumber::BIGINT, false, NULL, NULL FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 20 = 0""")
def d3_chains(spark, d):
    """An order's lines ask, one after the other, for another status under an attempt; every twentieth customer's are unknown."""
    new = F.when(F.col("l_returnflag") == "R", "F").when(F.col("l_returnflag") == "A", "P").otherwise("O")
    requests = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), F.col("l_linestatus").alias("expected"), (F.col("l_suppkey") % 2).alias("attempt"),
        new.alias("new"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 2).alias("new_attempt"),
    )
    held = table(spark, d, "orders").where("o_custkey % 20 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 2).alias("attempt"))
    return chains.request_chains(held, requests)


@query("w7_sheet_titles", r"""
WITH RECURSIVE t AS (
  SELECT lang AS book, doc_id AS idx, 'Sheet' || doc_id % 50 AS original, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN ' History ' WHEN 2 THEN '[' || left(text, 1) || ']?' ELSE left(text, (doc_id * 7 % 60)::INT) END AS title FROM documents
), c AS (SELECT *, trim(left(regexp_replace(regexp_replace(regexp_replace(title, '^\s+|\s+$', '', 'g'), '[\\/*?:\[\]]', '_', 'g'), '^''+|''+$', '', 'g'), 31), ' ' || chr(10) || chr(9)) AS bare FROM t),
b AS (SELECT book, idx, CASE WHEN bare = '' OR lower(bare) = 'history' THEN original ELSE bare END AS base, row_number() OVER (PARTITION BY book ORDER BY idx) AS r FROM c WHERE title <> ''),
f AS (
  SELECT book, idx, base AS final, r, [lower(base)] AS taken FROM b WHERE r = 1
  UNION ALL
  SELECT book, idx, final, r, list_append(taken, lower(final)) FROM (
    SELECT b.book, b.idx, b.r, f.taken, CASE WHEN NOT list_contains(f.taken, lower(base)) THEN base
      ELSE list_filter(list_transform(range(2, len(f.taken) + 3), lambda n: left(base, 31 - length('_' || n)) || '_' || n), lambda x: NOT list_contains(f.taken, lower(x)))[1] END AS final
    FROM f JOIN b ON b.book = f.book AND b.r = f.r + 1)
)
SELECT book, idx, final FROM f UNION ALL SELECT book, idx, original FROM t WHERE title = ''""")
def w7(spark, d):
    """Documents as sheets of a workbook a language, named by the beginnings of their texts."""
    k = F.col("doc_id") % 9
    title = F.when(k == 0, "").when(k == 1, " History ").when(k == 2, F.concat(F.lit("["), F.left("text", F.lit(1)), F.lit("]?"))).otherwise(F.left("text", (F.col("doc_id") * 7 % 60).cast("int")))
    sheets = table(spark, d, "documents").select(F.col("lang").alias("book"), F.col("doc_id").alias("idx"), title.alias("title"), F.concat(F.lit("Sheet"), (F.col("doc_id") % 50).cast("string")).alias("original"))
    return chains.sheet_titles(sheets)


@query("d2_memory_upsert", """
WITH b AS (SELECT user_id, max_by(value, (ts, event_id)) AS value, max_by(event_type, (ts, event_id)) AS domain, min_by(event_id, (ts, event_id)) AS id FROM events WHERE event_id % 2 = 0 GROUP BY 1),
e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 7 > 0 THEN value END AS value, CASE WHEN value > 50 AND event_type <> 'error' THEN event_type END AS domain FROM events WHERE event_id % 2 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last FROM e),
n AS (SELECT user_id, max(value) FILTER (last = 1) AS value, max(event_id) FILTER (first = 1) AS id, arg_max(domain, (ts, event_id)) FILTER (domain IS NOT NULL) AS domain FROM o GROUP BY 1)
SELECT coalesce(b.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN b.value ELSE n.value END AS value, coalesce(n.domain, b.domain) AS domain, coalesce(b.id, n.id) AS id FROM b FULL JOIN n ON b.user_id = n.user_id""")
def d2(spark, d):
    """A batch of raw events: a user's rows are merged in order, one kind of column a rule."""
    ev, order = table(spark, d, "events"), ["ts", "event_id"]
    base = chains.fold_batch(ev.where("event_id % 2 = 0").select("user_id", "ts", "event_id", "value", F.col("event_type").alias("domain"), F.col("event_id").alias("id")), ["user_id"], order, ["value", "domain"], keep_old=["id"])
    own = F.when((F.col("value") > 50) & (F.col("event_type") != "error"), F.col("event_type"))
    raw = ev.where("event_id % 2 = 1").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"), own.alias("domain"), F.col("event_id").alias("id"))
    batch = chains.fold_batch(raw, ["user_id"], order, ["value"], keep_old_if_null=["domain"], keep_old=["id"])
    return core.upsert(base, batch, ["user_id"], ["value"], keep_old_if_null=["domain"], keep_old=["id"])


@query("g3_chunk_schedule", f"""
WITH w AS ({SQL["w8_chunk_packing"]}), b AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id) > 30000 AS big FROM w)
SELECT doc_id, chunk, CASE WHEN big THEN doc_id::VARCHAR ELSE doc_id || ':' || chunk END AS lane, CASE WHEN big THEN row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 ELSE 0 END AS turn,
  CASE WHEN big THEN lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk) END AS after FROM b""")
def g3(spark, d):
    """When each chunk may go: large documents in order, small ones at once."""
    return chains.chunk_schedule(w8(spark, d).select("doc_id", "chunk", F.col("chars").alias("size")))


@query("j16_cascades", """
WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 100 = 7 UNION SELECT p_partkey FROM part JOIN p ON p_partkey // 3 = p.k),
c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'part' AS name, p_partkey AS key, p_partkey // 3 AS ref FROM part WHERE p_partkey NOT IN (SELECT k FROM p)
UNION ALL SELECT 'orders', o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber, CASE WHEN l_partkey NOT IN (SELECT k FROM p) THEN l_partkey END FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'events', event_id, CASE WHEN user_id NOT IN (SELECT c_custkey FROM c) THEN user_id END FROM events""")
def j16_cascades(spark, d):
    """Customers in debt and some parts go: their orders and lines, and parts of parts, go with them; lines and events lose references."""
    tables = {
        "customer": table(spark, d, "customer").select("c_custkey", "c_acctbal"), "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        "lineitem": table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_orderkey", "l_partkey"),
        "events": table(spark, d, "events").select("event_id", "user_id"), "part": table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 3).alias("whole")),
    }
    links = [
        integrity.Link("orders", "o_custkey", "customer", "c_custkey", "cascade"), integrity.Link("lineitem", "l_orderkey", "orders", "o_orderkey", "cascade"),
        integrity.Link("events", "user_id", "customer", "c_custkey", "null"), integrity.Link("part", "whole", "part", "p_partkey", "cascade"), integrity.Link("lineitem", "l_partkey", "part", "p_partkey", "null"),
    ]
    roots = {"customer": tables["customer"].where("c_acctbal < 0"), "part": tables["part"].where("p_partkey % 100 = 7")}
    left = integrity.delete_along(tables, {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line", "events": "event_id", "part": "p_partkey"}, links, roots)
    shown = [("part", "p_partkey", "whole"), ("orders", "o_orderkey", "o_custkey"), ("lineitem", "line", "l_partkey"), ("events", "event_id", "user_id")]
    out = [left[name].select(F.lit(name).alias("name"), F.col(key).alias("key"), F.col(ref).alias("ref")) for name, key, ref in shown]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("d19_bundle_violations", """
SELECT 'unique' AS kind, 'customer' AS "table", 'c_nationkey,c_mktsegment' AS columns, '{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS value, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1
UNION ALL SELECT 'single', 'part', 'p_brand', '{"p_brand":"' || p_brand || '"}', count(*) FILTER (p_size > 45) FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size > 45) > 1
UNION ALL SELECT 'reference', 'events', 'user_id', '{"user_id":' || user_id || '}', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id
UNION ALL SELECT 'distribution', 'nation', 'n_regionkey', '{"n_regionkey":"' || n_regionkey || '"}', count(*) FROM nation GROUP BY n_regionkey HAVING n_regionkey > 0 OR count(*) <> 5
UNION ALL SELECT 'distribution', 'nation', 'n_regionkey', '{"n_regionkey":"9"}', 0
UNION ALL SELECT 'check', 'orders', 'o_orderstatus', '{"o_orderstatus":"' || o_orderstatus || '"}', count(*) FROM orders WHERE NOT (o_orderstatus IN ('F', 'O')) GROUP BY o_orderstatus""")
def d19(spark, d):
    """A bundle's rules on the given tables: keys, one active row a type, references, a distribution, and a check."""
    tables = {name: table(spark, d, name) for name in ("customer", "part", "events", "nation", "orders")}
    return integrity.violations(tables, [
        integrity.Constraint("unique", "customer", ("c_nationkey", "c_mktsegment")), integrity.Constraint("single", "part", ("p_brand",), "p_size > 45"),
        integrity.Constraint("reference", "events", ("user_id",), parent=("customer", "c_custkey")), integrity.Constraint("distribution", "nation", ("n_regionkey",), expected={"0": 5, "9": 1}),
        integrity.Constraint("check", "orders", ("o_orderstatus",), "o_orderstatus IN ('F', 'O')"),
    ])


RAW_SQL = """SELECT o_orderkey AS k, CASE WHEN k % 11 = 0 THEN left(h, 30) WHEN k % 4 = 0 THEN u WHEN k % 4 = 1 THEN upper(h) WHEN k % 4 = 2 THEN '{' || u || '}' ELSE 'urn:uuid:' || u END AS id,
['true', ' TRUE ', '0', 'no', ''][k % 5 + 1] AS flag, ['', '1', 'maybe'][k % 3 + 1] AS choice, CASE k % 6 WHEN 0 THEN s || 'Z' WHEN 1 THEN replace(s, 'T', ' ') || '+02:00' WHEN 2 THEN s WHEN 3 THEN '2020-13-01T00:00:00Z' WHEN 4 THEN '' ELSE s || '.25-05:30' END AS stamp, o_orderpriority AS kind
FROM (SELECT o_orderkey, o_orderkey AS k, o_orderpriority, md5(o_orderkey::VARCHAR) AS h, regexp_replace(md5(o_orderkey::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS u, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS s FROM orders)"""


@query("p18_typed_rows", f"""
WITH r AS ({RAW_SQL}), x AS (SELECT *, replace(trim(replace(lower(id), 'urn:uuid:', ''), '{{}}'), '-', '') AS h, lower(trim(flag)) AS f, try_cast(CASE WHEN stamp LIKE '%Z' OR right(stamp, 6) LIKE '_%:__' AND left(right(stamp, 6), 1) IN ('+', '-') THEN stamp END AS TIMESTAMPTZ) AS t FROM r),
e AS (SELECT *, concat_ws(',', CASE WHEN length(h) <> 32 THEN 'id:uuid' END, CASE WHEN flag = '' THEN 'flag:empty' WHEN f NOT IN ('true', '1', 'false', '0') THEN 'flag:bool' END, CASE WHEN choice = 'maybe' THEN 'choice:bool' END,
  CASE WHEN stamp = '' THEN 'stamp:empty' WHEN k % 6 = 2 THEN 'stamp:zone' WHEN t IS NULL THEN 'stamp:time' END, CASE WHEN kind NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'kind:enum' END) AS errors FROM x)
SELECT k, errors, CASE WHEN length(h) = 32 THEN regexp_replace(h, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') ELSE '' END AS id, CASE WHEN f IN ('true', '1') THEN 'true' WHEN f IN ('false', '0') THEN 'false' ELSE '' END AS flag,
  CASE choice WHEN '1' THEN 'true' ELSE '' END AS choice, coalesce(strftime(t AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(t AT TIME ZONE 'UTC') % 1000000 <> 0 THEN strftime(t AT TIME ZONE 'UTC', '.%f') ELSE '' END || '+00:00', '') AS stamp,
  CASE WHEN kind IN ('1-URGENT', '2-HIGH', '5-LOW') THEN kind ELSE '' END AS kind FROM e""")
def p18_typed(spark, d):
    """Text rows of five kinds of fields, well formed and not, parsed strictly and written canonically with their errors."""
    k = F.col("k")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    dashed = F.regexp_replace("h", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    name = F.when(k % 11 == 0, F.left("h", F.lit(30))).when(k % 4 == 0, dashed).when(k % 4 == 1, F.upper("h")).when(k % 4 == 2, F.concat(F.lit("{"), dashed, F.lit("}"))).otherwise(F.concat(F.lit("urn:uuid:"), dashed))
    s = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    at = F.when(k % 6 == 0, F.concat(s, F.lit("Z"))).when(k % 6 == 1, F.concat(F.regexp_replace(s, "T", " "), F.lit("+02:00"))).when(k % 6 == 2, s).when(k % 6 == 3, "2020-13-01T00:00:00Z").when(k % 6 == 4, "").otherwise(F.concat(s, F.lit(".25-05:30")))
    raw = table(spark, d, "orders").withColumn("k", F.col("o_orderkey")).withColumn("h", F.md5(k.cast("string").cast("binary")))
    raw = raw.select("k", name.alias("id"), pick(5, "true", " TRUE ", "0", "no", "").alias("flag"), pick(3, "", "1", "maybe").alias("choice"), at.alias("stamp"), F.col("o_orderpriority").alias("kind"))
    fields = {"id": typed.Field("uuid"), "flag": typed.Field("bool"), "choice": typed.Field("bool", False), "stamp": typed.Field("time"), "kind": typed.Field("enum", values=("1-URGENT", "2-HIGH", "5-LOW"))}
    codes = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["column"], e["code"])), ",")
    return typed.parse(raw, fields).select("k", codes.alias("errors"), *(typed.canonical(F.col(c), f.kind).alias(c) for c, f in fields.items()))


@query("d14_feedback", """
WITH f AS (SELECT conv_id, turn, lower(split_part(text, ' ', 1)) AS w, text FROM conversations WHERE role = 'user' AND conv_id % 3 = 0),
bt AS (SELECT lower(split_part(text, ' ', 1)) AS key, arg_min('preferred:T ' || item_id, item_id) AS value FROM benchmark GROUP BY 1), nt AS (SELECT w AS key, arg_max('strict:' || conv_id || '.' || turn, (conv_id, turn)) AS value FROM f WHERE turn % 2 = 0 AND w <> '' GROUP BY 1),
bm AS (SELECT lower(text) AS key, arg_max('import:' || item_id, item_id) AS value FROM benchmark GROUP BY 1), nm AS (SELECT lower(text) AS key, arg_max('feedback:' || conv_id || '.' || turn, (conv_id, turn)) AS value FROM f WHERE turn % 4 <> 0 GROUP BY 1)
SELECT 'term' AS name, coalesce(bt.key, nt.key) AS key, coalesce(nt.value, bt.value) AS value FROM bt FULL JOIN nt ON bt.key = nt.key
UNION ALL SELECT 'memory', coalesce(bm.key, nm.key), coalesce(nm.value, bm.value) FROM bm FULL JOIN nm ON bm.key = nm.key
UNION ALL SELECT 'feedback', conv_id || '.' || turn, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'adopted' ELSE 'open' END FROM conversations""")
def d14(spark, d):
    """Adopted feedback goes into terms, memory and its own status; readers see all three or none."""
    at = F.concat_ws(".", "conv_id", "turn")
    fb = table(spark, d, "conversations").withColumn("adopted", (F.col("role") == "user") & (F.col("conv_id") % 3 == 0))
    f = fb.where("adopted").select("conv_id", "turn", F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("w"), F.lower("text").alias("text"), at.alias("at"))
    bench = table(spark, d, "benchmark")
    one = lambda df, key, value: df.select(F.col(key).alias("key"), value.alias("value"), "conv_id", "turn")
    newest = lambda df: chains.fold_batch(df, ["key"], ["conv_id", "turn"], ["value"])
    terms = bench.groupBy(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("key")).agg(F.min("item_id").alias("i")).select("key", F.concat(F.lit("preferred:T "), F.col("i")).alias("value"))
    memory = bench.groupBy(F.lower("text").alias("key")).agg(F.max("item_id").alias("i")).select("key", F.concat(F.lit("import:"), F.col("i")).alias("value"))
    new_terms = newest(one(f.where("turn % 2 = 0 AND w <> ''"), "w", F.concat(F.lit("strict:"), F.col("at"))))
    new_memory = newest(one(f.where("turn % 4 <> 0"), "text", F.concat(F.lit("feedback:"), F.col("at"))))
    folder = f"{checkpoint_folder(spark)}/feedback-{uuid.uuid4().hex}"
    integrity.publish(folder, {
        "term": core.upsert(terms, new_terms, ["key"], ["value"]), "memory": core.upsert(memory, new_memory, ["key"], ["value"]),
        "feedback": fb.select(at.alias("key"), F.when(F.col("adopted"), "adopted").otherwise("open").alias("value")),
    })
    out = [df.select(F.lit(name).alias("name"), "key", "value") for name, df in sorted(integrity.published(spark, folder).items())]
    return out[0].unionByName(out[1]).unionByName(out[2])
