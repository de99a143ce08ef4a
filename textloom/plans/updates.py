"""Partial updates, older schemas, key-value upserts, and small rules on regions, footnotes, lists and CSV over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import layout
from textloom.operators import chains, core, patches
from textloom.plans import SQL, query
from textloom.plans.relational import USER_SQL, table, users, w4

#: Rounds of refusals that the SQL spells out; the operator goes on until there are none.
ROUNDS = 8
REFUSALS_SQL = "r0 AS (SELECT -1::BIGINT AS id WHERE false)" + "".join(f""",
r{i} AS MATERIALIZED (SELECT id FROM (SELECT id, mv, row_number() OVER (PARTITION BY status, CASE WHEN mv THEN new_slot ELSE slot END ORDER BY mv, CASE WHEN mv THEN turn END, id) AS place
  FROM (SELECT *, moved AND id NOT IN (SELECT id FROM r{i - 1}) AS mv FROM a) WHERE CASE WHEN mv THEN new_slot ELSE slot END IS NOT NULL) WHERE mv AND place > 1 UNION ALL SELECT id FROM r{i - 1})""" for i in range(1, ROUNDS + 1))


@query("d4_partial_updates", f"""
WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS owner, o_orderkey AS slot, o_orderpriority AS note FROM orders),
p AS (SELECT l_orderkey + CASE WHEN l_suppkey % 7 = 0 THEN 1000000000 ELSE 0 END AS id, l_partkey % 6 AS kind, struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey) AS o, l_suppkey, l_linenumber FROM lineitem),
m AS (SELECT id, min(o) AS turn, arg_max(CASE kind WHEN 0 THEN '' ELSE 'n' || l_suppkey END, o) FILTER (kind < 2) AS note, arg_max(CASE kind WHEN 2 THEN l_suppkey * 40 + l_linenumber ELSE -1 END, o) FILTER (kind IN (2, 4)) AS slot, arg_max(l_suppkey, o) FILTER (kind = 4) AS owner FROM p GROUP BY id),
a AS MATERIALIZED (SELECT b.*, m.turn, m.id IS NOT NULL AS touched, CASE WHEN m.slot IS NULL THEN b.slot ELSE nullif(m.slot, -1) END AS new_slot, CASE WHEN m.note IS NULL THEN b.note ELSE nullif(m.note, '') END AS new_note, coalesce(m.owner, b.owner) AS new_owner,
  m.slot IS NOT NULL AND b.slot IS DISTINCT FROM nullif(m.slot, -1) AS moved FROM b LEFT JOIN m ON b.id = m.id),
{REFUSALS_SQL}
SELECT id, status, CASE WHEN no THEN owner ELSE new_owner END AS owner, CASE WHEN no THEN slot ELSE new_slot END AS slot, CASE WHEN no THEN note ELSE new_note END AS note, CASE WHEN no THEN 'conflict' WHEN touched THEN 'applied' END AS outcome
FROM (SELECT *, id IN (SELECT id FROM r{ROUNDS}) AS no FROM a)
UNION ALL SELECT id, NULL, owner, nullif(slot, -1), nullif(note, ''), 'missing' FROM m WHERE id NOT IN (SELECT id FROM b)""")
def d4(spark, d):
    """Requests that set, null or leave out columns of orders; a slot is free or the request is refused."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("slot"), F.col("o_orderpriority").alias("note"))
    kind = F.col("l_partkey") % 6
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    part, slot = text(F.col("l_suppkey")), text(F.col("l_suppkey") * 40 + F.col("l_linenumber"))
    body = (
        F.when(kind == 0, '{"note": null}').when(kind == 1, F.concat(F.lit('{"note": "n'), part, F.lit('"}'))).when(kind == 2, F.concat(F.lit('{"slot": '), slot, F.lit("}")))
        .when(kind == 3, "{}").when(kind == 4, F.concat(F.lit('{"owner": '), part, F.lit(', "slot": null}'))).otherwise("no object")
    )
    who = F.col("l_orderkey") + F.when(F.col("l_suppkey") % 7 == 0, 1000000000).otherwise(0)
    asked = table(spark, d, "lineitem").select(who.alias("id"), "l_linenumber", "l_partkey", "l_suppkey", body.alias("patch"))
    return patches.patched(base, asked, "id", ["l_linenumber", "l_partkey", "l_suppkey"], ["owner", "slot", "note"], ["status", "slot"])


@query("p15_older_schema", "SELECT c_name AS username, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS oa_id, c_acctbal > 9000 AS is_admin, CASE WHEN c_mktsegment = 'BUILDING' THEN 'local' ELSE 'oa' END AS auth_source, true AS oa_employed, NULL::BOOLEAN AS active_override FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000 OR c_name = 'admin'")
def p15(spark, d):
    """Users that an export keeps (local, admin, of the reserved name, or overridden), from a table older than three of its columns."""
    old = table(spark, d, "customer").select(F.col("c_name").alias("username"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("oa_id"), (F.col("c_acctbal") > 9000).alias("is_admin"))
    now = patches.fitted(old, {"username": None, "oa_id": None, "is_admin": None, "auth_source": "CASE WHEN oa_id IS NULL THEN 'local' ELSE 'oa' END", "oa_employed": F.lit(True), "active_override": "CAST(NULL AS BOOLEAN)"})
    return now.where("auth_source = 'local' OR is_admin OR username = 'admin' OR active_override IS NOT NULL")


@query("d9_key_value_upsert", """
WITH n AS (SELECT 'retention.' || user_id AS key, arg_max(struct_pack(v := greatest(0, trunc(value - 60)::BIGINT)::VARCHAR, b := event_type), (ts, event_id)) AS x FROM events GROUP BY 1),
b AS (SELECT 'retention.' || c_custkey AS key, greatest(0, trunc(c_acctbal / 100)::BIGINT)::VARCHAR AS value, c_name AS updated_by FROM customer)
SELECT coalesce(b.key, n.key) AS key, CASE WHEN n.key IS NULL THEN b.value ELSE x.v END AS value, CASE WHEN n.key IS NULL THEN updated_by ELSE x.b END AS updated_by FROM b FULL JOIN n ON b.key = n.key""")
def d9(spark, d):
    """Days of retention, never below zero, kept as text by key; a key's newest request counts."""
    key = lambda c: F.concat(F.lit("retention."), F.col(c)).alias("key")
    days = lambda c: F.greatest(F.lit(0), c.cast("bigint")).cast("string").alias("value")
    base = table(spark, d, "customer").select(key("c_custkey"), days(F.col("c_acctbal") / 100), F.col("c_name").alias("updated_by"))
    asked = table(spark, d, "events").select(key("user_id"), days(F.col("value") - 60), F.col("event_type").alias("updated_by"), "ts", "event_id")
    newest = chains.fold_batch(asked, ["key"], ["ts", "event_id"], ["value", "updated_by"])
    return core.upsert(base, newest, ["key"], ["value", "updated_by"])


@query("d21_csv_lines", r"""
WITH c AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN ';' WHEN 1 THEN ',' ELSE chr(9) END AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM conversations),
q AS (SELECT *, CASE WHEN contains(text, x) OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM c)
SELECT conv_id, turn, CASE WHEN first THEN chr(65279) ELSE '' END || turn || x || role || x || coalesce(cell, '') AS line FROM q""")
def d21(spark, d):
    """Each conversation written back as CSV in its own dialect, a line a turn."""
    c = table(spark, d, "conversations")
    heads = c.groupBy("conv_id").agg(F.min("turn").alias("head"))
    x = F.when(F.col("conv_id") % 3 == 0, ";").when(F.col("conv_id") % 3 == 1, ",").otherwise("\t")
    return c.join(heads, "conv_id").select("conv_id", "turn", layout.csv_line([F.col("turn"), F.col("role"), F.col("text")], x, F.col("turn") == F.col("head")).alias("line"))


NAMED_SQL = "SELECT c_custkey AS id, CASE c_custkey % 50 WHEN 3 THEN 'admin' WHEN 4 THEN 'Admin' ELSE c_name END AS username, c_mktsegment AS oa_id, c_acctbal > 0 AS active FROM customer"


@query("d24_reserved_admin", f"SELECT id, username, CASE WHEN username = 'admin' THEN 'local' ELSE 'oa' END AS auth_source, CASE WHEN username <> 'admin' THEN oa_id END AS oa_id, username = 'admin' AS is_admin, username = 'admin' OR active AS active FROM ({NAMED_SQL})")
def d24(spark, d):
    """Rows of exactly the reserved name become active local admins; other cases of it do not."""
    m = F.col("c_custkey") % 50
    name = F.when(m == 3, "admin").when(m == 4, "Admin").otherwise(F.col("c_name"))
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), name.alias("username"), F.col("c_mktsegment").alias("oa_id"), (F.col("c_acctbal") > 0).alias("active"))
    own = F.col("username") == "admin"
    return named.select("id", "username", F.when(own, "local").otherwise("oa").alias("auth_source"), F.when(~own, F.col("oa_id")).alias("oa_id"), own.alias("is_admin"), (own | F.col("active")).alias("active"))


@query("p8_active_filter", f"WITH u AS (SELECT id, coalesce(override, employed) AS active FROM ({USER_SQL})) SELECT 'active' AS asked, id FROM u WHERE active UNION ALL SELECT 'inactive', id FROM u WHERE NOT active UNION ALL SELECT '', id FROM u")
def p8(spark, d):
    """Users by effective state; an empty request asks for all. One pass deals each row to the requests that it answers."""
    active = F.coalesce("override", "employed")
    asked = F.explode(F.array(F.when(active, "active").otherwise("inactive"), F.lit("")))
    return users(spark, d).select(asked.alias("asked"), "id")


@query("o2_sort_requests", " UNION ALL ".join(f"(SELECT '{asked}' AS asked, row_number() OVER (ORDER BY {order}) AS place, p_partkey FROM part QUALIFY place <= 20)" for asked, order in
                                              (("name asc", "p_name, p_partkey"), ("price desc", "p_retailprice DESC, p_partkey"), ("drop table asc", "p_size, p_partkey"), ("brand DESC", "p_brand DESC, p_partkey"))))
def o2_requests(spark, d):
    """First pages in the order of an allowed column; an unknown one means the default."""
    part, pages = table(spark, d, "part"), []
    for asked in ("name asc", "price desc", "drop table asc", "brand DESC"):
        page = core.sorted_page(part, {"name": "p_name", "price": "p_retailprice", "brand": "p_brand"}, "p_size", *asked.rsplit(" ", 1), "p_partkey", 20)
        pages.append(page.select(F.lit(asked).alias("asked"), "place", "p_partkey"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@query("o10_reading_order", "SELECT l_orderkey, string_agg(l_linenumber || '/' || l_partkey, ' ' ORDER BY l_quantity, l_linenumber, l_partkey) AS regions FROM lineitem GROUP BY 1")
def o10(spark, d):
    """An image's regions from top to bottom, those of one height in their given order; an image has few."""
    region = F.struct("l_quantity", "l_linenumber", "l_partkey")
    shown = lambda r: F.concat_ws("/", r["l_linenumber"], r["l_partkey"])
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(region)), shown), " ").alias("regions"))


@query("u3_ordered_distinct", """
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
f AS (SELECT conv_id, turn, w, min(i) AS i FROM w GROUP BY ALL) SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS ids FROM f GROUP BY ALL""")
def u3(spark, d):
    """Each list of ids without repeats, in the order of their first places."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("ids")).where("ids is not null")


@query("u6_all_conflicts", f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS kept FROM customer)
SELECT 'memory' AS dataset, kept AS kept_id, c_custkey AS dropped_id FROM m WHERE r > 1 UNION ALL SELECT 'term', kept_id, dropped_id FROM ({SQL["w4_keep_latest_conflicts"]})""")
def u6(spark, d):
    """Conflicts of two tables as one list, in the order of table and rows."""
    c, key = table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"]
    kept = c.groupBy(*key).agg(F.max(F.struct("c_acctbal", F.negative("c_custkey").alias("o"), F.col("c_custkey").alias("id"))).alias("k"))
    memory = c.join(kept, key).where("c_custkey <> k.id").select(F.lit("memory").alias("dataset"), F.col("k.id").alias("kept_id"), F.col("c_custkey").alias("dropped_id"))
    return memory.unionByName(w4(spark, d).select(F.lit("term").alias("dataset"), "kept_id", "dropped_id")).orderBy("dataset", "kept_id", "dropped_id")


@query("f30_recogniser_languages", "SELECT doc_id, pair, CASE trim(split_part(pair, '→', 1)) WHEN 'de' THEN 'german' WHEN 'ko' THEN 'korean' WHEN 'ja' THEN 'japan' WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'ru' THEN 'ru' WHEN 'es' THEN 'es' WHEN 'it' THEN 'it' ELSE 'ch' END AS model FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN coalesce(lang, 'x') WHEN 1 THEN coalesce(lang, 'x') || ' →zh' WHEN 2 THEN 'ja→en' ELSE 'tlh→en' END AS pair FROM documents)")
def f30(spark, d):
    lang, m = F.coalesce("lang", F.lit("x")), F.col("doc_id") % 4
    pair = F.when(m == 0, lang).when(m == 1, F.concat(lang, F.lit(" →zh"))).when(m == 2, "ja→en").otherwise("tlh→en")
    return table(spark, d, "documents").select("doc_id", pair.alias("pair")).withColumn("model", layout.recogniser(F.col("pair")))


@query("g6_footnotes", r"""
SELECT conv_id, turn, CASE WHEN o = 'bilingual' AND m = 'skip' OR note = '' OR told = '' THEN note WHEN o = 'bilingual' AND m = 'bilingual' THEN note || chr(10) || told ELSE told END AS note
FROM (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'bilingual' ELSE 'plain' END AS o, ['bilingual', 'translation_only', 'skip'][turn % 3 + 1] AS m, CASE WHEN conv_id % 13 = 0 THEN '' ELSE text END AS note, CASE WHEN conv_id % 11 = 0 THEN '' ELSE 'T ' || text END AS told FROM conversations)""")
def g6(spark, d):
    output = F.when(F.col("conv_id") % 2 == 0, "bilingual").otherwise("plain")
    mode = F.when(F.col("turn") % 3 == 0, "bilingual").when(F.col("turn") % 3 == 1, "translation_only").otherwise("skip")
    note = F.when(F.col("conv_id") % 13 == 0, "").otherwise(F.col("text"))
    told = F.when(F.col("conv_id") % 11 == 0, "").otherwise(F.concat(F.lit("T "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", layout.footnote(note, told, output, mode).alias("note"))


@query("f20_quads", """
WITH p AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: (x::DOUBLE + 0.3) * 100) AS e FROM embeddings),
b AS (SELECT vec_id, greatest(0, least(1, list_min([e[1], e[3], e[5], e[7]]) / 60)) AS x1, greatest(0, least(1, list_min([e[2], e[4], e[6], e[8]]) / 45)) AS y1, greatest(0, least(1, list_max([e[1], e[3], e[5], e[7]]) / 60)) AS x2, greatest(0, least(1, list_max([e[2], e[4], e[6], e[8]]) / 45)) AS y2 FROM p)
SELECT vec_id, x1, y1, x2, y2 FROM b WHERE x2 - x1 >= 0.1 AND y2 - y1 >= 0.1""")
def f20_quads(spark, d):
    """Quads of four points as boxes within the image; boxes that are too small go."""
    at = lambda i: (F.col("embedding")[i].cast("double") + 0.3) * 100
    quad = F.array(*(F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")) for i in range(4)))
    return table(spark, d, "embeddings").select("vec_id", layout.box(quad, F.lit(60), F.lit(45), 0.1).alias("b")).where("b is not null").select("vec_id", "b.*")


@query("a19_account_list", "SELECT c_name AS username, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS place, c_nationkey AS nation FROM customer")
def a19_list(spark, d):
    """Each nation's accounts in the order of their names."""
    w = Window.partitionBy("c_nationkey").orderBy("c_name")
    return table(spark, d, "customer").select(F.col("c_name").alias("username"), F.row_number().over(w).cast("bigint").alias("place"), F.col("c_nationkey").alias("nation"))


@query("p10_model_settings", "SELECT c_custkey AS id, c_mktsegment AS kind, CASE WHEN c_custkey % 3 = 0 THEN false ELSE true END AS has_secret FROM customer")
def p10_models(spark, d):
    """Settings as they are shown: of a secret, only whether there is one."""
    secret = F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, "")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), (F.coalesce(secret, F.lit("")) != "").alias("has_secret"))
