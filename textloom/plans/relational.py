"""Tasks, dashboards, paging, dedup, upserts and joins over the given tables.

Roles: ``orders`` are tasks (P queued, O running, F succeeded; priority as file extension), ``benchmark`` lines are the
memory, ``documents`` lines are segments, ``events`` are versioned keys, ``customer`` and ``supplier`` are users.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import core
from textloom.plans import query
from textloom.sources import termbases

TASKS_SQL = "SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS created_at, o_orderstatus AS status, o_orderpriority AS ext FROM orders"


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def tasks(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("ext"))


def n(c, name):
    return F.coalesce(F.count_if(c), F.lit(0)).cast("bigint").alias(name)


@query("w1_queue_position", f"SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM ({TASKS_SQL}) WHERE status = 'P'")
def w1(spark, d):
    return core.day_rank(tasks(spark, d).where("status = 'P'"), "created_at", "id").select("id", "position")


DURATION_SQL = "SELECT id, created_at, status, epoch(updated_at) - epoch(created_at) AS seconds FROM (SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderstatus AS status, max(l_shipdate) AS updated_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_orderstatus)"


def durations(spark, d):
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("updated_at"))
    secs = F.unix_timestamp(F.col("updated_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return tasks(spark, d).join(done, "id").withColumn("seconds", secs.cast("double"))


@query("w5_wait_estimate", f"""
WITH q AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM ({TASKS_SQL}) WHERE status = 'P'),
a AS (SELECT avg(seconds) AS s FROM (SELECT seconds FROM ({DURATION_SQL}) WHERE status = 'F' ORDER BY created_at DESC, id DESC LIMIT 50))
SELECT id, position, CASE WHEN position <= 2 THEN 0 WHEN s IS NULL THEN NULL ELSE trunc(ceil((position - 2) / 4.0) * s)::BIGINT END AS wait_seconds FROM q, a""")
def w5(spark, d):
    last = durations(spark, d).where("status = 'F'").orderBy(F.desc("created_at"), F.desc("id")).limit(50).agg(F.avg("seconds").alias("s"))
    q = core.day_rank(tasks(spark, d).where("status = 'P'"), "created_at", "id").select("id", "position")
    # one row of statistics meets the queue; its size is one row by construction
    return q.join(F.broadcast(last)).select("id", "position", core.wait_seconds(F.col("position"), F.lit(4), F.lit(2), F.col("s")).cast("bigint").alias("wait_seconds"))


@query("a1_dashboard_counts", f"SELECT count(*) AS total, count(*) FILTER (status = 'F') AS succeeded, count(*) FILTER (status = 'O') AS running, count(*) FILTER (status = 'P') AS queued, count(DISTINCT owner) AS owners FROM ({TASKS_SQL})")
def a1(spark, d):
    return tasks(spark, d).agg(F.count("*").alias("total"), n(F.col("status") == "F", "succeeded"), n(F.col("status") == "O", "running"), n(F.col("status") == "P", "queued"), F.countDistinct("owner").alias("owners"))


@query("a2_counts_by_extension", f"SELECT ext, count(*) AS tasks FROM ({TASKS_SQL}) GROUP BY ext")
def a2(spark, d):
    return tasks(spark, d).groupBy("ext").agg(F.count("*").alias("tasks"))


@query("a3_week_trend", """
WITH m AS (SELECT max(ts)::DATE AS last FROM events), s AS (SELECT last - i::INTEGER AS day FROM m, range(0, 7) r(i))
SELECT strftime(day, '%Y-%m-%d') AS day, count(event_id) AS events FROM s LEFT JOIN events ON ts >= day AND ts < day + INTERVAL 1 DAY GROUP BY 1""")
def a3(spark, d):
    ev = table(spark, d, "events")
    spine = ev.agg(F.max(F.to_date("ts")).alias("last")).select(F.explode(F.sequence(F.date_sub("last", 6), F.col("last"))).alias("day"))
    per = ev.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    return spine.join(per, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("events", F.lit(0)).alias("events"))


@query("a4_average_duration", f"SELECT nullif(round_even(avg(seconds), 1), 0) AS avg_seconds FROM ({DURATION_SQL}) WHERE status = 'F'")
def a4(spark, d):
    return durations(spark, d).where("status = 'F'").agg(F.nullif(F.bround(F.avg("seconds"), 1), F.lit(0.0)).alias("avg_seconds"))


@query("a5_recent_average", f"SELECT avg(seconds) AS avg_seconds FROM (SELECT seconds FROM ({DURATION_SQL}) WHERE status = 'F' ORDER BY created_at DESC, id DESC LIMIT 50)")
def a5(spark, d):
    return durations(spark, d).where("status = 'F'").orderBy(F.desc("created_at"), F.desc("id")).limit(50).agg(F.avg("seconds").alias("avg_seconds"))


@query("a6_page_count", f"SELECT count(*) AS total FROM ({TASKS_SQL}) WHERE status <> 'P' AND ext ILIKE '%high%'")
def a6(spark, d):
    return tasks(spark, d).where((F.col("status") != "P") & F.col("ext").ilike("%high%")).agg(F.count("*").alias("total"))


@query("a7_distinct_domains", "SELECT DISTINCT p_brand AS domain FROM part WHERE p_brand IS NOT NULL")
def a7(spark, d):
    return table(spark, d, "part").where("p_brand is not null").select(F.col("p_brand").alias("domain")).distinct()


@query("a8_language_pairs", "SELECT coalesce(lang, '') || '→zh' AS lang_pair, count(*) AS docs FROM documents GROUP BY 1")
def a8(spark, d):
    return table(spark, d, "documents").groupBy(F.concat(F.coalesce("lang", F.lit("")), F.lit("→zh")).alias("lang_pair")).agg(F.count("*").alias("docs"))


@query("a12_capacity", f"SELECT count(*) FILTER (status = 'O') AS running, 4 - count(*) FILTER (status = 'O') AS free FROM ({TASKS_SQL})")
def a12(spark, d):
    running = F.count_if(F.col("status") == "O").cast("bigint")
    return tasks(spark, d).agg(running.alias("running"), (4 - running).alias("free"))


@query("a13_circuit_breaker", """
SELECT event_id, fails, done, fails >= 5 AND fails * 1.0 / (done + fails) > 0.4 AS tripped FROM (
  SELECT event_id, sum((event_type = 'error')::INT) OVER w::BIGINT AS fails, count(*) OVER w AS done FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def a13(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    fails, done = F.sum((F.col("event_type") == "error").cast("bigint")).over(w), F.count("*").over(w)
    return table(spark, d, "events").select("event_id", fails.alias("fails"), done.alias("done"), ((fails >= 5) & (fails / (done + fails) > 0.4)).alias("tripped"))


@query("a15_reconcile_counters", f"SELECT count(*) AS scanned, count(*) FILTER (status = 'O' AND created_at < TIMESTAMP '1995-01-01') AS requeued, count(*) FILTER (status = 'P' AND created_at < TIMESTAMP '1995-01-01') AS touched FROM ({TASKS_SQL})")
def a15(spark, d):
    old = F.col("created_at") < F.expr("timestamp_ntz'1995-01-01'")
    return tasks(spark, d).agg(F.count("*").alias("scanned"), n((F.col("status") == "O") & old, "requeued"), n((F.col("status") == "P") & old, "touched"))


@query("a16_conflict_list", "SELECT array_to_string(list_sort(list(DISTINCT c_name))[1:100], ',') AS names FROM customer WHERE c_acctbal < 0")
def a16(spark, d):
    # the report's cap is a feature: the first hundred distinct names, found by a top-k and not by gathering all
    names = table(spark, d, "customer").where("c_acctbal < 0").select("c_name").distinct().orderBy("c_name").limit(100)
    return names.agg(F.array_join(F.array_sort(F.collect_list("c_name")), ",").alias("names"))


@query("a17_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents")
def a17(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.octet_length(t).cast("bigint").alias("bytes"))


@query("a18_untranslated_cells", "SELECT a.conv_id, count(*) AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text = b.text AND regexp_matches(a.text, '[A-Za-z]') GROUP BY a.conv_id")
def a18(spark, d):
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(after, ["conv_id", "turn"]).where((F.col("text") == F.col("other")) & F.col("text").rlike("[A-Za-z]")).groupBy("conv_id").agg(F.count("*").alias("same"))


@query("a19_account_inventory", "SELECT c_nationkey AS nation, count(*) AS accounts, min(c_name) AS first_name, max(c_name) AS last_name, count(*) FILTER (c_acctbal > 0) AS active FROM customer GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("accounts"), F.min("c_name").alias("first_name"), F.max("c_name").alias("last_name"), n(F.col("c_acctbal") > 0, "active"))


@query("p1_optional_filters", f"SELECT id, owner FROM ({TASKS_SQL}) WHERE status = 'F' AND ext = '1-URGENT'")
def p1(spark, d):
    t = tasks(spark, d)
    for c, v in {"status": "F", "ext": "1-URGENT", "owner": ""}.items():
        t = t.where(F.col(c) == v) if v else t
    return t.select("id", "owner")


@query("p2_keyword_search", r"SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a_e%' ESCAPE '\'")
def p2(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%a_e%")).select("p_partkey", "p_name")


@query("p3_any_column_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%12%' OR p_brand ILIKE '%12%' OR p_type ILIKE '%12%'")
def p3(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%12%") | F.col("p_brand").ilike("%12%") | F.col("p_type").ilike("%12%")).select("p_partkey")


@query("p4_pair_affixes", "SELECT doc_id, lang || '→zh' AS pair FROM documents WHERE lang || '→zh' LIKE '%→zh' AND lang || '→zh' LIKE 'en→%'")
def p4(spark, d):
    pair = F.concat("lang", F.lit("→zh"))
    return table(spark, d, "documents").where(pair.endswith("→zh") & pair.startswith("en→")).select("doc_id", pair.alias("pair"))


@query("p5_allow_list", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup')")
def p5(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup")).select("event_id")


@query("p6_time_range", "WITH m AS (SELECT max(ts)::DATE AS day FROM events) SELECT event_id, ts FROM events, m WHERE ts >= day AND ts < day + INTERVAL 1 DAY")
def p6(spark, d):
    ev = table(spark, d, "events")
    last = ev.agg(F.max(F.to_date("ts")).alias("day"))
    return ev.join(F.broadcast(last), F.to_date("ts") == F.col("day")).select("event_id", "ts")


@query("p7_null_safe_exclusion", "SELECT p_partkey FROM part WHERE p_brand IS DISTINCT FROM 'Brand#11'")
def p7(spark, d):
    return table(spark, d, "part").where(~F.col("p_brand").eqNullSafe(F.lit("Brand#11"))).select("p_partkey")


@query("p9_visible_rows", f"SELECT id FROM ({TASKS_SQL}) WHERE owner = (SELECT min(owner) FROM ({TASKS_SQL})) AND status <> 'P'")
def p9(spark, d):
    t = tasks(spark, d)
    return t.join(F.broadcast(t.agg(F.min("owner").alias("me"))), F.col("owner") == F.col("me")).where("status <> 'P'").select("id")


@query("p10_read_model", f"SELECT id, CASE status WHEN 'P' THEN 'queued' WHEN 'O' THEN 'running' ELSE 'succeeded' END AS status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM ({TASKS_SQL})")
def p10(spark, d):
    name = F.when(F.col("status") == "P", "queued").when(F.col("status") == "O", "running").otherwise("succeeded")
    return tasks(spark, d).select("id", name.alias("status"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


USER_SQL = "SELECT c_custkey AS id, c_acctbal > 0 AS employed, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS override FROM customer"


def users(spark, d):
    m = F.col("c_custkey") % 3
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("employed"), F.when(m == 1, True).when(m == 2, False).alias("override"))


@query("p11_effective_active", f"SELECT id, coalesce(override, employed) AS active, CASE WHEN override IS NULL THEN '' WHEN override THEN 'forced on' ELSE 'forced off' END AS label FROM ({USER_SQL})")
def p11(spark, d):
    label = F.when(F.col("override").isNull(), "").when(F.col("override"), "forced on").otherwise("forced off")
    return users(spark, d).select("id", F.coalesce("override", "employed").alias("active"), label.alias("label"))


@query("p14_emptiness", "SELECT EXISTS (SELECT 1 FROM orders) AS has_orders, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS has_negative")
def p14(spark, d):
    o = table(spark, d, "orders")
    there = lambda df, name: df.select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias(name))  # noqa: E731  one row of each answers
    return there(o, "has_orders").join(F.broadcast(there(o.where("o_totalprice < 0"), "has_negative")))


@query("p16_preserved_users", f"SELECT id FROM ({USER_SQL}) WHERE override IS NOT NULL OR employed")
def p16(spark, d):
    return users(spark, d).where(F.col("override").isNotNull() | F.col("employed")).select("id")


@query("p18_invalid_rows", "SELECT event_id, CASE WHEN try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'k is no number' WHEN value < 0 THEN 'negative value' END AS violation FROM events")
def p18(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").select("event_id", F.when(k.isNull(), "k is no number").when(F.col("value") < 0, "negative value").alias("violation"))


@query("o1_page", f"SELECT id, created_at FROM ({TASKS_SQL}) ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def o1(spark, d):
    return tasks(spark, d).orderBy(F.desc("created_at"), F.desc("id")).offset(40).limit(20).select("id", "created_at")


@query("o2_allowed_sort", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def o2(spark, d):
    column = {"price": "p_retailprice", "name": "p_name"}.get("price", "p_partkey")
    return table(spark, d, "part").orderBy(F.desc(column), "p_partkey").limit(50).select("p_partkey", "p_retailprice")


@query("o3_latest", "SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def o3(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("o7_null_and_enum_order", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_name) AS place FROM supplier")
def o7(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last("s_acctbal"), "s_name")
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("o8_overflow_guard", "SELECT count(*) > 1000 AS too_many FROM (SELECT 1 FROM orders LIMIT 1001)")
def o8(spark, d):
    return table(spark, d, "orders").select("o_orderkey").limit(1001).agg((F.count("*") > 1000).alias("too_many"))


@query("o9_prefix_caps", "SELECT doc_id, left(text, 8000) AS head, least(n_chars, 8000)::BIGINT AS chars FROM documents")
def o9(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(8000)).alias("head"), F.least("n_chars", F.lit(8000)).cast("bigint").alias("chars"))


@query("w2_ranked_duplicates", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_type = 'error'), value, ts DESC, event_id) AS r FROM events) WHERE r > 1")
def w2(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("event_type") == "error", "value", F.desc("ts"), "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r > 1").select("event_id")


@query("w3_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, length(event_type), event_type, event_id")
def w3(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.struct(F.length("event_type"), "event_type", "event_id")).alias("m")).select("user_id", "m.event_id", "m.event_type")


@query("w4_keep_latest_conflicts", """
WITH r AS (SELECT *, row_number() OVER w AS r, first_value(event_id) OVER w AS kept_id, first_value(value) OVER w AS kept_value, first_value(props) OVER w AS kept_props FROM events
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC))
SELECT kept_id, event_id AS dropped_id, array_to_string(list_filter([CASE WHEN value IS DISTINCT FROM kept_value THEN 'value' END, CASE WHEN props IS DISTINCT FROM kept_props THEN 'props' END], lambda x: x IS NOT NULL), ',') AS fields FROM r WHERE r > 1""")
def w4(spark, d):
    ev = table(spark, d, "events")
    kept = ev.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value", "props")).alias("k"))
    both = ev.join(kept, ["user_id", "event_type"]).where("event_id <> k.event_id")
    fields = F.concat_ws(",", F.when(~F.col("value").eqNullSafe(F.col("k.value")), "value"), F.when(~F.col("props").eqNullSafe(F.col("k.props")), "props"))
    return both.select(F.col("k.event_id").alias("kept_id"), F.col("event_id").alias("dropped_id"), fields.alias("fields"))


@query("w6_name_suffix", "SELECT s_suppkey, CASE WHEN r = 0 THEN base ELSE base || '_' || r END || '.txt' AS name FROM (SELECT s_suppkey, 'n' || s_nationkey AS base, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier)")
def w6(spark, d):
    base = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return table(spark, d, "supplier").select("s_suppkey", F.concat(base, F.when(r == 0, "").otherwise(F.concat(F.lit("_"), r.cast("string"))), F.lit(".txt")).alias("name"))


@query("w10_last_write_wins", "SELECT conv_id, role, max_by(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def w10(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))


@query("d1_term_upsert", """
WITH b AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, min(event_id) AS id FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
n AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, min(event_id) AS id FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(b.user_id, n.user_id) AS user_id, coalesce(b.event_type, n.event_type) AS event_type, CASE WHEN n.user_id IS NULL THEN b.value ELSE n.value END AS value, coalesce(b.id, n.id) AS id
FROM b FULL JOIN n ON b.user_id = n.user_id AND b.event_type = n.event_type""")
def d1(spark, d):
    last = lambda p: table(spark, d, "events").where(F.col("event_id") % 2 == p).groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.min("event_id").alias("id"))
    return core.upsert(last(0), last(1), ["user_id", "event_type"], ["value"], keep_old=["id"])


@query("d3_compare_and_set", """
WITH r AS (SELECT l_orderkey AS id, l_linestatus AS expected, l_suppkey % 3 AS attempt, CASE WHEN l_returnflag = 'R' THEN 'F' ELSE 'O' END AS new FROM lineitem WHERE l_linenumber = 1)
SELECT o_orderkey AS id, CASE WHEN expected = o_orderstatus AND attempt = o_custkey % 3 THEN new ELSE o_orderstatus END AS status, coalesce(expected = o_orderstatus AND attempt = o_custkey % 3, false) AS accepted
FROM orders LEFT JOIN r ON id = o_orderkey""")
def d3(spark, d):
    """A request changes a task only from the state that it expects and under the attempt that it knows."""
    requests = table(spark, d, "lineitem").where("l_linenumber = 1").select(
        F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("expected"), (F.col("l_suppkey") % 3).alias("attempt"), F.when(F.col("l_returnflag") == "R", "F").otherwise("O").alias("new"))
    held = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 3).alias("attempt"))
    return core.compare_and_set(held, requests).select("id", "status", "accepted")


@query("d5_bulk_delete", "SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM (SELECT event_id AS gone FROM events WHERE event_type = 'error') WHERE gone = event_id)")
def d5(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type")
    return ev.select("event_id").join(ev.where("event_type = 'error'").select("event_id"), "event_id", "left_anti")


@query("d6_soft_delete", "SELECT event_id, CASE WHEN value < 10 THEN 'deleted' ELSE event_type END AS status FROM events")
def d6(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") < 10, "deleted").otherwise(F.col("event_type")).alias("status"))


@query("d7_retention_purge", f"WITH m AS (SELECT max(created_at) - INTERVAL 365 DAY AS cutoff FROM ({TASKS_SQL})) SELECT count(*) FILTER (status = 'F') AS scanned, count(*) FILTER (status = 'F' AND created_at < cutoff) AS deleted FROM ({TASKS_SQL}), m")
def d7(spark, d):
    t = tasks(spark, d)
    cut = t.agg((F.max("created_at") - F.expr("INTERVAL 365 DAYS")).alias("cutoff"))
    done = F.col("status") == "F"
    return t.join(F.broadcast(cut)).agg(n(done, "scanned"), n(done & (F.col("created_at") < F.col("cutoff")), "deleted"))


@query("d10_exclusive_activation", "SELECT p_partkey, p_partkey = max_by(p_partkey, (p_retailprice, p_partkey)) OVER (PARTITION BY p_brand) AS is_active FROM part")
def d10(spark, d):
    p = table(spark, d, "part")
    best = p.groupBy("p_brand").agg(F.max(F.struct("p_retailprice", "p_partkey")).alias("m"))
    return p.join(best, "p_brand").select("p_partkey", (F.col("p_partkey") == F.col("m.p_partkey")).alias("is_active"))


TERMS_SQL = """SELECT p_partkey AS id, p_brand || p_size % 7 AS source_term, split_part(p_name, ' ', 1) AS target_term, CASE WHEN p_partkey % 9 = 0 THEN 'en→zh' ELSE 'zh→en' END AS lang_pair,
CASE WHEN p_size < 15 THEN '法学' ELSE p_type END AS domain, CASE WHEN p_size % 2 = 0 THEN 'strict' ELSE 'preferred' END AS priority, p_retailprice AS updated_at FROM part"""


@query("d12_reverse_dedup", f"""
WITH t0 AS ({TERMS_SQL}), t AS (SELECT id, CASE WHEN lang_pair = 'en→zh' THEN target_term ELSE source_term END AS source_term, CASE WHEN lang_pair = 'en→zh' THEN source_term ELSE target_term END AS target_term, lang_pair, domain, priority, updated_at FROM t0),
k AS (SELECT *, row_number() OVER (PARTITION BY source_term ORDER BY CASE WHEN domain = '法学' THEN 1 ELSE 0 END, CASE WHEN priority = 'strict' THEN 0 ELSE 1 END, length(target_term), updated_at DESC, id) AS rn FROM t WHERE lang_pair = 'zh→en'),
r AS (SELECT *, row_number() OVER (PARTITION BY target_term ORDER BY length(source_term), priority, id) AS n FROM k WHERE rn > 1)
SELECT id, source_term, target_term, lang_pair, domain, priority, false AS reversed FROM t WHERE id NOT IN (SELECT id FROM k WHERE rn > 1)
UNION ALL SELECT id, target_term, source_term, 'en→zh', domain, priority, true FROM r WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.lang_pair = 'en→zh' AND t.source_term = r.target_term)""")
def d12(spark, d):
    p = table(spark, d, "part")
    back = F.col("p_partkey") % 9 == 0
    zh, en = F.concat("p_brand", (F.col("p_size") % 7).cast("string")), F.split_part("p_name", F.lit(" "), F.lit(1))
    t = p.select(
        F.col("p_partkey").alias("id"), F.when(back, en).otherwise(zh).alias("source_term"), F.when(back, zh).otherwise(en).alias("target_term"), F.when(back, "en→zh").otherwise("zh→en").alias("lang_pair"),
        F.when(F.col("p_size") < 15, "法学").otherwise(F.col("p_type")).alias("domain"), F.when(F.col("p_size") % 2 == 0, "strict").otherwise("preferred").alias("priority"), F.col("p_retailprice").alias("updated_at"),
    )
    return core.reverse_dedup(t, "zh→en", "en→zh").drop("updated_at")


@query("d23_override_backfill", f"SELECT id, CASE WHEN employed IS DISTINCT FROM override THEN employed END AS active_override FROM ({USER_SQL})")
def d23(spark, d):
    return users(spark, d).select("id", F.when(~F.col("employed").eqNullSafe(F.col("override")), F.col("employed")).alias("active_override"))


@query("j5_left_lookup", "SELECT l_orderkey, l_linenumber, o_orderpriority AS file FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'")
def j5(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("file"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left")


@query("j6_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j6(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j7_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j7(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("j8_three_way", "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def j8(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey").join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("l_orderkey", "l_linenumber", "c_name")


@query("j9_concept_pairs", """
WITH t AS (SELECT n_regionkey AS concept, n_nationkey AS pos, n_name AS term, ['en', 'zh', 'fr'][n_nationkey % 3 + 1] AS code FROM nation WHERE n_regionkey <> 3 OR n_nationkey % 3 <> 1),
h AS (SELECT concept, arg_min(term, pos) AS f, arg_min(code, pos) AS fc, min(pos) AS fp, arg_min(term, pos) FILTER (code = 'zh') AS z, count(*) FILTER (code <> 'zh') AS o FROM t GROUP BY concept)
SELECT concept::VARCHAR AS concept, CASE WHEN z IS NOT NULL AND o > 0 THEN z ELSE f END AS source_term, term AS target_term, CASE WHEN z IS NOT NULL AND o > 0 THEN 'zh' ELSE fc END || '→' || code AS lang_pair
FROM t JOIN h USING (concept) WHERE CASE WHEN z IS NOT NULL AND o > 0 THEN code <> 'zh' ELSE pos > fp END""")
def j9(spark, d):
    """The first Chinese term of a concept with each term of another language; without both, the first with each later one."""
    lang = F.element_at(F.array(F.lit("en"), F.lit("zh"), F.lit("fr")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    terms = table(spark, d, "nation").where("n_regionkey <> 3 or n_nationkey % 3 <> 1").select(
        F.lit("n").alias("path"), F.col("n_regionkey").cast("string").alias("concept"), F.col("n_nationkey").alias("pos"), lang.alias("lang"), F.col("n_name").alias("term"))
    return termbases.term_pairs(terms).select("concept", "source_term", "target_term", "lang_pair")


@query("j10_positional_zip", """
WITH u AS (SELECT conv_id, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant'),
z AS (SELECT u.conv_id, u.t AS s, CASE WHEN position(chr(10) IN a.t) > 0 THEN trim(substr(a.t, position(chr(10) IN a.t) + 1)) ELSE a.t END AS t FROM u JOIN a ON u.conv_id = a.conv_id AND u.r = a.r WHERE length(u.t) >= 8)
SELECT conv_id, count(*) FILTER (NOT (length(t) < 4 OR t = s)) AS imported, count(*) FILTER (length(t) < 4 OR t = s) AS skipped FROM z GROUP BY conv_id""")
def j10(spark, d):
    turn = lambda role: table(spark, d, "conversations").where(F.col("role") == role).select("conv_id", F.trim("text").alias(role), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("r"))
    z = turn("user").join(turn("assistant"), ["conv_id", "r"]).where(F.length("user") >= 8)
    at = F.locate("\n", F.col("assistant"))
    t = F.when(at > 0, F.trim(F.substring(F.col("assistant"), at + 1, F.length("assistant")))).otherwise(F.col("assistant"))
    bad = (F.length("t") < 4) | (F.col("t") == F.col("user"))
    return z.withColumn("t", t).groupBy("conv_id").agg(n(~bad, "imported"), n(bad, "skipped"))


ACCOUNT_SQL = """SELECT CASE WHEN c_custkey = 7 THEN 'admin' ELSE 'u' || c_custkey END AS username, CASE WHEN c_custkey % 5 = 0 THEN 'local' ELSE 'oa' END AS auth_source, CASE WHEN c_custkey % 10 <> 0 THEN 'o' || c_custkey END AS oa_id,
c_name AS display_name, c_mktsegment AS department, c_acctbal > 0 AS oa_employed, CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 2 = 0 END AS active_override, c_acctbal > 500 AS is_active FROM customer"""
EMPLOYEE_SQL = """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 501 = 0 THEN 'admin' WHEN o_orderkey % 777 = 0 THEN ' ' WHEN o_orderkey % 11 = 0 THEN ' u' || (o_custkey + 1000000) ELSE 'u' || o_custkey END AS login,
CASE WHEN o_orderkey % 13 > 0 THEN 'o' || CASE WHEN o_orderkey % 17 = 0 THEN o_custkey % 50 + 1 ELSE o_custkey END END AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS name,
CASE WHEN o_orderkey % 4 > 0 THEN 'BUILDING' END AS department, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS status, CASE WHEN o_orderkey % 6 > 0 THEN '在职' ELSE '离职' END AS service FROM orders"""


@query("j11_directory_merge", f"""
WITH u AS ({ACCOUNT_SQL}), e0 AS (SELECT *, trim(login) AS l FROM ({EMPLOYEE_SQL})), e1 AS (SELECT * FROM e0 WHERE l <> ''),
e AS (SELECT l, min(ord) AS first, arg_max({{'id': id, 'name': name, 'department': department, 'status': status, 'service': service}}, ord) AS x FROM e1 GROUP BY l),
m AS (SELECT l, first, x.id AS id, x.name AS name, x.department AS department, x.status = 'A' AND x.service = '在职' AS employed, u.* FROM e LEFT JOIN u ON u.username = l),
c AS (SELECT m.*, CASE WHEN l = 'admin' THEN 'reserved' WHEN m.username IS NOT NULL AND m.auth_source <> 'oa' AND m.oa_id IS NULL THEN 'local' END AS bad, o.username AS holder FROM m LEFT JOIN u o ON o.oa_id = m.id),
f AS (SELECT *, CASE WHEN bad IS NULL AND id IS NOT NULL AND holder IS NULL THEN row_number() OVER (PARTITION BY bad, id, holder ORDER BY first) END AS turn FROM c)
SELECT l AS login, CASE WHEN bad IS NOT NULL THEN 'conflict_' || bad WHEN holder <> l OR turn > 1 THEN 'conflict_bound' WHEN username IS NULL THEN 'insert'
WHEN auth_source <> 'oa' OR (name IS NOT NULL AND name <> '' AND display_name IS DISTINCT FROM name) OR (department IS NOT NULL AND f.department IS DISTINCT FROM own_department) OR (id IS NOT NULL AND oa_id IS DISTINCT FROM id)
OR oa_employed IS DISTINCT FROM employed OR is_active IS DISTINCT FROM coalesce(active_override, employed) THEN 'update' ELSE 'unchanged' END AS action, employed FROM (SELECT * EXCLUDE (department_1), department_1 AS own_department FROM f) f""")
def j11(spark, d):
    """Orders as a directory's employees (later rows stand for their login), customers as the accounts."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    accounts = c.select(
        F.when(k == 7, "admin").otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("username"), F.when(k % 5 == 0, "local").otherwise("oa").alias("auth_source"), F.when(k % 10 != 0, F.concat(F.lit("o"), k.cast("string"))).alias("oa_id"),
        F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("department"), (F.col("c_acctbal") > 0).alias("oa_employed"), F.when(k % 11 == 0, k % 2 == 0).alias("active_override"), (F.col("c_acctbal") > 500).alias("is_active"))
    o, who = F.col("o_orderkey"), F.col("o_custkey")
    employees = table(spark, d, "orders").select(
        o.alias("ord"), F.when(o % 501 == 0, "admin").when(o % 777 == 0, " ").when(o % 11 == 0, F.concat(F.lit(" u"), (who + 1_000_000).cast("string"))).otherwise(F.concat(F.lit("u"), who.cast("string"))).alias("login"),
        F.when(o % 13 > 0, F.concat(F.lit("o"), F.when(o % 17 == 0, who % 50 + 1).otherwise(who).cast("string"))).alias("id"), F.when(o % 3 > 0, F.concat(F.lit("Customer#"), F.lpad(who.cast("string"), 9, "0"))).alias("name"),
        F.when(o % 4 > 0, "BUILDING").alias("department"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("status"), F.when(o % 6 > 0, "在职").otherwise("离职").alias("service"))
    return core.directory_merge(accounts, employees).select("login", "action", "employed")


BOX_SQL = "SELECT vec_id, label AS page, least(embedding[1], embedding[3])::DOUBLE AS x1, least(embedding[2], embedding[4])::DOUBLE AS y1, greatest(embedding[1], embedding[3])::DOUBLE AS x2, greatest(embedding[2], embedding[4])::DOUBLE AS y2 FROM embeddings"


@query("j13_spatial_anti_join", f"""
WITH b AS ({BOX_SQL}), t AS (SELECT * FROM b WHERE vec_id % 50 = 7)
SELECT vec_id FROM b WHERE vec_id % 50 <> 7 AND NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND (b.x2 - b.x1) * (b.y2 - b.y1) > 0
  AND greatest(0, least(b.x2, t.x2) - greatest(b.x1, t.x1)) * greatest(0, least(b.y2, t.y2) - greatest(b.y1, t.y1)) > (b.x2 - b.x1) * (b.y2 - b.y1) * 0.5)""")
def j13(spark, d):
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    b = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("page"), F.least(e[0], e[2]).alias("x1"), F.least(e[1], e[3]).alias("y1"), F.greatest(e[0], e[2]).alias("x2"), F.greatest(e[1], e[3]).alias("y2"))
    role = F.col("vec_id") % 50 == 7
    return core.overlap_anti_join(b.where(~role), b.where(role)).select("vec_id")


@query("j14_range_exclusion", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_brand AS sheet, min(p_size) AS lo, (min(p_size) + max(p_size)) // 2 AS hi FROM part GROUP BY 1) r WHERE r.sheet = p.p_brand AND p.p_size BETWEEN lo AND hi AND p.p_type LIKE '%STEEL%')")
def j14(spark, d):
    p = table(spark, d, "part")
    r = p.groupBy(F.col("p_brand").alias("sheet")).agg(F.min("p_size").alias("lo"), F.floor((F.min("p_size") + F.max("p_size")) / 2).alias("hi"))
    return p.join(r, (F.col("sheet") == F.col("p_brand")) & F.col("p_size").between(F.col("lo"), F.col("hi")) & F.col("p_type").contains("STEEL"), "left_anti").select("p_partkey")


@query("j15_prioritised_lookup", "SELECT n_nationkey, coalesce(max(s_name), max(c_name), 'default') AS config FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def j15(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("s"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_name").alias("c"))
    return table(spark, d, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("s", "c", F.lit("default")).alias("config"))


@query("j16_integrity", "SELECT (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS orphan_lines, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS orphan_orders")
def j16(spark, d):
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count("*").alias("orphan_lines"))
    orders = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.count("*").alias("orphan_orders"))
    return lines.join(F.broadcast(orders))


@query("u1_union_all", "SELECT c_name AS source, c_mktsegment AS target FROM customer UNION ALL SELECT c_mktsegment, c_name FROM customer")
def u1(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_name").alias("source"), F.col("c_mktsegment").alias("target")).unionByName(c.select(F.col("c_mktsegment").alias("source"), F.col("c_name").alias("target")))


@query("u2_first_source_wins", "SELECT nation, arg_min(name, ord) AS name FROM (SELECT s_nationkey AS nation, s_name AS name, s_suppkey AS ord FROM supplier UNION ALL SELECT c_nationkey, c_name, 1000000000 + c_custkey FROM customer) GROUP BY nation")
def u2(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), (F.col("c_custkey") + 1_000_000_000).alias("ord"))
    return s.unionByName(c).groupBy("nation").agg(F.min_by("name", "ord").alias("name"))


@query("u4_key_differences", "SELECT 'customer' AS side, k FROM (SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'supplier', k FROM (SELECT DISTINCT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer)")
def u4(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).select(F.lit("customer").alias("side"), "k").unionByName(s.subtract(c).select(F.lit("supplier").alias("side"), "k"))


@query("t3_last_heartbeat", "SELECT user_id, max(ts) AS last_seen, (SELECT max(ts) FROM events) - INTERVAL 120 SECOND > max(ts) AS stale FROM events GROUP BY user_id")
def t3(spark, d):
    ev = table(spark, d, "events")
    now = ev.agg(F.max("ts").alias("now"))
    return ev.groupBy("user_id").agg(F.max("ts").alias("last_seen")).join(F.broadcast(now)).select("user_id", "last_seen", (F.col("now") - F.expr("INTERVAL 120 SECONDS") > F.col("last_seen")).alias("stale"))


@query("t4_reconcile_states", """
WITH l AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS state, max(ts) AS seen FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN state = 'view' AND seen < now - INTERVAL 120 SECOND THEN 'queued' WHEN state = 'click' AND seen < now - INTERVAL 15 MINUTE THEN 'requeued' WHEN state = 'signup' AND seen < now - INTERVAL 15 MINUTE THEN 'failed' ELSE state END AS state FROM l, m""")
def t4(spark, d):
    ev = table(spark, d, "events")
    last = ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("seen"))
    now = ev.agg(F.max("ts").alias("now"))
    old = lambda x: F.col("seen") < F.col("now") - F.expr(f"INTERVAL {x}")
    s = F.col("state")
    new = F.when((s == "view") & old("120 SECONDS"), "queued").when((s == "click") & old("15 MINUTES"), "requeued").when((s == "signup") & old("15 MINUTES"), "failed").otherwise(s)
    return last.join(F.broadcast(now)).select("user_id", new.alias("state"))


@query("t9_late_arrivals", "SELECT event_id, abs(epoch(ts) - epoch((SELECT max(ts) FROM events))) > 300 AS rejected FROM events")
def t9(spark, d):
    ev = table(spark, d, "events")
    now = ev.agg(F.max("ts").alias("now"))
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return ev.join(F.broadcast(now)).select("event_id", (F.abs(secs("ts") - secs("now")) > 300).alias("rejected"))
