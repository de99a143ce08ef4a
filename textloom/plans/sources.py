"""Charsets, Markdown, bundles, damaged answers, one-time codes and the login limiter over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.json_repair import ocr_items
from textloom.functions.text import strip
from textloom.operators import sheets
from textloom.plans import query
from textloom.plans.relational import table
from textloom.sources import bundle, csv_cells, termbases, text_files
from textloom.storage import checkpoint_folder, cut
from textloom.streaming import limiter


def shared_folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


@query("s5_decoded_texts", "SELECT doc_id, text FROM documents")
def s5(spark, d):
    """Texts as UTF-8 bytes, every other one with a byte order mark, decoded again."""
    raw = F.encode("text", "UTF-8")
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw)
    return text_files.decode_bytes(table(spark, d, "documents").select("doc_id", marked.alias("content"))).select("doc_id", "text")


@query("s7_markdown_blocks", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT *, starts_with(trim(text, ' '), '```') AS fence FROM l),
g AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM f),
p AS (SELECT *, NOT fence AND NOT fenced AND trim(text, ' ') <> '' AS plain FROM g),
s AS (SELECT *, plain AND coalesce(lag(plain) OVER (PARTITION BY doc_id ORDER BY pos), false) AS goes_on FROM p),
b AS (SELECT *, (sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS block FROM s)
SELECT doc_id, block, string_agg(text, chr(10) ORDER BY pos) AS text, bool_or(plain) AS translatable FROM b GROUP BY doc_id, block""")
def s7(spark, d):
    blocks = table(spark, d, "documents").select("doc_id", F.posexplode(text_files.markdown_blocks(F.col("text"))).alias("block", "b"))
    return blocks.select("doc_id", "block", "b.text", "b.translatable")


PART_ROWS_SQL = "SELECT (p_partkey // 1000)::VARCHAR AS path, row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) AS r, p_name, p_type FROM part"


def part_rows(spark, d, *columns):
    """Parts as rows of a thousand a path, numbered from 1 in order of their keys."""
    p = table(spark, d, "part").withColumn("path", F.floor(F.col("p_partkey") / 1000).cast("string"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("p_partkey"))).select("path", "r", *columns)


@query("s8_csv_cells", f"SELECT path, (r - 1)::BIGINT AS \"row\", u.col::BIGINT AS col, u.value FROM (SELECT *, unnest([{{'col': 0, 'value': p_name}}, {{'col': 1, 'value': p_type}}]) AS u FROM ({PART_ROWS_SQL}))")
def s8(spark, d):
    """Lines with semicolons as cells; numbers are no cells to translate."""
    lines = part_rows(spark, d, F.concat_ws(";", "p_name", "p_type", "p_size").alias("line")).withColumn("row", (F.col("r") - 1).cast("bigint"))
    cells = csv_cells.translatable(csv_cells.csv_cells(lines, 3, ";"))
    return cells.select("path", "row", F.col("col").cast("bigint").alias("col"), "value")


@query("s9_sheet_cells", f"""SELECT path, r::INT AS "row", u.col::INT AS col, u.value FROM (SELECT *, unnest([{{'col': 1, 'value': p_name}}, {{'col': 2, 'value': p_type}}]) AS u FROM ({PART_ROWS_SQL}))
WHERE NOT (u.col = 2 AND u.value = 'ECONOMY' AND r <= 500)""")
def s9(spark, d):
    """Parts as a spreadsheet's cells; the first half of the types is looked up by a formula, so its key stays."""
    look = F.when(F.col("p_partkey") % 1000 == 0, '=COUNTIF(B1:B500,"ECONOMY")')
    cell = lambda col, kind, value, formula: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), formula.cast("string").alias("formula"))
    none = F.lit(None)
    row = F.array(cell(1, "text", F.col("p_name"), none), cell(2, "text", F.col("p_type"), none), cell(3, "number", F.col("p_size"), none), cell(4, "formula", none, look))
    cells = part_rows(spark, d, F.explode(row).alias("c")).where("c.kind <> 'formula' or c.formula is not null")
    cells = cut(cells.select("path", F.lit(1).alias("sheet"), F.col("r").cast("int").alias("row"), "c.*"))  # the choice below reads them several times
    return sheets.translatable_cells(cells).select("path", "row", "col", "value")


@query("s11_docx_paragraphs", r"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_replace(t, '\s', '', 'g') <> ''")
def s11(spark, d):
    """A document's paragraphs that are not blank, numbered in order."""
    lines = F.filter(F.split("text", "\n"), lambda x: strip(x) != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("pos", "text"))


@query("s17_term_rows", f"""WITH t AS (SELECT path, r, p_type AS source_term, p_name AS target_term, CASE WHEN r % 3 = 0 THEN 'en→zh' ELSE 'zh→en' END AS lang_pair FROM ({PART_ROWS_SQL}))
SELECT path, source_term, target_term, lang_pair FROM (SELECT *, row_number() OVER (PARTITION BY path, lang_pair, source_term ORDER BY r DESC) AS n FROM t) WHERE n = 1""")
def s17(spark, d):
    """Part types as rows of term imports, a later row standing for the earlier ones of its key."""
    third = F.when((F.col("p_partkey") % 1000 + 1) % 3 == 0, "en→zh").otherwise("")
    rows = part_rows(spark, d, F.array("p_type", "p_name", third).alias("fields")).withColumn("row", F.col("r").cast("bigint"))
    return termbases.import_rows(rows.select("path", "row", "fields")).where("not skipped").select("path", "source_term", "target_term", "lang_pair")


@query("d18_bundle_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def d18(spark, d):
    folder = shared_folder(spark)
    users = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    bundle.export({"users": users}, folder)
    return bundle.load(spark, folder, {"users": users.schema})["users"]


LINES_SQL = "[x for x in string_split(replace(replace(text, chr(34), ''), chr(92), ''), chr(10)) if trim(x) <> '']"


@query("f18_repaired_answers", f"SELECT conv_id, turn, len({LINES_SQL})::BIGINT AS items, array_to_string({LINES_SQL}, '|') AS texts FROM conversations")
def f18(spark, d):
    """Lines put into answers that are damaged in five ways by row, then read back."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    lines = F.split(F.translate("text", '"\\', ""), "\n")
    box = F.when(kind == 2, '{"bbox": 1, 2, 3, 4], "text": "').when(kind == 4, '{"bbox": 1, 2, 3, 4, "text": "').otherwise('{"bbox": [1, 2, 3, 4], "text": "')
    body = F.array_join(F.transform(lines, lambda x: F.concat(box, x, F.lit('"}'))), ", ")
    answer = (
        F.when(kind == 0, F.concat(F.lit("```json\n["), body, F.lit("]\n```")))
        .when(kind == 1, F.concat(F.lit("["), body, F.lit(", ]")))
        .when(kind == 3, F.concat(F.lit("["), body, F.lit(', {"bbox": [1, 2')))
        .when(kind == 4, F.concat(F.lit("Found: "), body))
        .otherwise(F.concat(F.lit("["), body, F.lit("]")))
    )
    items = ocr_items(answer)
    rows = table(spark, d, "conversations").select("conv_id", "turn", items.alias("i"))
    return rows.select("conv_id", "turn", F.size("i").cast("bigint").alias("items"), F.array_join("i.text", "|").alias("texts"))


@query("t6_login_limiter", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, NULL::VARCHAR AS decision, 0 AS n, 0::DOUBLE AS until, 0::DOUBLE AS locked FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, event_id, CASE WHEN t < locked THEN 'rejected' WHEN NOT bad THEN 'success' WHEN k >= 5 THEN 'locked' ELSE 'failure' END,
CASE WHEN t < locked THEN n WHEN NOT bad OR k >= 5 THEN 0 ELSE k END, CASE WHEN t < locked OR (bad AND k > 1) THEN until WHEN bad THEN t + 86400 ELSE 0 END,
CASE WHEN t < locked THEN locked WHEN NOT bad THEN 0 WHEN k >= 5 THEN t + 7200 ELSE locked END
FROM (SELECT s.user_id, e.r, e.event_id, e.t, e.bad, s.n, s.until, s.locked, CASE WHEN s.n = 0 OR e.t >= s.until THEN 1 ELSE s.n + 1 END AS k FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1))
SELECT event_id, decision FROM s WHERE r > 0""")
def t6(spark, d):
    tries = table(spark, d, "events").where(F.col("event_type").isin("error", "signup"))
    return limiter.limit_attempts(tries, "user_id", F.col("event_type") == "error", 86400.0, 5, 7200.0)


@query("t8_one_time_codes", """
WITH c AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS code, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER w AS issued
FROM events WHERE event_type IN ('signup', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id, code ORDER BY ts, event_id) AS nth FROM c WHERE event_type = 'click')
SELECT event_id, code, nth = 1 AND coalesce(epoch(ts) - epoch(issued) < 86400, false) AS accepted FROM u""")
def t8(spark, d):
    """A signup issues a code of one day; the user's first click after it consumes it, later ones are refused."""
    ev = table(spark, d, "events").where(F.col("event_type").isin("signup", "click")).select("event_id", "user_id", "ts", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    issue = F.col("event_type") == "signup"
    seen = ev.withColumn("code", F.last(F.when(issue, F.col("event_id")), True).over(order)).withColumn("issued", F.last(F.when(issue, F.col("ts")), True).over(order))
    # both windows share the user's partitioning, so that there is one shuffle
    nth = F.row_number().over(Window.partitionBy("user_id", "code").orderBy("ts", "event_id"))
    fresh = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("issued").cast("timestamp")) < 86400 * 1000000, F.lit(False))
    return seen.where(~issue).withColumn("nth", nth).select("event_id", "code", ((F.col("nth") == 1) & fresh).alias("accepted"))
