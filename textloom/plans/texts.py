"""Segments, memories, glossaries, chunks and text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import json_repair
from textloom.functions import text as X
from textloom.operators import core
from textloom.plans import query
from textloom.plans.relational import n, table
from textloom.storage import cut, spread

SEG_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
#: Lines of the benchmark as a memory of four language pairs.
TM_SQL = """SELECT item_id * 1000 + pos - 1 AS tm_id, text AS source_text, CASE WHEN item_id % 4 = 3 THEN 'de' ELSE 'en' END || '→' || CASE WHEN item_id % 3 = 0 THEN 'fr' ELSE 'zh' END AS lang_pair
FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM benchmark)"""
#: The scope that a document asks for: every third does not know its language, every second wants French.
SCOPE = "CASE WHEN doc_id % 3 = 0 THEN 'auto' ELSE lang END || '→' || CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE 'zh' END"
NORM = r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))"


def segments(spark, d):
    return lines(table(spark, d, "documents"))


def lines(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def scoped_lines(docs):
    source = F.when(F.col("doc_id") % 3 == 0, "auto").otherwise(F.col("lang"))
    target = F.when(F.col("doc_id") % 2 == 0, "fr").otherwise("zh")
    return docs.select("doc_id", core.scope_of(source, target).alias("scope"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def memory(spark, d):
    lines = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "source_text"))
    pair = F.concat(F.when(F.col("item_id") % 4 == 3, "de").otherwise("en"), F.lit("→"), F.when(F.col("item_id") % 3 == 0, "fr").otherwise("zh"))
    return lines.select((F.col("item_id") * 1000 + F.col("pos")).alias("tm_id"), "source_text", pair.alias("lang_pair"))


SCOPED_SQL = f"SELECT doc_id, {SCOPE} AS scope, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
MEMORY_SQL = rf"""SELECT scope, {NORM.replace('text', 'source_text')} AS src, max(tm_id) AS tm_id
FROM (SELECT tm_id, source_text, unnest([lang_pair, 'auto→' || string_split(lang_pair, '→')[2]]) AS scope FROM ({TM_SQL})) GROUP BY 1, 2 HAVING src <> ''"""
BEST_SQL = rf"""
WITH s AS (SELECT DISTINCT scope, {NORM} AS key FROM ({SCOPED_SQL}) WHERE {NORM} <> ''), m AS ({MEMORY_SQL}),
ga AS (SELECT scope, key, list_distinct([key[i:i + 1] for i in range(1, length(key))]) AS g FROM s),
gb AS (SELECT scope, src, tm_id, list_distinct([src[i:i + 1] for i in range(1, length(src))]) AS g FROM m),
p AS (SELECT ga.scope, key, tm_id, key = src AS exact, CASE WHEN key = src THEN 1.0 WHEN len(ga.g) + len(gb.g) = 0 THEN 1.0 WHEN len(ga.g) = 0 OR len(gb.g) = 0 THEN 0.0
  ELSE 2.0 * len(list_intersect(ga.g, gb.g)) / (len(ga.g) + len(gb.g)) END AS sim
  FROM ga JOIN gb ON ga.scope = gb.scope AND least(len(ga.g), len(gb.g)) * 1.5 >= greatest(len(ga.g), len(gb.g))),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY exact DESC, sim DESC, tm_id) AS r FROM p WHERE sim >= 0.8)
SELECT scope, key, tm_id, round_even(sim, 3)::DOUBLE AS similarity, exact FROM r WHERE r = 1"""


@query("j3_tm_fuzzy", BEST_SQL)
def j3(spark, d):
    return core.memory_lookup(scoped_lines(spread(table(spark, d, "documents"))).select("scope", "text"), memory(spark, d))


@query("j2_tm_exact", rf"SELECT doc_id, pos::BIGINT AS pos, tm_id FROM (SELECT doc_id, pos, scope, {NORM} AS k FROM ({SCOPED_SQL})) s JOIN ({MEMORY_SQL}) m ON s.scope = m.scope AND k = src")
def j2(spark, d):
    m = core.memory_scopes(memory(spark, d)).withColumnRenamed("src", "k")
    return scoped_lines(table(spark, d, "documents")).withColumn("k", X.norm_text(F.col("text"))).join(m, ["scope", "k"]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "tm_id")


@query("g1_tm_routing", rf"WITH best AS ({BEST_SQL}) SELECT doc_id, pos::BIGINT AS pos, tm_id, similarity, CASE WHEN {NORM} = '' THEN 'blank' WHEN exact THEN 'exact' WHEN tm_id IS NOT NULL THEN 'reference' ELSE 'model' END AS route FROM ({SCOPED_SQL}) s LEFT JOIN best ON key = {NORM} AND best.scope = s.scope")
def g1(spark, d):
    own = scoped_lines(spread(table(spark, d, "documents")))
    best = core.memory_lookup(own.select("scope", "text"), memory(spark, d))
    s = own.withColumn("key", X.norm_text(F.col("text")))
    route = F.when(F.col("key") == "", "blank").when(F.col("exact"), "exact").when(F.col("tm_id").isNotNull(), "reference").otherwise("model")
    return s.join(best, ["scope", "key"], "left").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "tm_id", "similarity", route.alias("route"))


TRIGRAM_SQL = r"list_distinct(flatten([[('  ' || w || ' ')[i:i + 2] for i in range(1, length(w) + 2)] for w in regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')]))"


@query("o4_trigram_top", rf"""
WITH s AS (SELECT scope, key, {TRIGRAM_SQL.format('key')} AS g FROM (SELECT DISTINCT scope, {NORM} AS key FROM ({SCOPED_SQL}))),
m AS (SELECT scope, tm_id, {TRIGRAM_SQL.format('src')} AS g FROM ({MEMORY_SQL})),
p AS (SELECT scope, key, tm_id, len(list_intersect(s.g, m.g)) AS c, len(s.g) + len(m.g) AS n FROM s JOIN m USING (scope) WHERE len(s.g) > 0 AND len(m.g) > 0 AND least(len(s.g), len(m.g)) >= 0.3 * greatest(len(s.g), len(m.g)) - 1e-6),
r AS (SELECT scope, key, tm_id, c / (n - c) AS similarity, row_number() OVER (PARTITION BY scope, key ORDER BY c / (n - c) DESC, tm_id) AS r FROM p WHERE 10 * c >= 3 * (n - c))
SELECT scope, key, r::INT AS rank, tm_id, similarity FROM r WHERE r <= 50""")
def o4(spark, d):
    """The 50 nearest memories of each distinct segment in its scope, by trigrams."""
    s = scoped_lines(spread(table(spark, d, "documents"))).select("scope", X.norm_text(F.col("text")).alias("key")).distinct()
    s = cut(s.withColumn("lid", F.struct(F.xxhash64("scope", "key").alias("a"), F.hash("scope", "key").alias("b"))))
    m = core.memory_scopes(memory(spark, d)).select(F.struct("tm_id", "scope").alias("rid"), F.col("src").alias("rtext"), "scope")
    near = cut(core.trigram_top(s.select("lid", F.col("key").alias("ltext"), "scope"), m))  # written, so that its size is known: mostly few of the texts
    return near.join(s, "lid").select("scope", "key", "rank", "rid.tm_id", "similarity")


#: Words and pairs of words of the memory, and each turn's first word beyond ASCII.
TERM_PATTERNS = (r"[A-Za-z]{3,}", r"[A-Za-z]+[,.]? [A-Za-z]{3,}")
GLOSSARY_SQL = rf"""SELECT term, 'T ' || term AS target, CASE WHEN min(o) % 3 = 0 THEN 'strict' ELSE 'preferred' END AS priority, min(o) AS ord FROM (
SELECT unnest(w) AS term, item_id * 100000 + generate_subscripts(w, 1) AS o FROM (SELECT item_id, regexp_extract_all(text, '{TERM_PATTERNS[0]}') AS w FROM benchmark)
UNION ALL SELECT unnest(w), 100000000 + item_id * 100000 + generate_subscripts(w, 1) FROM (SELECT item_id, regexp_extract_all(text, '{TERM_PATTERNS[1]}') AS w FROM benchmark)
UNION ALL SELECT w, 200000000 + conv_id * 1000 + turn FROM (SELECT conv_id, turn, regexp_extract(text, '\p{{L}}*[^\x00-\x7F]\p{{L}}* ?\p{{L}}*') AS w FROM conversations) WHERE w <> '') GROUP BY term"""


def glossary(spark, d):
    def found(name, key, pattern, first):
        w = table(spark, d, name).select(F.col(key).alias("k"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("p", "term"))
        return w.select("term", (F.col("k") * 100000 + F.col("p") + 1 + first).alias("o"))

    wide = r"\p{L}*[^\x00-\x7F]\p{L}* ?\p{L}*"
    said = table(spark, d, "conversations").select(F.regexp_extract("text", wide, 0).alias("term"), (F.col("conv_id") * 1000 + F.col("turn") + 200_000_000).alias("o")).where("term <> ''")
    g = found("benchmark", "item_id", TERM_PATTERNS[0], 0).unionByName(found("benchmark", "item_id", TERM_PATTERNS[1], 100_000_000)).unionByName(said)
    g = g.groupBy("term").agg(F.min("o").alias("ord"))
    return g.select("term", F.concat(F.lit("T "), F.col("term")).alias("target"), F.when(F.col("ord") % 3 == 0, "strict").otherwise("preferred").alias("priority"), "ord")


ENTRY_SQL = """SELECT p_partkey AS id, p_type AS source_term, p_name AS target_term, ['en→zh', 'zh→en', 'fr→zh', 'zh→fr', 'en→fr'][p_partkey % 5 + 1] AS lang_pair,
CASE WHEN p_size < 10 THEN '法学' WHEN p_size % 4 > 0 THEN p_brand END AS domain, CASE WHEN p_size % 2 = 0 THEN 'strict' ELSE 'preferred' END AS priority, p_retailprice AS updated_at FROM part"""
PAIRS = (("en", "zh"), ("zh-Hant", "EN"), ("auto", "zh"), ("auto", "fr"), ("de", "zh"))


def entries(spark, d):
    """Parts as the entries of a term table."""
    pair = F.element_at(F.array(*map(F.lit, ("en→zh", "zh→en", "fr→zh", "zh→fr", "en→fr"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("source_term"), F.col("p_name").alias("target_term"), pair.alias("lang_pair"),
        F.when(F.col("p_size") < 10, "法学").when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("domain"), F.when(F.col("p_size") % 2 == 0, "strict").otherwise("preferred").alias("priority"),
        F.col("p_retailprice").alias("updated_at"),
    )


@query("j1_glossary_load", f"""WITH e AS ({ENTRY_SQL}), r AS (SELECT * FROM (VALUES ('en', 'zh'), ('zh', 'en'), ('auto', 'zh'), ('auto', 'fr'), ('de', 'zh')) t(src, tgt)),
k AS (SELECT *, string_split(lang_pair, '→')[1] AS a, string_split(lang_pair, '→')[2] AS b FROM e WHERE domain IS NULL OR domain <> '法学')
SELECT src, tgt, id, source_term, target_term, priority FROM r JOIN k ON b = tgt AND (src = 'auto' OR a = src)
UNION ALL SELECT src, tgt, id, target_term, source_term, priority FROM r JOIN k ON a = tgt AND (src = 'auto' OR b = src)""")
def j1(spark, d):
    """Terms of five requested pairs in both directions, dictionary terms left out; ``auto`` takes every source language."""
    wanted = spark.createDataFrame(PAIRS, "source string, target string")
    wanted = wanted.select(*(X.language_pair_code(F.col(c)).alias(n) for c, n in (("source", "src"), ("target", "tgt"))))
    return core.glossary_for_pairs(entries(spark, d), wanted).select("src", "tgt", "id", "source_term", "target_term", "priority")


# a mark at each edge of a word: a term on word boundaries is then a substring
HITS_SQL = rf"""
WITH g AS ({GLOSSARY_SQL}), t AS (SELECT trim(term) AS t, arg_min(term, ord) AS term, arg_min(priority, ord) AS priority, min(ord) AS ord FROM g GROUP BY 1),
q AS (SELECT *, regexp_full_match(t, '[\x00-\x7F]*') AS is_ascii, CASE WHEN regexp_matches(t[1], '[\p{{L}}\p{{N}}_]') THEN '' ELSE chr(1) END || regexp_replace(lower(t), '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g')
  || CASE WHEN regexp_matches(t[-1], '[\p{{L}}\p{{N}}_]') THEN '' ELSE chr(1) END AS marked FROM t WHERE length(t) >= CASE WHEN regexp_full_match(t, '[\x00-\x7F]*') THEN 3 ELSE 2 END),
s AS (SELECT doc_id, pos, text, regexp_replace(lower(text), '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g') AS low FROM ({SEG_SQL})),
h AS (SELECT doc_id, pos, t, term, priority, ord FROM s JOIN q ON CASE WHEN is_ascii THEN contains(low, marked) ELSE contains(text, t) END),
i AS (SELECT a.t AS t, b.t AS o FROM t a JOIN t b ON length(b.t) > length(a.t) AND contains(b.t, a.t)),
x AS (SELECT DISTINCT h.doc_id, h.pos, h.t FROM h JOIN i ON h.t = i.t JOIN h h2 ON h2.doc_id = h.doc_id AND h2.pos = h.pos AND h2.t = i.o WHERE h.priority <> 'strict'),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pos) AS n FROM h WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = h.doc_id AND x.pos = h.pos AND x.t = h.t)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY CASE WHEN n > 40 THEN (priority <> 'strict')::INT END, CASE WHEN n > 40 THEN -length(term) END, ord, term) AS r FROM f)
SELECT doc_id, pos::BIGINT AS pos, term, priority FROM r WHERE r <= 40"""


@query("j4_glossary_matches", HITS_SQL)
def j4(spark, d):
    s = lines(spread(table(spark, d, "documents"))).select(F.struct("doc_id", "pos").alias("seg_id"), "text")
    return core.glossary_hits(s, glossary(spark, d)).select("seg_id.doc_id", F.col("seg_id.pos").cast("bigint").alias("pos"), "term", "priority")


@query("j12_shadowed_terms", f"WITH h AS ({HITS_SQL}) SELECT doc_id, pos, count(*) AS kept, count(*) FILTER (priority = 'strict') AS strict, max(length(term)) AS longest FROM h GROUP BY ALL")
def j12(spark, d):
    """Hits that no longer hit of their segment holds, strict ones always, by segment."""
    hits = j4(spark, d).groupBy("doc_id", "pos")
    return hits.agg(F.count("*").alias("kept"), n(F.col("priority") == "strict", "strict"), F.max(F.length("term")).cast("bigint").alias("longest"))


@query("f11_prompt_lines", f"""WITH h AS ({HITS_SQL}) SELECT doc_id, pos, string_agg('- ' || CASE WHEN priority = 'strict' THEN '[STRICT] ' ELSE '' END || '"' || term || '" → "T ' || term || '"', chr(10) ORDER BY term) AS prompt FROM h GROUP BY doc_id, pos""")
def f11(spark, d):
    s = lines(spread(table(spark, d, "documents"))).select(F.struct("doc_id", "pos").alias("seg_id"), "text")
    hits = core.glossary_hits(s, glossary(spark, d)).groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("term", "priority"))).alias("l"))
    line = lambda x: F.concat(F.lit("- "), F.when(x["priority"] == "strict", "[STRICT] ").otherwise(""), F.lit('"'), x["term"], F.lit('" → "T '), x["term"], F.lit('"'))
    return hits.select("seg_id.doc_id", F.col("seg_id.pos").cast("bigint").alias("pos"), F.array_join(F.transform("l", line), "\n").alias("prompt"))


@query("s6_text_segments", "SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS segment FROM documents")
def s6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n\n")).alias("segment"))


@query("s16_paragraphs", rf"SELECT doc_id, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars FROM ({SEG_SQL}) WHERE {NORM} <> '' GROUP BY doc_id")
def s16(spark, d):
    s = segments(spark, d).where(X.norm_text(F.col("text")) != "")
    return s.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query("w8_chunk_packing", f"""
WITH RECURSIVE x AS (SELECT doc_id, pos + 1 AS i, length(text) AS n, count(*) OVER (PARTITION BY doc_id) AS last FROM ({SEG_SQL})),
s AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS chunk, 0::BIGINT AS c, 0::BIGINT AS size, NULL::STRUCT(n BIGINT, size BIGINT) AS done FROM documents WHERE text IS NOT NULL
UNION ALL SELECT x.doc_id, x.i, s.chunk + CASE WHEN x.n > 6000 AND s.c = 0 OR s.c > 0 AND s.size + x.n > 6000 THEN 1 ELSE 0 END,
CASE WHEN x.n > 6000 AND s.c = 0 THEN 0 WHEN s.c > 0 AND s.size + x.n > 6000 THEN 1 ELSE s.c + 1 END, CASE WHEN x.n > 6000 AND s.c = 0 THEN 0 WHEN s.c > 0 AND s.size + x.n > 6000 THEN x.n ELSE s.size + x.n END,
CASE WHEN x.n > 6000 AND s.c = 0 THEN {{'n': 1, 'size': x.n}} WHEN s.c > 0 AND s.size + x.n > 6000 THEN {{'n': s.c, 'size': s.size}} END FROM s JOIN x ON x.doc_id = s.doc_id AND x.i = s.i + 1),
d AS (SELECT doc_id, chunk - 1 AS chunk, done.n AS n, done.size AS size FROM s WHERE done IS NOT NULL),
e AS (SELECT s.doc_id, s.chunk, s.c, s.size, s.c > 0 AND s.size < 1500 AND s.chunk > 0 AS joined FROM s JOIN (SELECT DISTINCT doc_id, last FROM x) l ON l.doc_id = s.doc_id AND l.last = s.i)
SELECT d.doc_id, d.chunk, (d.n + CASE WHEN e.joined AND d.chunk = e.chunk - 1 THEN e.c ELSE 0 END)::BIGINT AS paragraphs, (d.size + CASE WHEN e.joined AND d.chunk = e.chunk - 1 THEN e.size ELSE 0 END)::BIGINT AS chars FROM d JOIN e ON d.doc_id = e.doc_id
UNION ALL SELECT doc_id, chunk, c, size FROM e WHERE c > 0 AND NOT joined""")
def w8(spark, d):
    sizes = F.transform(F.split("text", "\n"), F.length)
    return table(spark, d, "documents").select("doc_id", F.posexplode(core.pack_chunks(sizes)).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("c.n").alias("paragraphs"), F.col("c.size").alias("chars"))


@query("w9_code_fences", "SELECT doc_id, count(*) FILTER (inside % 2 = 1) AS fenced, count(*) AS lines FROM (SELECT doc_id, pos, coalesce(sum((text LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM (" + SEG_SQL + ")) GROUP BY doc_id")
def w9(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("text").startswith("```").cast("int")).over(w), F.lit(0))
    return segments(spark, d).withColumn("inside", inside).groupBy("doc_id").agg(n(F.col("inside") % 2 == 1, "fenced"), F.count("*").alias("lines"))


@query("a9_character_totals", "SELECT lang, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(*) FILTER (n_chars > 30000) AS large FROM documents GROUP BY lang")
def a9(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), n(F.col("n_chars") > 30000, "large"))


@query("a10_scanned_documents", f"SELECT doc_id FROM ({SEG_SQL}) GROUP BY doc_id HAVING sum(length(trim(text))) < 20 * count(*)")
def a10(spark, d):
    return segments(spark, d).groupBy("doc_id").agg(F.sum(F.length(F.trim("text"))).alias("c"), F.count("*").alias("p")).where("c < 20 * p").select("doc_id")


@query("a11_language_guess", "SELECT doc_id, CASE WHEN length(regexp_replace(s, '[^A-Za-z]', '', 'g')) / greatest(length(s), 1) > 0.5 THEN 'en' ELSE 'zh' END AS lang FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:20], ' ') AS s FROM documents)")
def a11(spark, d):
    s = F.array_join(F.slice(F.split("text", "\n"), 1, 20), " ")
    ratio = F.length(F.regexp_replace("s", "[^A-Za-z]", "")) / F.greatest(F.length("s"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.when(ratio > 0.5, "en").otherwise("zh").alias("lang"))


@query("f1_normalised_keys", r"SELECT conv_id, turn, lower(trim(text)) AS stored, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS probe FROM conversations")
def f1(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.norm_sql(F.col("text")).alias("stored"), X.norm_text(F.col("text")).alias("probe"))


@query("f2_language_codes", "SELECT doc_id, CASE WHEN lang = 'zh-hant' THEN 'zh' ELSE string_split(lower(lang), '-')[1] END AS code, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS name FROM documents")
def f2(spark, d):
    return table(spark, d, "documents").select("doc_id", X.language_pair_code(F.col("lang")).alias("code"), X.language_name(F.col("lang")).alias("name"))


SKIP = r"""(regexp_full_match(s, '[\d\s,.%$€¥£₹+\-]+') OR regexp_full_match(s, '\d{4}[-/]\d{1,2}[-/]\d{1,2}') OR regexp_full_match(s, '\d{1,2}:\d{2}(:\d{2})?') OR regexp_full_match(s, '[\w.+-]+@[\w-]+\.[\w.]+') OR regexp_matches(s, '^(?i:https?)://') OR regexp_matches(s, '^(?i:v)?\d+\.\d+'))"""


@query("f4_skip_rule", f"SELECT kind, count(*) AS n, count(*) FILTER (s = '' OR {SKIP}) AS skipped FROM (SELECT 'url' AS kind, url AS s FROM pages UNION ALL SELECT 'value', value::DECIMAL(18, 2)::VARCHAR FROM events UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d') FROM events UNION ALL SELECT 'type', event_type FROM events) GROUP BY kind")
def f4(spark, d):
    ev = table(spark, d, "events")
    kinds = table(spark, d, "pages").select(F.lit("url").alias("kind"), F.col("url").alias("s"))
    for kind, c in (("value", F.col("value").cast("decimal(18,2)").cast("string")), ("day", F.date_format("ts", "yyyy-MM-dd")), ("type", F.col("event_type"))):
        kinds = kinds.unionByName(ev.select(F.lit(kind).alias("kind"), c.alias("s")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), n(X.should_skip(F.col("s")), "skipped"))


@query("f5_dice_similarity", """
WITH c AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
g AS (SELECT *, list_distinct([x[i:i + 1] for i in range(1, length(x))]) AS gx, list_distinct([y[i:i + 1] for i in range(1, length(y))]) AS gy FROM c)
SELECT conv_id, turn, round_even(CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN len(gx) + len(gy) = 0 THEN 1.0 WHEN len(gx) = 0 OR len(gy) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) END, 6)::DOUBLE AS similarity FROM g""")
def f5(spark, d):
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.bround(X.dice(F.col("text"), F.col("y")), 6).alias("similarity"))


@query("f6_clean_terms", r"SELECT p_partkey, trim(string_split(trim(regexp_replace(string_split('n.' || p_name || '; v. x', ';')[1], '^(?i:n|v|vt|vi|adj|adv|prep|conj|pron|art|abbr|num|aux)\.', '')), ',')[1]) AS term FROM part")
def f6(spark, d):
    return table(spark, d, "part").select("p_partkey", X.clean_term(F.concat(F.lit("n."), F.col("p_name"), F.lit("; v. x"))).alias("term"))


@query("f8_has_letter", r"SELECT doc_id, regexp_matches(text, '\p{L}') AS has_letter FROM documents")
def f8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(r"\p{L}").alias("has_letter"))


@query("f9_token_budget", "SELECT doc_id, least(8192, greatest(2048, greatest(256, length(text) // 2) * 3))::BIGINT AS budget FROM documents")
def f9(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_budget(F.col("text")).alias("budget"))


@query("f10_backoff", "SELECT l_orderkey, l_linenumber, least(5 * 2 ** l_linenumber, 60)::BIGINT AS limited, least(1 + 2 * l_linenumber, 60)::BIGINT AS error, least(1 + 2 * l_linenumber, 30)::BIGINT AS empty FROM lineitem")
def f10(spark, d):
    k = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(X.backoff(x, k).alias(x) for x in ("limited", "error", "empty")))


@query("f12_bilingual", r"SELECT conv_id, turn, CASE WHEN regexp_replace(text, '\s', '', 'g') = '' THEN text ELSE text || chr(10) || upper(role) END AS both FROM conversations")
def f12(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.bilingual(F.col("text"), F.upper("role")).alias("both"))


@query("f13_csv_guard", "SELECT c_custkey, CASE WHEN regexp_matches(ltrim(c_acctbal::DECIMAL(18, 2)::VARCHAR), '^[=+\\-@]') THEN '''' ELSE '' END || c_acctbal::DECIMAL(18, 2)::VARCHAR AS cell FROM customer")
def f13(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.csv_safe(F.col("c_acctbal").cast("decimal(18,2)")).alias("cell"))


@query("f14_numeric_cells", "SELECT event_type, count(*) FILTER (regexp_full_match(v, '[+-]?\\d+\\.?\\d*')) AS numeric_cells, count(*) FILTER (NOT regexp_full_match(v, '[+-]?\\d+\\.?\\d*')) AS others FROM (SELECT event_type, value::DECIMAL(18, 2)::VARCHAR AS v FROM events UNION ALL SELECT event_type, event_type FROM events) GROUP BY 1")
def f14(spark, d):
    ev = table(spark, d, "events")
    v = ev.select("event_type", F.col("value").cast("decimal(18,2)").cast("string").alias("v")).unionByName(ev.select("event_type", F.col("event_type").alias("v")))
    num = X.is_number(F.col("v"))
    return v.groupBy("event_type").agg(n(num, "numeric_cells"), n(~num, "others"))


@query("f15_sheet_names", r"SELECT p_partkey, left(regexp_replace(p_type || '/' || p_name, '[\\/*?:\[\]]', '_', 'g'), 31) AS sheet FROM part")
def f15(spark, d):
    return table(spark, d, "part").select("p_partkey", F.left(F.regexp_replace(F.concat_ws("/", "p_type", "p_name"), r"[\\/*?:\[\]]", "_"), F.lit(31)).alias("sheet"))


@query("f16_url_parts", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS ext FROM pages")
def f16(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.lower(F.regexp_extract("url", r"(\.[^./]+)$", 1)).alias("ext"))


@query("f17_html_cells", r"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda x: x <> ''), ' | ') AS cells FROM pages")
def f17(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_cells(F.col("html"), "li").alias("cells"))


#: Answers that list a conversation's turns as terms: in fences, with words around, with blank and repeated terms, broken by row.
ANSWER_SQL = r"""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '```json' || chr(10) || b || chr(10) || '```' WHEN 1 THEN 'Terms: ' || b || ' end' WHEN 2 THEN b ELSE replace(b, '}', '') END AS answer FROM (
SELECT conv_id, turn, '[' || array_to_string(list_transform(list_concat(l, [lower(l[1]), ' ']), lambda x: '{"source": "' || x || ' ", "target": "' || CASE WHEN length(x) % 5 = 0 THEN ' ' ELSE 't ' || x END || '"}'), ', ') || ', 5, "x"]' AS b
FROM (SELECT conv_id, turn, string_split(replace(replace(text, chr(34), ''), chr(92), ''), chr(10)) AS l FROM conversations))"""


@query("f19_json_fields", rf"""
WITH a AS ({ANSWER_SQL}), c AS (SELECT conv_id, turn, trim(regexp_replace(answer, '(?m)^```(?:json)?|```$', '', 'g')) AS r FROM a),
j AS (SELECT conv_id, turn, CASE WHEN position('[' IN r) > 0 THEN substr(r, position('[' IN r), length(r) - position(']' IN reverse(r)) - position('[' IN r) + 2) END AS b FROM c),
i AS (SELECT conv_id, turn, unnest(CASE WHEN json_valid(b) THEN json_extract(b, '$[*]') ELSE [] END) AS x, generate_subscripts(CASE WHEN json_valid(b) THEN json_extract(b, '$[*]') ELSE [] END, 1) AS p FROM j),
t AS (SELECT conv_id, turn, p, trim(json_extract_string(x, '$.source')) AS s, trim(json_extract_string(x, '$.target')) AS t FROM i WHERE json_type(x) = 'OBJECT')
SELECT conv_id, turn, arg_min(s, p) AS source_term, arg_min(t, p) AS target_term FROM t WHERE s <> '' AND t <> '' GROUP BY conv_id, turn, lower(s)""")
def f19(spark, d):
    """Terms out of a model's JSON answers, one for each source whatever its case."""
    lines = F.split(F.translate("text", '"\\', ""), "\n")
    item = lambda x: F.concat(F.lit('{"source": "'), x, F.lit(' ", "target": "'), F.when(F.length(x) % 5 == 0, " ").otherwise(F.concat(F.lit("t "), x)), F.lit('"}'))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.concat("l", F.array(F.lower(F.col("l")[0]), F.lit(" "))), item), ", "), F.lit(', 5, "x"]'))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), "b", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Terms: "), "b", F.lit(" end"))).when(kind == 2, F.col("b")).otherwise(F.translate("b", "}", ""))
    rows = table(spark, d, "conversations").select("conv_id", "turn", lines.alias("l")).withColumn("b", body).select("conv_id", "turn", answer.alias("answer"))
    return rows.select("conv_id", "turn", F.explode(json_repair.answer_terms(F.col("answer"))).alias("t")).select("conv_id", "turn", "t.source_term", "t.target_term")


@query("f20_box_normalise", "SELECT vec_id, greatest(0, least(1, least(embedding[1], embedding[2])::DOUBLE + 0.5))::DOUBLE AS lo, greatest(0, least(1, greatest(embedding[1], embedding[2])::DOUBLE + 0.5))::DOUBLE AS hi FROM embeddings")
def f20(spark, d):
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c + 0.5))
    return table(spark, d, "embeddings").select("vec_id", clamp(F.least(a, b)).alias("lo"), clamp(F.greatest(a, b)).alias("hi"))


@query("f21_error_classes", "SELECT conv_id, turn, CASE WHEN contains(m, 'rate limit') OR contains(m, '429') OR contains(m, 'too many requests') THEN 'rate_limit' WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'timeout' WHEN contains(m, 'connect') THEN 'connection' WHEN contains(m, '401') OR contains(m, 'unauthorized') OR contains(m, 'api key') OR contains(m, 'apikey') THEN 'credentials' WHEN contains(m, '400') OR contains(m, 'bad request') THEN 'rejected' WHEN contains(m, 'ocr') OR contains(m, 'paddle') THEN 'ocr' WHEN contains(m, 'minio') OR contains(m, 's3') THEN 'storage' ELSE 'other' END AS class FROM (SELECT conv_id, turn, lower(text) AS m FROM conversations)")
def f21(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.error_class(F.col("text")).alias("class"))


@query("f24_progress", "SELECT l_orderkey, l_linenumber, least(90, greatest(10, 10 + trunc(l_quantity / 50 * 80)))::BIGINT AS progress FROM lineitem")
def f24(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.lit(90), F.greatest(F.lit(10), 10 + (F.col("l_quantity") / 50 * 80).cast("bigint"))).cast("bigint").alias("progress"))


@query("f28_concept_ids", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT::VARCHAR AS concept FROM orders")
def f28(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("bigint").cast("string").alias("concept"))


@query("f29_ascii_documents", r"SELECT lang, count(*) FILTER (regexp_full_match(text, '[\x00-\x7F]*')) AS ascii_docs FROM documents GROUP BY lang")
def f29(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(n(F.col("text").rlike(r"^[\x00-\x7F]*$"), "ascii_docs"))


@query("f33_date_parts", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, date_trunc('day', ts)::TIMESTAMP AS midnight, floor(epoch(ts))::BIGINT AS secs FROM events")
def f33(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("midnight"), F.unix_seconds(ts).alias("secs"))


@query("g5_term_extraction_gate", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 1500")
def g5(spark, d):
    return table(spark, d, "documents").where(F.length(F.trim("text")) >= 1500).select("doc_id")


RAW_SQL = "SELECT p_partkey, ['n.', ' vt. ', '', 'Adj.'][p_partkey % 4 + 1] || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END || [';second', ', other', ' ４８', '; v. x, y'][p_partkey % 4 + 1] AS raw FROM part"
POS_SQL = "'^(?i:n|v|vt|vi|adj|adv|prep|conj|pron|art|abbr|num|aux)\\.', ''"


@query("d13_bulk_clean", f"""WITH r AS ({RAW_SQL}), a AS (SELECT *, trim(regexp_replace(trim(string_split(trim(raw), ';')[1]), {POS_SQL})) AS f FROM r),
c AS (SELECT *, translate(trim(regexp_replace(trim(string_split(f, ',')[1]), {POS_SQL})), '０１２３４５６７８９', '0123456789') AS t FROM a)
SELECT p_partkey, CASE WHEN t = '' THEN raw ELSE t END AS term, t = '' AS skipped, t <> '' AND t <> raw AS changed FROM c""")
def d13(spark, d):
    """Terms cleaned; those of which nothing is left stay as they are."""
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.concat(pick("n.", " vt. ", "", "Adj."), F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_name")), pick(";second", ", other", " ４８", "; v. x, y"))
    t = table(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("t", X.clean_term(F.col("raw")))
    return t.select("p_partkey", F.when(F.col("t") == "", F.col("raw")).otherwise(F.col("t")).alias("term"), (F.col("t") == "").alias("skipped"), ((F.col("t") != "") & (F.col("t") != F.col("raw"))).alias("changed"))


@query("u5_bigram_sets", "SELECT doc_id, len(list_distinct([text[i:i + 1] for i in range(1, length(text))]))::BIGINT AS bigrams FROM documents")
def u5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.bigrams(F.col("text"))).cast("bigint").alias("bigrams"))
