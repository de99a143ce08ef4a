"""Term databases as tables: their terms, the pairing of terms within concepts, and rows of term imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import language_pair_code, strip


def termbase_terms(concepts: DataFrame, langs: DataFrame, terms: DataFrame) -> DataFrame:
    """(path, pos, concept, lang, term) of databases' three tables: concepts (path, id, entry), langs (path, id, lang,
    concept_id) and terms (path, pos, lang_id, term). Terms whose language or concept is missing give no row."""
    of = langs.select("path", F.col("id").alias("lang_id"), "lang", "concept_id")
    entry = concepts.select("path", F.col("id").alias("concept_id"), F.col("entry").cast("string").alias("concept"))
    found = terms.join(of, ["path", "lang_id"]).join(entry, ["path", "concept_id"])
    return found.select("path", "pos", "concept", "lang", F.coalesce(strip(F.col("term")), F.lit("")).alias("term"))


def term_pairs(terms: DataFrame) -> DataFrame:
    """(path, concept, source_term, target_term, lang_pair): in each concept the first Chinese term with every term of another
    language; without both, the first term with each later one. Languages are base codes, the order is ``pos``; blank terms
    and concepts of one term give no pair. A concept's rows are counted and joined, never gathered.
    """
    t = terms.where("concept is not null").withColumn("code", language_pair_code(F.col("lang")))
    key = ["path", "concept"]
    row = F.struct("pos", "code", "term")
    heads = t.groupBy(key).agg(F.min(row).alias("any"), F.min(F.when(F.col("code") == "zh", row)).alias("zh"), F.count_if(F.col("code") != "zh").alias("others"))
    mixed = F.col("zh").isNotNull() & (F.col("others") > 0)
    heads = heads.select(*key, mixed.alias("mixed"), F.when(mixed, F.col("zh")).otherwise(F.col("any")).alias("h"))
    pairs = t.join(heads, key).where((F.col("mixed") & (F.col("code") != "zh")) | (~F.col("mixed") & (F.col("pos") > F.col("h.pos"))))
    pairs = pairs.select(*key, F.col("h.term").alias("source_term"), F.col("term").alias("target_term"), F.concat("h.code", F.lit("→"), F.col("code")).alias("lang_pair"))
    return pairs.where((strip(F.col("source_term")) != "") & (strip(F.col("target_term")) != ""))


def import_rows(rows: DataFrame, default_domain: str | None = None) -> DataFrame:
    """Terms out of (path, row, fields array<string>): source, target, pair, domain, priority and note by position, and ``skipped``.

    A file's first row is dropped if a field names a heading. Rows of fewer than two fields, or without source or target, are
    marked skipped. The pair is ``zh→en`` where there is none, the priority ``strict`` only where it says so. Of a key's rows
    (pair and lower-cased source) in a file the last imported one stands.
    """
    field = lambda i: F.coalesce(strip(F.try_element_at("fields", F.lit(i))), F.lit(""))
    head = (F.col("row") == 0) & F.exists("fields", lambda c: F.coalesce(strip(c).isin("中文术语", "source_term", "源语言"), F.lit(False)))
    pair = F.when(F.coalesce(F.try_element_at("fields", F.lit(3)), F.lit("")) == "", "zh→en").otherwise(field(3))
    out = rows.where(~head).select(
        "path", "row", field(1).alias("source_term"), field(2).alias("target_term"), pair.alias("lang_pair"),
        F.when(field(4) != "", field(4)).otherwise(F.lit(default_domain)).alias("domain"),
        F.when(F.lower(field(5)) == "strict", "strict").otherwise("preferred").alias("priority"),
        F.when(F.size("fields") > 5, field(6)).alias("note"),
    )
    out = out.withColumn("skipped", (F.col("source_term") == "") | (F.col("target_term") == ""))
    latest = F.row_number().over(Window.partitionBy("path", "skipped", "lang_pair", F.lower("source_term")).orderBy(F.desc("row")))
    return out.withColumn("_r", latest).where("skipped or _r = 1").drop("_r")
