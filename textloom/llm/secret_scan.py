"""Secret scans with multipart credential linking (operator 10, DataFrame functions only).

Base findings are of three kinds, each leftmost and non-overlapping: ``assign`` (a named value of 12 characters or more),
``access`` (an access identifier) and ``hex``. Strings that say little alone are weak candidates: ``key40``, 40 characters as
secret keys have them, and ``endpoint``, a URL. They are reported only where their complements co-occur within a scope: a
key40 with an access identifier, an endpoint with an access identifier and a secret (assign, hex or key40), within
``scope`` code points of one another. Parts become rows with their interval, and an interval join on (document, scope bin)
finds the complements; a text with very many parts spreads over its bins, and a bin holds no more parts than fit in it.

Places come from the text between matches and the matches, whose lengths add up to code-point offsets.

Defined results: null and empty texts have no findings; rows with null doc_ids are scanned like others; rows equal in
doc_id and text get equal findings; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so those of fewer characters need no match
KEY40 = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""https?://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "key40", "endpoint")


def _places(text: Column, pattern: str, kind: str, good=None) -> Column:
    """Spans of the pattern's matches, as structs (start, rank of kind, end), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(found, lambda m: F.struct(F.length(m).alias("n"), (good(m) if good else F.lit(True)).alias("good"))).alias("m"), F.slice(F.transform(between, F.length), 1, F.size(found)).alias("b"))
    start = F.expr("struct(0 as at, cast(array() as array<struct<start:int,rank:int,end:int>>) as spans)")

    def step(acc, p):
        s = acc["at"] + p["b"]
        e = s + p["m"]["n"]
        span = F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), e.alias("end"))
        return F.struct(e.alias("at"), F.when(p["m"]["good"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pairs, start, step)["spans"]


NONE = "cast(array() as array<struct<start:int,rank:int,end:int>>)"


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, base, spans): findings of the base kinds, and these with the linked candidates, as arrays of structs
    (start, rank, end), rank being a place in KINDS, sorted."""
    none = F.expr(NONE)
    text = F.col("text")
    has = lambda p: text.rlike(p)  # noqa: E731  most texts have nothing of a kind: one search without results tells
    long_enough = lambda m: F.length(F.regexp_replace(m, VALUE, "")) >= 12
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.select(
        "doc_id", F.xxhash64("text").alias("txt"), "text",
        F.when(has(ASSIGN), _places(text, ASSIGN, "assign", long_enough)).otherwise(none).alias("assign"),
        F.when(text.contains("AKIA"), _places(text, ACCESS, "access", lambda m: F.length(m) >= 18)).otherwise(none).alias("access"),
        F.when(has(HEX), _places(text, HEX, "hex")).otherwise(none).alias("hex"),
    )
    id_there = F.size("access") > 0  # without an identifier no candidate has its complement
    t = cut(t.select(
        "doc_id", "txt", F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        F.when(id_there & has(KEY40), _places(text, KEY40, "key40")).otherwise(none).alias("key40"),
        F.when(id_there & text.contains("://"), _places(text, ENDPOINT, "endpoint")).otherwise(none).alias("endpoint"),
    ))
    parts = (
        t.where("size(key40) + size(endpoint) > 0")
        .select("doc_id", "txt", F.explode(F.concat("base", "key40", "endpoint")).alias("s"))
        .select("doc_id", "txt", "s.start", "s.rank", "s.end").distinct()
    )
    # interval join: a part stands in the bin of its start; a candidate looks into the bins that its scope reaches
    home = parts.select("doc_id", "txt", F.col("start").alias("p_start"), F.col("rank").alias("p_rank"), F.col("end").alias("p_end"),
                        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin"))
    weak = parts.where(F.col("rank") >= 3).withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    near = (F.col("p_start") - F.col("end") <= scope) & (F.col("start") - F.col("p_end") <= scope)
    other = (F.col("start") != F.col("p_start")) | (F.col("rank") != F.col("p_rank"))
    w = weak.alias("w").join(home.alias("h"), F.col("w.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("w.txt") == F.col("h.txt")) & (F.col("w.bin") == F.col("h.bin")) & near & other)
    linked = (
        w.groupBy("w.doc_id", "w.txt", "start", "rank", "end")
        .agg(F.bool_or(F.col("p_rank") == 1).alias("id"), F.bool_or(F.col("p_rank").isin(0, 2, 3)).alias("secret"))
        .where("id and (rank = 3 or secret)")
        .groupBy(F.col("doc_id").alias("l_doc"), F.col("txt").alias("l_txt"))
        .agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    )
    out = t.join(linked, t["doc_id"].eqNullSafe(F.col("l_doc")) & (t["txt"] == F.col("l_txt")), "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.expr(NONE)))).alias("spans"))


def as_text(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
