"""Boxes and texts out of a model's damaged JSON answer, by four readings in turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import strip

NUMBER = r"\s*(\d+(?:\.\d*)?|\.\d+)\s*"
BOX = rf'"bbox"\s*:[\s\[]*{",".join([NUMBER] * 4)}[\s\]]*'


def _valid(json: Column) -> Column:
    """Items with four numbers and a text that is not blank; null where the text is no JSON array."""
    # in brackets, as the parser would pass over what follows a whole value
    whole = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    items = F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "array<variant>"))
    read = F.transform(items, lambda x: F.struct(F.try_variant_get(x, "$.bbox", "array<double>").alias("bbox"), F.try_variant_get(x, "$.text", "string").alias("text")))
    return F.filter(read, lambda x: F.coalesce((F.size(x["bbox"]) == 4) & (F.trim(x["text"]) != ""), F.lit(False)))


def _some(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def ocr_items(answer: Column) -> Column:
    """array<struct<bbox: array<double>, text: string>>; empty for null, blank or hopeless answers.

    Read in turn: the outermost array as it is; with boxes bracketed anew and loose commas gone; that cut at its last closed
    item; last, each box followed by its text wherever it stands. An array that parses as it is decides, even without a valid
    item; so a lone item outside an array, whose box is the only array, gives none.
    """
    body = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    array = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    # an answer cut short has no closing bracket of its own: everything from the first bracket on is then mended
    cut = F.regexp_extract(body, r"(?s)(\[.*)", 1)

    def mended(c):
        boxed = F.regexp_replace(c, BOX + r"(,?)", r'"bbox": [$1, $2, $3, $4]$5')
        return F.regexp_replace(F.regexp_replace(boxed, r'(\])\s*("text")', "$1, $2"), r",\s*([}\]])", "$1")

    closed = F.concat(F.regexp_extract(mended(cut), r"(?s)^(.*\})", 1), F.lit("]"))
    found = F.regexp_extract_all(body, F.lit(BOX + r',?\s*"?text"?\s*:\s*"([^"]*)"'), F.lit(0))
    scanned = F.transform(
        found,
        lambda x: F.struct(
            F.array(*(F.regexp_extract(x, BOX, i).cast("double") for i in range(1, 5))).alias("bbox"),
            F.regexp_extract(x, r'text"?\s*:\s*"([^"]*)"$', 1).alias("text"),
        ),
    )
    scanned = F.filter(scanned, lambda x: F.trim(x["text"]) != "")
    return F.coalesce(_valid(array), _some(_valid(mended(array))), _some(_valid(closed)), scanned)


def answer_terms(answer: Column) -> Column:
    """array<struct<source_term, target_term>> out of a model's answer: the JSON array from the first bracket to the last one,
    fences aside. Items that are no objects, or without a source or a target, go; of sources that differ in case only, the
    first stays. An answer without such an array, or a broken one, gives none."""
    bare = F.regexp_replace(answer, r"(?m)^```(?:json)?|```$", "")
    body = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    items = F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "array<variant>"))
    items = F.coalesce(items, F.array().cast("array<variant>"))
    field = lambda v, k: F.coalesce(strip(F.try_variant_get(v, f"$.{k}", "string")), F.lit(""))
    objects = F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    terms = F.transform(objects, lambda v: F.struct(field(v, "source").alias("source_term"), field(v, "target").alias("target_term")))
    full = F.filter(terms, lambda t: (t["source_term"] != "") & (t["target_term"] != ""))
    keys = F.transform(full, lambda t: F.lower(t["source_term"]))
    return F.filter(full, lambda t, i: F.array_position(keys, F.lower(t["source_term"])) == i + 1)
