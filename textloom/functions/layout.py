"""Boxes and languages of recognised regions, what becomes of footnotes, and CSV lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: recogniser languages by language code; every other code is read with the first one's model
RECOGNISERS = {
    "zh": "ch", "en": "en", "fr": "fr", "de": "german", "ko": "korean", "ja": "japan", "ru": "ru", "es": "es",
    "pt": "pt", "it": "it", "ar": "ar", "hi": "hi", "th": "th", "vi": "vi", "id": "id", "ms": "ms",
}


def recogniser(pair: Column) -> Column:
    """The recogniser's language for a code, or for the source of a pair ``src→tgt``; null gives the default."""
    known = F.create_map(*(F.lit(x) for kv in RECOGNISERS.items() for x in kv))
    source = F.when(F.contains(pair, F.lit("→")), F.trim(F.substring_index(pair, "→", 1))).otherwise(pair)
    return F.coalesce(F.try_element_at(known, source), F.lit(RECOGNISERS["zh"]))


def box(points: Column, width: Column, height: Column, smallest: float) -> Column:
    """The struct (x1, y1, x2, y2) around an array of points (x, y), as shares of the image within 0 to 1.

    Null where there are no points or null ones, where the image has no extent, and where a side is shorter than ``smallest``.
    Two opposite corners are a box in any order.
    """
    share = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(c.cast("double"), n.cast("double"))))
    side = lambda at, n: (share(F.array_min(F.transform(points, at)), n), share(F.array_max(F.transform(points, at)), n))
    (x1, x2), (y1, y2) = side(lambda p: p["x"], width), side(lambda p: p["y"], height)
    whole = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()) & (width > 0) & (height > 0)
    return F.when(whole & (x2 - x1 >= smallest) & (y2 - y1 >= smallest), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def footnote(original: Column, translated: Column, output: Column, mode: Column) -> Column:
    """A footnote's text under an output (bilingual, plain) and a footnote mode (bilingual, translation_only, skip).

    Modes count for bilingual output only. Notes or translations without any word leave the note as it is.
    """
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s", " ")) == "", F.lit(True))
    both = F.concat(original, F.lit("\n"), translated)
    kept = ((output == "bilingual") & (mode == "skip")) | blank(original) | blank(translated)
    return F.when(kept, original).when((output == "bilingual") & (mode == "bilingual"), both).otherwise(translated)


def csv_line(fields: list[Column], delimiter: Column, first: Column) -> Column:
    """A CSV line that quotes only fields which need it; a file's first line begins with a byte order mark. Nulls are empty."""

    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        special = F.contains(text, delimiter) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
        if len(fields) == 1:
            special = special | (text == "")
        return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    # the delimiter may differ by row, so it stands between the fields one by one
    line = field(fields[0])
    for c in fields[1:]:
        line = F.concat(line, delimiter, field(c))
    marked = F.startswith(line, F.lit("\ufeff"))
    return F.when(first & ~marked, F.concat(F.lit("\ufeff"), line)).otherwise(line)
