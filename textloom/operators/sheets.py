"""Which spreadsheet cells may change: formulas stay, and so do the values they look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import is_number, strip

NAME = r"'[^']*+(?:''[^']*+)*+'"
#: A text, a reference with or without its sheet, or a quoted name, whichever comes first.
TOKEN = rf'"[^"]*+(?:""[^"]*+)*+"|(?<![\p{{L}}\p{{N}}_.$!])(?:(?:{NAME}|[\p{{L}}\p{{N}}_.]+)!)?\$?[A-Za-z]{{1,3}}\$?\d+(?::\$?[A-Za-z]{{1,3}}\$?\d+)?(?![\p{{L}}\p{{N}}_(.!])|{NAME}!?'
REF = r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?$"


def tokens(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(0))


def formula_literals(formula: Column) -> Column:
    """Texts of a formula that are not empty, doubled quotes read as one."""
    texts = F.filter(tokens(formula), lambda t: t.startswith('"'))
    bare = F.transform(texts, lambda t: F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"')))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def _number(letters: Column) -> Column:
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def formula_ranges(formula: Column) -> Column:
    """array<struct<sheet_name, r1, c1, r2, c2>>; the name is null where the reference names no sheet."""
    refs = F.filter(tokens(formula), lambda t: ~t.startswith('"') & t.rlike(REF))

    def read(t: Column) -> Column:
        g = lambda i: F.regexp_extract(t, REF, i)
        c1, r1 = _number(g(1)), g(2).cast("long")
        c2 = F.when(g(3) == "", c1).otherwise(_number(g(3)))
        r2 = F.when(g(4) == "", r1).otherwise(g(4).cast("long"))
        name = F.regexp_replace(F.regexp_extract(t, r"^(.*)!", 1), r"^'|'$", "")
        return F.struct(
            F.when(t.contains("!"), F.replace(name, F.lit("''"), F.lit("'"))).alias("sheet_name"),
            F.least(r1, r2).alias("r1"), F.least(c1, c2).alias("c1"), F.greatest(r1, r2).alias("r2"), F.greatest(c1, c2).alias("c2"),
        )

    return F.transform(refs, read)


def translatable_cells(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, col, value) of text cells to translate, out of (path, sheet, row, col, kind, value, formula).

    Kinds are text, number, formula and sheet_name (value is the name of the sheet of that number).

    Left out are formulas, blanks, numbers, and cells that equal a text of one of the file's formulas and lie in a range that
    one refers to. Ranges meet only the cells that equal a text, on (path, sheet).
    The cells are read five times, so hand in a written table.
    """
    texts = cells.where("kind = 'text'").where((strip(F.col("value")) != "") & ~is_number(F.col("value"))).select("path", "sheet", "row", "col", "value")
    formulas = cells.where("kind = 'formula'").select("path", "sheet", "formula")
    literals = formulas.select("path", F.explode(formula_literals(F.col("formula"))).alias("value")).distinct()
    names = cells.where("kind = 'sheet_name'").select("path", F.lower("value").alias("named"), F.col("sheet").alias("to"))
    ranges = formulas.select("path", "sheet", F.explode(formula_ranges(F.col("formula"))).alias("r")).select("path", "sheet", F.lower("r.sheet_name").alias("named"), "r.r1", "r.c1", "r.r2", "r.c2").distinct()
    far = ranges.where("named is not null").join(names, ["path", "named"]).select("path", F.col("to").alias("sheet"), "r1", "c1", "r2", "c2")
    ranges = ranges.where("named is null").select("path", "sheet", "r1", "c1", "r2", "c2").unionByName(far)
    maybe = texts.join(literals, ["path", "value"], "left_semi").alias("t")
    inside = F.col("t.row").between(F.col("g.r1"), F.col("g.r2")) & F.col("t.col").between(F.col("g.c1"), F.col("g.c2"))
    kept = maybe.join(ranges.alias("g"), (F.col("t.path") == F.col("g.path")) & (F.col("t.sheet") == F.col("g.sheet")) & inside, "left_semi")
    return texts.join(kept.select("path", "sheet", "row", "col"), ["path", "sheet", "row", "col"], "left_anti")
