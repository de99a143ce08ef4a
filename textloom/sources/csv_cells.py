"""Cells of CSV lines, read by Spark's own CSV functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import is_number, strip


def csv_cells(lines: DataFrame, columns: int, sep: str = ",") -> DataFrame:
    """(path, row, col, value) of the cells of lines (path, row, line): rows as given, columns from 0, at most ``columns`` of
    them. Null and empty lines, and fields that a line does not have, give no cell."""
    fields = F.from_csv("line", ", ".join(f"c{i} string" for i in range(columns)), {"sep": sep})
    cells = lines.where("line <> ''").select("path", "row", fields.alias("f"))
    return cells.select("path", "row", F.posexplode(F.array(*(f"f.c{i}" for i in range(columns)))).alias("col", "value")).where("value is not null")


def translatable(cells: DataFrame) -> DataFrame:
    """The cells that are neither blank nor a number."""
    value = F.col("value")
    return cells.where((strip(value) != "") & ~is_number(value))
