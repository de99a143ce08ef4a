"""Text files of unknown charset as rows, cut into segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Charsets in the order they are tried where bytes are no UTF-8; the last takes any bytes.
LADDER = ("gb18030", "gbk", "latin-1")


@F.pandas_udf(StringType())
def _other_charsets(content: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        for name in LADDER:
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue

    return content.map(one)


def decode_bytes(df: DataFrame, content: str = "content", to: str = "text") -> DataFrame:
    """Adds the decoded text: UTF-8 inside the JVM, with or without its mark; other bytes by the ladder. Null stays null."""
    raw = F.col(content)
    body = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, F.lit(4), F.length(raw))).otherwise(raw)
    good = F.is_valid_utf8(body.cast("string"))
    odd = F.when(~good, raw)
    return df.withColumn(to, F.when(good, body.cast("string")).otherwise(_other_charsets(odd)))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each whole file under a path; Spark lists no files of zero bytes, so these have no row."""
    return decode_bytes(spark.read.format("binaryFile").load(path).select("path", "content")).drop("content")


FENCE = r"(?<![^\n]) *```[^\n]*"  # a line that opens or closes a fence


def markdown_blocks(text: Column) -> Column:
    """Blocks (text, translatable) of a Markdown text in order: paragraphs end at blank lines, fenced lines stand alone.

    The text is cut at fence lines, so that every second part stands inside a fence, and the others before blank lines: each
    character is looked at a fixed number of times, and no array grows line by line.
    """
    block = lambda t, plain: F.struct(t.alias("text"), F.lit(plain).alias("translatable"))
    fences, parts = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), F.split(text, FENCE)
    none = F.array().cast("array<struct<text:string,translatable:boolean>>")

    def from_blank(q):  # a blank line and the paragraph behind it, or the first paragraph
        blank = F.regexp_extract(q, r"\A *", 0)
        behind = F.when(F.length(q) > F.length(blank), F.array(block(F.substring(q, F.length(blank) + 2, F.length(q)), True))).otherwise(none)
        return F.when(q.rlike(r"\A *(?:\n|\z)"), F.concat(F.array(block(blank, False)), behind)).otherwise(F.array(block(q, True)))

    def of_part(z, i):
        part, next_fence = z["part"], z["fence"]
        edges = (i > 0).cast("int") + next_fence.isNotNull().cast("int")  # newlines of the fence lines beside it
        body = F.substring(part, (i > 0).cast("int") + 1, F.length(part) - edges)
        lines = F.when(i % 2 == 1, F.transform(F.split(body, "\n"), lambda x: block(x, False))).otherwise(F.flatten(F.transform(F.split(body, r"\n(?= *(?:\n|\z))"), from_blank)))
        fence = F.when(next_fence.isNotNull(), F.array(block(next_fence, False))).otherwise(none)
        return F.concat(F.when(F.length(part) < edges, none).otherwise(lines), fence)

    # each part with the fence line behind it; what a lambda names from outside would be computed again for every part
    both = F.zip_with(parts, fences, lambda p, f: F.struct(p.alias("part"), f.alias("fence")))
    return F.flatten(F.transform(both, of_part))
