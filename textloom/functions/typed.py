"""Strict parsing of text fields into types, with an error for each field that is none, and their canonical text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column's kind (text, bool, time, uuid or enum), whether it may be empty, and an enum's values."""

    kind: str
    required: bool = True
    values: tuple[str, ...] = ()


_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?"
_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def _parsed(c: Column, f: Field) -> tuple[Column, Column]:
    """The value, and the error's code (null if none)."""
    empty = c.isNull() | (c == "")
    if f.kind == "bool":
        low = F.lower(F.trim(c))
        value = F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
        bad = F.when(value.isNull(), "bool")
    elif f.kind == "time":
        local = c.rlike(_TIME + "$")
        value = F.when(c.rlike(_TIME + _ZONE), F.try_to_timestamp(F.regexp_replace(c, " ", "T")))
        bad = F.when(local & F.try_to_timestamp(F.concat(F.regexp_replace(c, " ", "T"), F.lit("Z"))).isNotNull(), "zone").when(value.isNull(), "time")
    elif f.kind == "uuid":
        digits = F.lower(F.regexp_replace(F.regexp_replace(F.replace(F.replace(c, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")), r"^[{}]+|[{}]+$", ""), "-", ""))
        value = F.when(digits.rlike("^[0-9a-f]{32}$"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        bad = F.when(value.isNull(), "uuid")
    elif f.kind == "enum":
        value = F.when(c.isin(*f.values), c)
        bad = F.when(value.isNull(), "enum")
    else:
        value, bad = F.when(~empty, c), F.lit(None).cast("string")
    return F.when(~empty, value), F.when(empty, F.lit("empty") if f.required else None).otherwise(bad)


def parse(df: DataFrame, fields: dict[str, Field], errors: str = "errors") -> DataFrame:
    """``df`` with the stated text columns as values of their kinds and ``errors``, an array of (column, code, value), empty for a
    row without any. Codes: ``empty``, the kind, or ``zone`` for a time that names none. A field with an error is null."""
    parsed = {name: _parsed(F.col(name), f) for name, f in fields.items()}
    row = [F.when(bad.isNotNull(), F.struct(F.lit(name).alias("column"), bad.alias("code"), F.col(name).alias("value"))) for name, (_, bad) in parsed.items()]
    found = F.array_compact(F.array(*row)).alias(errors)
    return df.select(*(F.when(parsed[c][1].isNull(), parsed[c][0]).alias(c) if c in parsed else F.col(c) for c in df.columns), found)


def split(parsed: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the quarantined ones with theirs."""
    return parsed.where(F.size(errors) == 0).drop(errors), parsed.where(F.size(errors) > 0)


def canonical(c: Column, kind: str) -> Column:
    """A value's text: empty for null, ``true`` and ``false``, a UTC time with its offset and as many digits as it needs."""
    if kind == "bool":
        text = F.when(c, "true").otherwise("false")
    elif kind == "time":
        micros = F.unix_micros(c)
        utc = F.to_utc_timestamp(c, F.current_timezone())
        text = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(micros, F.lit(1_000_000)) != 0, F.date_format(utc, ".SSSSSS")).otherwise(""), F.lit("+00:00"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "").otherwise(text)
