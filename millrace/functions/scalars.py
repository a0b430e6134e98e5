"""Scalar functions of the query surface, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def d8(col) -> Column:
    """A timestamp as an 8-digit day."""
    return F.date_format(col, "yyyyMMdd")


def parse_d8(col) -> Column:
    """An 8-digit day as a date; null where it isn't one."""
    return F.try_to_date(col, "yyyyMMdd")


def quarter_of(day: Column) -> Column:
    return F.concat(F.substring(day, 1, 4), F.lit("Q"), ((F.substring(day, 5, 2).cast("int") + 2) / 3).cast("int").cast("string"))


def nice_threshold(x: Column) -> Column:
    """A number rounded, half to even, to the unit that is usual for its size."""
    out = F.bround(x, 0)
    for unit in (100, 10_000, 100_000_000):
        out = F.when(F.abs(x) >= unit, F.bround(x / unit, 0) * unit).otherwise(out)
    return out


def squash(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Ordered rules that turn a question or statement into its shape: quoted text, dates, numbers with units, numbers.
SHAPE_RULES = [(r"'[^']*'", "<str>"), (r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}", "<date>"), (r"\b[0-9]{8}\b", "<date>"), (r"[0-9]+(\.[0-9]+)?%", "<pct>"), (r"[0-9]+(\.[0-9]+)?", "<num>")]


def mask_literals(text: Column) -> Column:
    for pattern, name in SHAPE_RULES:
        text = F.regexp_replace(text, pattern, name)
    return text


def mask_literals_sql(x: str) -> str:
    for pattern, name in SHAPE_RULES:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{name}', 'g')"
    return x
