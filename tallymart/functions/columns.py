"""Column expressions of the preprocessing; all of them run inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymart.specs import NULL_TOKENS


def null_if_token(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(c.isin(*tokens), F.lit(None)).otherwise(c)


def clean_text(c: Column, lowercase: bool = False) -> Column:
    """Unicode white space trimmed and collapsed to one space."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.lower(out) if lowercase else out


def to_timestamp(c: Column) -> Column:
    """Null where it does not parse."""
    return F.try_to_timestamp(c)


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def to_integer(c: Column) -> Column:
    """A whole number, null where it is none: fractions are not cut off. Digits are read as they stand, so keys beyond
    2^53 stay exact; what is no plain integer (1e3, 7.0) goes through a double."""
    x = c.try_cast("double")
    return F.when(x == F.floor(x), F.coalesce(c.try_cast("bigint"), x.cast("long")))


def is_fraction(c: Column) -> Column:
    """A number that to_integer gives up."""
    x = c.try_cast("double")
    return x.isNotNull() & (x != F.floor(x))


def code(c: Column) -> Column:
    """A code: trimmed, upper case."""
    return F.trim(F.upper(c))


def blank_to_null(c: Column, lowercase: bool = True) -> Column:
    out = F.nullif(F.trim(c), F.lit(""))
    return F.lower(out) if lowercase else out


def percent(part: Column, whole: Column, digits: int) -> Column:
    """part * 100 / whole, rounded half up; 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole.cast("double")), digits), F.lit(0.0))


def date_key(c: Column) -> Column:
    """yyyyMMdd as an integer."""
    d = F.to_date(c)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")
