"""Numbers written as text, and numbers written for people."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as V
from .text import normalize_digits


def parse_number(c: Column) -> Column:
    """'1,234.50' -> 1234.5, '(300)' -> -300, '12%' -> 0.12; NULL when the text is not one number."""
    text = F.trim(normalize_digits(c.cast("string")))
    digits = F.regexp_replace(text, r"[^0-9.]", "")
    value = F.when(text.rlike(V.TABLE_NUMBER_PATTERN), digits.try_cast("double"))
    negative = text.startswith("-") | (text.startswith("(") & text.endswith(")"))
    signed = F.when(negative, -value).otherwise(value)
    return F.when(text.rlike(r"%\)?$"), signed / 100).otherwise(signed)


def plain_number(v: Column) -> Column:
    """A double without a needless fraction: 5.0 -> '5', 2.5 -> '2.5'."""
    whole = (v == F.floor(v)) & (F.abs(v) < F.lit(1e15))
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def number_repair(c: Column) -> Column:
    """Canonical text of a number written with separators; NULL when there is nothing to repair."""
    text = F.trim(c)
    bare = F.replace(text, F.lit(","), F.lit(""))
    value = bare.try_cast("double")
    whole = ~F.contains(bare, F.lit("."))
    repaired = F.when(whole, F.coalesce(bare.try_cast("decimal(38,0)").cast("string"), plain_number(value))
                      ).otherwise(value.cast("string"))
    return F.when(text.rlike(V.REPAIR_NUMBER_PATTERN) & value.isNotNull() & (repaired != text), repaired)


def display_number(v: Column) -> Column:
    """Thousands separators; two decimals unless whole; '-' for NULL."""
    whole = (v == F.floor(v)) & (F.abs(v) < F.lit(1e15))
    return F.coalesce(F.when(whole, F.format_number(v, 0)).otherwise(F.format_number(v, 2)), F.lit("-"))


def printable(v: Column) -> Column:
    """A profile value as text: NaN and infinities are named, whole doubles lose their fraction."""
    return (F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
            .otherwise(plain_number(v)))


def close_to(a: Column, b: Column) -> Column:
    """Equal within one millionth of the larger value, or within half a cent."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-6) * F.greatest(F.abs(a), F.abs(b)), F.lit(0.005))
