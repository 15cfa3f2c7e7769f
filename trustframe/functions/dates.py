"""Spreadsheet date serials, number formats and month keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import plain_number


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def format_class(c: Column) -> Column:
    """'date', 'datetime', 'time' or NULL for a number-format string."""
    first = F.split_part(c, F.lit(";"), F.lit(1))
    bare = F.lower(F.regexp_replace(first, r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', ""))
    plain = F.contains(bare, F.lit("general")) | bare.rlike("e[+-]")
    has_date, has_time = bare.rlike("[yd]|m{3,}"), bare.rlike("[hs]|am/pm")
    return (F.when(c.isNull() | (c == "") | plain, None)
            .when(has_date & has_time, "datetime").when(has_date, "date").when(has_time, "time"))


def clock(seconds: Column) -> Column:
    """Elapsed seconds as HH:MM:SS (hours may exceed 24)."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def serial_to_iso(v: Column, kind: Column, is_1904: Column) -> Column:
    """Spreadsheet serial day -> ISO text. The 1900 system counts a 29 February 1900 that never was."""
    day = F.floor(v)
    seconds = F.rint((v - day) * 86400)
    early = ~is_1904 & (v < 61)
    epoch = (F.when(is_1904, F.to_date(F.lit("1904-01-01")))
             .when(early, F.to_date(F.lit("1899-12-31"))).otherwise(F.to_date(F.lit("1899-12-30"))))
    carry = F.floor(seconds / 86400)
    date_text = F.date_format(F.date_add(epoch, day.cast("int")), "yyyy-MM-dd")
    stamp_text = F.concat(F.date_format(F.date_add(epoch, (day + carry).cast("int")), "yyyy-MM-dd"), F.lit(" "),
                          clock(seconds - carry * 86400))
    in_range = (v >= 0) & (v < 2958466)
    return (F.when(kind == "time", clock(F.rint(v * 86400)))
            .when(~in_range, plain_number(v))
            .when(early & (v < 1) & (kind == "datetime"), clock(F.rint(v * 86400)))
            .when(early & (v < 1), "1900-01-00")
            .when(early & (v >= 60), "1900-02-29")
            .when(kind == "datetime", stamp_text)
            .otherwise(date_text))


def stamp_to_iso(c: Column) -> Column:
    """A timestamp as ISO text: the time part is dropped at midnight; the spreadsheet zero day shows time only."""
    time_only = (F.year(c) <= 1899) & (F.month(c) == 12) & (F.dayofmonth(c) == 30)
    at_midnight = (F.hour(c) == 0) & (F.minute(c) == 0) & (F.second(c) == 0)
    return (F.when(time_only, F.date_format(c, "HH:mm:ss"))
            .when(at_midnight, F.date_format(c, "yyyy-MM-dd"))
            .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss")))
