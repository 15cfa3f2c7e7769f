"""The value-frequency table: which values does each column hold, how often, and where first.

One shuffle answers distinct counts, top values, null tokens, spelling variants, containment and value search for all
columns of all tables. Every value travels in a typed channel (BIGINT, DOUBLE or STRING), so numbers are never printed
before they are aggregated. Texts longer than `long_text` characters are grouped by their SHA-256 and shuffled as 64
hex digits; their full text is read back by row id for the few rows that show it. Partial aggregation runs before the
shuffle, so a value that fills a third of all rows sends one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..tables import Table, TableSet

LONG_TEXT = 256
DAY_MICROS = 86_400_000_000
KEYS = ["column_no", "value_i", "value_d", "value_s", "digest"]


def micros(c: Column) -> Column:
    """Wall-clock microseconds since 1970 of a timestamp without zone, by calendar arithmetic (no session zone)."""
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    fraction = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * DAY_MICROS + seconds.cast("long") * 1_000_000 + fraction


def channels(table: Table, f: T.StructField, long_text: int) -> list[Column]:
    """(BIGINT, DOUBLE, STRING, digest) of one column; exactly one is set for a value, none for NULL."""
    c, kind = F.col(f"`{f.name}`"), table.kind(f)
    whole, real = F.lit(None).cast("long"), F.lit(None).cast("double")
    text = F.lit(None).cast("string")
    if isinstance(f.dataType, T.StructType) and kind == "mixed":
        real, text = F.when(c["txt"].isNull(), c["num"]), c["txt"]
    elif isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
        whole = c.cast("long")
    elif isinstance(f.dataType, T.DateType):
        whole = F.unix_date(c).cast("long")
    elif isinstance(f.dataType, T.TimestampNTZType):
        whole = micros(c)
    elif isinstance(f.dataType, T.TimestampType):
        whole = F.unix_micros(c)
    elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
        real = c.cast("double")
    else:
        text = c if isinstance(f.dataType, T.StringType) else F.to_json(c)
    if not isinstance(f.dataType, T.StringType) and kind != "mixed" and kind != "nested":
        return [whole, real, text, text]
    long = F.length(text) > long_text
    return [whole, real, F.when(~long, text), F.when(long, F.sha2(text, 256))]


def long_cells(tables: TableSet, table: Table, long_text: int = LONG_TEXT, columns: list[str] | None = None) -> DataFrame:
    """(row_id, column_no, value_i, value_d, value_s, digest), one row per non-null cell."""
    fields = [f for f in table.fields if columns is None or f.name in columns]
    args: list[Column] = [F.lit(len(fields))]
    for f in fields:
        args += [F.lit(tables.number(table, f.name)), *channels(table, f, long_text)]
    cells = table.df.select(table.row_column.alias("row_id"), F.stack(*args).alias(*KEYS))
    return cells.filter("value_i IS NOT NULL OR value_d IS NOT NULL OR value_s IS NOT NULL OR digest IS NOT NULL")


def all_cells(tables: TableSet, long_text: int = LONG_TEXT) -> DataFrame:
    return reduce(DataFrame.unionByName, [long_cells(tables, t, long_text) for t in tables.tables])


def value_frequencies(tables: TableSet, long_text: int = LONG_TEXT) -> DataFrame:
    """KEYS + cnt + first_row for all columns of all tables."""
    return count_values(all_cells(tables, long_text))


def count_values(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cnt"), F.min("row_id").alias("first_row"))


def merge_frequencies(parts: DataFrame) -> DataFrame:
    """Frequencies are additive: parts counted at different times merge into the whole."""
    return parts.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"))


def value_text(kind: Column) -> Column:
    """A frequency value as text (dates and times in ISO form; a long text by its digest)."""
    day = F.floor(F.col("value_i") / DAY_MICROS)
    rest = F.col("value_i") - day * DAY_MICROS
    second = F.floor(rest / 1_000_000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor((second % 3600) / 60), second % 60)
    fraction = F.when(rest % 1_000_000 != 0, F.format_string(".%06d", rest % 1_000_000)).otherwise("")
    stamp = F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit(" "), clock, fraction)
    whole = (F.when(kind == "date", F.date_from_unix_date(F.col("value_i").cast("int")).cast("string"))
             .when(kind == "datetime", stamp)
             .when(kind == "bool", F.when(F.col("value_i") == 1, "true").otherwise("false"))
             .otherwise(F.col("value_i").cast("string")))
    return F.coalesce("value_s", "digest", whole, F.col("value_d").cast("string"))


def value_number(kind: Column) -> Column:
    return F.when(kind.isin("int", "real", "mixed", "bool"), F.coalesce(F.col("value_d"), F.col("value_i").cast("double")))
