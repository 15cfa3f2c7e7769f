"""Unusual values: extreme amounts, rare negatives, month jumps and gaps, impossible dates. Unusual is not wrong."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..tables import TableSet
from .digest import Choice
from .quality import without_flagged
from .quantiles import order_statistics

ANOMALY = "table_id string, column_name string, kind string, severity string, count long, detail string, examples array<string>"


def measure_values(tables: TableSet, choices: list[Choice], flags: DataFrame) -> DataFrame | None:
    """(column_no, row_id, v) of every chosen measure, without flagged rows."""
    parts = []
    for c in (c for c in choices if not c.skipped and c.measures):
        args = [F.lit(len(c.measures))]
        for m, _, _ in c.measures:
            args += [F.lit(tables.number(c.table, m)), F.col(f"`{m}`").cast("double")]
        rows = without_flagged(c.table, flags).select(c.table.row_column.alias("row_id"), F.stack(*args).alias("column_no", "v"))
        parts.append(rows.filter("v IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _examples(rows: DataFrame, order: list[Column], value: Column, keys: list[str]) -> DataFrame:
    """The first five rows per key as 'row: value' texts; the rank filter limits every task to five rows per key."""
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col("at") <= V.EXAMPLES)
    shown = F.concat(F.col("row_id").cast("string"), F.lit(": "), value)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("x"))))["x"].alias("examples"))


def outliers(values: DataFrame, fence: float = V.OUTLIER_FENCE) -> DataFrame:
    """(column_no, n, q1, median, q3, low, high, count, severity, examples) for columns with values beyond the fences."""
    q = order_statistics(values).select("column_no", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                                        F.col("q")[2].alias("q3"))
    spread = F.col("q3") - F.col("q1")
    # one row per measure column: bounded by the columns
    q = q.filter((F.col("n") >= V.MIN_OUTLIER_ROWS) & (spread > 0)).select(
        "*", (F.col("q1") - fence * spread).alias("low"), (F.col("q3") + fence * spread).alias("high"))
    beyond = values.join(F.broadcast(q), "column_no").filter("v < low OR v > high")
    counts = beyond.groupBy("column_no", "n", "q1", "median", "q3", "low", "high").agg(F.count(F.lit(1)).alias("count"))
    worst = _examples(beyond, [F.desc(F.abs(F.col("v") - F.col("median"))), F.col("row_id")], F.col("v").cast("string"), ["column_no"])
    share = F.col("count") / F.col("n")
    return counts.withColumn("severity", F.when(share < 0.01, "warn").otherwise("info")).join(worst, "column_no")


def rare_negatives(values: DataFrame) -> DataFrame:
    negative = F.col("v") < 0
    counts = values.groupBy("column_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(negative).alias("count"))
    rare = counts.filter((F.col("n") >= V.MIN_OUTLIER_ROWS) & (F.col("count") > 0) & (F.col("count") <= V.NEGATIVE_SHARE * F.col("n")))
    lowest = _examples(values.filter(negative), [F.col("v"), F.col("row_id")], F.col("v").cast("string"), ["column_no"])
    return rare.join(lowest, "column_no")


def missing_months(series: DataFrame) -> DataFrame:
    """(table_id, dim, month): months without rows inside the covered range (series: by_month rows of all months)."""
    span = series.groupBy("table_id", "dim").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    first, last = (F.to_date(F.concat(c, F.lit("-01"))) for c in ("first", "last"))
    every = span.select("table_id", "dim", F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("d"))
    calendar = every.select("table_id", "dim", F.date_format("d", "yyyy-MM").alias("key"))
    return calendar.join(series.select("table_id", "dim", "key"), ["table_id", "dim", "key"], "left_anti").withColumnRenamed("key", "month")


def trend_jumps(series: DataFrame) -> DataFrame:
    """Months whose robust z-score (median and median absolute deviation) reaches 3.5; at least six months are needed.

    A series has one row per month, so the grouped medians are small.
    """
    v = F.coalesce("value", F.lit(0.0))
    rows = series.select("table_id", "dim", "measure", "key", v.alias("v"))
    center = rows.groupBy("table_id", "dim").agg(F.median("v").alias("med"), F.count(F.lit(1)).alias("months"))
    rows = rows.join(center, ["table_id", "dim"]).filter("months >= 6")
    spread = rows.groupBy("table_id", "dim").agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    z = 0.6745 * (F.col("v") - F.col("med")) / F.col("mad")
    jumps = rows.join(spread.filter("mad > 0"), ["table_id", "dim"]).withColumn("z", z).filter(F.abs("z") >= V.TREND_Z)
    return jumps.select("table_id", "dim", "measure", F.col("key").alias("month"), F.col("v").alias("value"), "med", "z")


def dates_out_of_range(choices: list[Choice], flags: DataFrame, as_of: dt.date) -> DataFrame | None:
    """(table_id, column_name, row_id, d): dates before 1990 or more than a year after `as_of`."""
    last = as_of.replace(year=as_of.year + 1, day=min(as_of.day, 28) if as_of.month == 2 else as_of.day)
    parts = []
    for c in (c for c in choices if not c.skipped and c.date):
        d = F.col(f"`{c.date}`").cast("timestamp_ntz")
        rows = without_flagged(c.table, flags).select(F.lit(c.table.table_id).alias("table_id"), F.lit(c.date).alias("column_name"),
                                                      c.table.row_column.alias("row_id"), d.alias("d"))
        low, high = F.lit("1990-01-01").cast("timestamp_ntz"), F.lit(last.isoformat()).cast("timestamp_ntz")
        parts.append(rows.filter((F.col("d") < low) | (F.col("d") > high)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def anomalies(tables: TableSet, choices: list[Choice], digest: DataFrame, flags: DataFrame, as_of: dt.date) -> DataFrame:
    """All findings in one shape: table_id, column_name, kind, severity, count, detail, examples."""
    columns = tables.columns().select("column_no", "table_id", "column_name")
    series = digest.filter("section = 'by_month'")
    parts = []
    values = measure_values(tables, choices, flags)
    if values is not None:
        out = outliers(values).join(columns, "column_no")
        parts.append(out.select("table_id", "column_name", F.lit("outlier").alias("kind"), "severity", "count",
                                F.format_string("%d value(s) outside %s .. %s (median %s)", "count", F.col("low").cast("string"),
                                                F.col("high").cast("string"), F.col("median").cast("string")).alias("detail"), "examples"))
        neg = rare_negatives(values).join(columns, "column_no")
        parts.append(neg.select("table_id", "column_name", F.lit("negative").alias("kind"), F.lit("info").alias("severity"), "count",
                                F.format_string("%d negative value(s) in a column that is otherwise positive", "count").alias("detail"),
                                "examples"))
    gone = missing_months(series).groupBy("table_id", "dim").agg(F.count(F.lit(1)).alias("count"),
                                                                 F.slice(F.array_sort(F.collect_list("month")), 1, 12).alias("examples"))
    parts.append(gone.select("table_id", F.col("dim").alias("column_name"), F.lit("missing_period").alias("kind"),
                             F.lit("warn").alias("severity"), "count",
                             F.format_string("no rows for %d month(s) inside the covered range", "count").alias("detail"), "examples"))
    shown = F.concat("month", F.lit(": "), F.when(F.col("z") > 0, "up").otherwise("down"))
    jump = trend_jumps(series).groupBy("table_id", "dim").agg(F.count(F.lit(1)).alias("count"),
                                                              F.slice(F.array_sort(F.collect_list(shown)), 1, V.EXAMPLES).alias("examples"))
    parts.append(jump.select("table_id", F.col("dim").alias("column_name"), F.lit("trend_jump").alias("kind"),
                             F.lit("info").alias("severity"), "count",
                             F.format_string("%d month(s) far from the usual level", "count").alias("detail"), "examples"))
    dates = dates_out_of_range(choices, flags, as_of)
    if dates is not None:
        keys = ["table_id", "column_name"]
        counts = dates.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).withColumn("examples", F.lit(None).cast("array<string>"))
        first = _examples(dates, [F.col("d"), F.col("row_id")], F.col("d").cast("string"), keys).withColumn("count", F.lit(None).cast("long"))
        both = counts.unionByName(first).groupBy(*keys).agg(F.max("count").alias("count"), F.first("examples", ignorenulls=True).alias("examples"))
        parts.append(both.select(*keys, F.lit("date_out_of_range").alias("kind"), F.lit("warn").alias("severity"), "count",
                                 F.format_string("%d date(s) before 1990 or far ahead", "count").alias("detail"), "examples"))
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.lit("inferred"))


