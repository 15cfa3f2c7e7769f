"""Quality findings and flagged rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import stable_id
from ..functions.text import is_null_token, is_totals_label
from ..tables import Table, TableSet
from .frequencies import value_frequencies
from .profile import profile

FINDING = ["finding_id", "code", "severity", "table_id", "column_id", "count", "examples", "message"]


def text_columns(table: Table) -> list[tuple[str, Column]]:
    found = []
    for f in table.fields:
        if isinstance(f.dataType, T.StringType):
            found.append((f.name, F.col(f"`{f.name}`")))
        elif table.kind(f) == "mixed":
            found.append((f.name, F.col(f"`{f.name}`")["txt"]))
    return found


def totals_rows(tables: TableSet) -> DataFrame:
    """(table_id, row_id, flag, detail): rows whose first matching text cell reads as a total. A map-only scan."""
    parts = []
    for t in tables.tables:
        labels = [F.when(is_totals_label(c), c) for _, c in text_columns(t)]
        if labels:
            parts.append(t.df.select(F.lit(t.table_id).alias("table_id"), t.row_column.alias("row_id"),
                                     F.lit("totals_candidate").alias("flag"), F.coalesce(*labels).alias("detail"))
                         .filter("detail IS NOT NULL"))
    if not parts:
        return tables.spark.createDataFrame([], "table_id string, row_id long, flag string, detail string")
    return reduce(DataFrame.unionByName, parts)


def without_flagged(table: Table, flags: DataFrame) -> DataFrame:
    """The table without its flagged rows. Flags are few; Spark broadcasts them only while they are."""
    mine = flags.filter(F.col("table_id") == table.table_id).select(F.col("row_id").alias("_flagged")).distinct()
    return table.df.withColumn("_at", table.row_column).join(mine, F.col("_at") == F.col("_flagged"), "left_anti").drop("_at")


def null_tokens(tables: TableSet, frequencies: DataFrame | None = None) -> DataFrame:
    """Texts that stand for a missing value, per column, with up to three spellings."""
    frequencies = value_frequencies(tables) if frequencies is None else frequencies
    hits = frequencies.filter(is_null_token(F.col("value_s")))
    return hits.groupBy("column_no").agg(
        F.sum("cnt").alias("count"),
        F.slice(F.array_sort(F.collect_set("value_s")), 1, 3).alias("examples"))


def _finding(df: DataFrame, code: str, severity: Column | str, count: Column, examples: Column, message: Column | str,
             column_id: Column | None = None) -> DataFrame:
    column_id = F.lit(None).cast("string") if column_id is None else column_id
    as_column = [F.lit(x) if isinstance(x, str) else x for x in (severity, message)]
    return df.select(
        stable_id(F.lit(code), F.coalesce(column_id, F.col("table_id"))).alias("finding_id"), F.lit(code).alias("code"),
        as_column[0].alias("severity"), F.col("table_id"), column_id.alias("column_id"), count.cast("long").alias("count"),
        examples.cast("array<string>").alias("examples"), as_column[1].alias("message"))


def findings(tables: TableSet, profiles: DataFrame | None = None, frequencies: DataFrame | None = None,
             flags: DataFrame | None = None) -> DataFrame:
    """All findings in one shape: finding_id, code, severity, table_id, column_id, count, examples, message."""
    frequencies = value_frequencies(tables) if frequencies is None else frequencies
    profiles = profile(tables, frequencies) if profiles is None else profiles
    flags = totals_rows(tables) if flags is None else flags
    catalog, none, cid = tables.catalog(), F.array(), F.col("column_id")
    null_share = F.try_divide(F.col("nulls"), F.col("row_count"))
    generated = tables.columns().groupBy("table_id").agg(
        F.avg(F.col("original_header").isNull().cast("int")).alias("share"),
        F.sum(F.col("original_header").isNull().cast("int")).alias("generated"))
    tokens = null_tokens(tables, frequencies).join(tables.columns().select("column_no", "column_id", "table_id"), "column_no")
    flagged = flags.groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"),
                                            F.slice(F.array_sort(F.collect_set("detail")), 1, 3).alias("labels"))
    parts = [
        _finding(catalog.filter("header_row IS NULL"), "DQ_HEADER_UNDETECTED", "info", F.lit(1), none,
                 "no header row was detected; column names were generated"),
        _finding(catalog.filter("column_count >= 500"), "DQ_VERY_WIDE", "warn", F.col("column_count"), none,
                 "very wide table; several regions may have been flattened together"),
        _finding(catalog.filter("formula_cells > 0"), "DQ_FORMULAS_VALUE_ONLY", "warn", F.col("formula_cells"), none,
                 "formula results are stored as values; lineage names their sources"),
        _finding(catalog.filter("pivot_tables > 0"), "DQ_PIVOT_OUTPUT_ONLY", "warn", F.col("pivot_tables"), none,
                 "pivot output is stored; its definition is not"),
        _finding(catalog.filter("merged_in_data > 0"), "DQ_MERGED_IN_DATA", "warn", F.lit(1), none,
                 "merged cells inside the data: only their first cell holds a value"),
        _finding(generated.filter("share >= 0.5"), "DQ_HEADER_LOW_CONFIDENCE", "warn", F.col("generated"), none,
                 "at least half the column names were generated"),
        _finding(profiles.filter(null_share >= 0.5), "DQ_HIGH_NULL", F.when(null_share >= 0.9, "error").otherwise("warn"),
                 F.col("nulls"), none, F.format_string("%d of %d rows are null", "nulls", "row_count"), cid),
        _finding(profiles.filter("n > 1 AND distinct_count = 1"), "DQ_CONSTANT", "info", F.col("n"), none,
                 "column has one non-null value", cid),
        _finding(profiles.filter("error_cells > 0"), "DQ_EXCEL_ERRORS", "warn", F.col("error_cells"), none,
                 "error cells are stored as NULL", cid),
        _finding(profiles.filter("kind = 'mixed'"), "DQ_MIXED_TYPE", "warn", F.col("n"), none,
                 "column holds several value types", cid),
        _finding(profiles.filter("original_header IS NULL"), "DQ_GENERATED_HEADER", "info", F.lit(1),
                 F.array("column_name"), "column name was generated: no header text", cid),
        _finding(tokens, "DQ_NULL_TOKEN", "warn", F.col("count"), F.col("examples"),
                 "texts that look like missing values; nothing was changed", cid),
        _finding(flagged, "DQ_TOTALS_ROW_IN_DATA", "warn", F.col("rows"), F.col("labels"),
                 "total rows inside the data; a plain sum counts them twice"),
    ]
    return reduce(DataFrame.unionByName, parts)


def severity_rank(c: Column) -> Column:
    return F.when(c == "error", 0).when(c == "warn", 1).otherwise(2)
