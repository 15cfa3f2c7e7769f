"""Where does a term occur: table names, column names, group headers, definitions, frequent values and data cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fold
from ..tables import TableSet
from .repair import text_cells

ORDER = ["table", "column", "column_group", "definition", "value", "data"]


def find(tables: TableSet, text: str, profiles: DataFrame | None = None, dictionary: DataFrame | None = None,
         header_groups: DataFrame | None = None, values: bool = False) -> DataFrame:
    """(kind, table_id, column_name, matched, detail, exact), exact matches first.

    profiles need `top_k` and `sample`; with `values` every text cell of every table is searched in full.
    """
    needle = fold(F.lit(text))

    def hits(df: DataFrame, kind: str, table_id: Column, column: Column, matched: Column, detail: Column) -> DataFrame:
        return df.filter(F.contains(fold(matched), needle)).select(
            F.lit(kind).alias("kind"), table_id.alias("table_id"), column.alias("column_name"), matched.alias("matched"),
            detail.alias("detail"), (fold(matched) == needle).alias("exact"))

    none = F.lit(None).cast("string")
    catalog, columns = tables.catalog(), tables.columns()
    parts = [hits(catalog, "table", F.col("table_id"), none, F.col("table_name"), F.concat(F.lit("in "), "source_id"))]
    label = F.when(F.contains(fold(F.col("column_name")), needle), F.col("column_name")).otherwise(F.col("original_header"))
    parts.append(hits(columns.filter(label.isNotNull()), "column", F.col("table_id"), F.col("column_name"), label,
                      F.lit("column name or header")))
    if header_groups is not None:
        flat = header_groups.select("table_id", "column_name", F.explode("path").alias("label")).distinct()
        parts.append(hits(flat, "column_group", F.col("table_id"), F.col("column_name"), F.col("label"), F.lit("group header")))
    if dictionary is not None:
        either = F.contains(fold(F.col("term")), needle) | F.contains(fold(F.col("meaning")), needle)
        parts.append(dictionary.filter(either).select(F.lit("definition").alias("kind"), none.alias("table_id"),
                                                      F.col("applies_to").alias("column_name"), F.col("term").alias("matched"),
                                                      F.col("meaning").alias("detail"), (fold(F.col("term")) == needle).alias("exact")))
    if profiles is not None:
        seen = F.array_union(F.coalesce(F.col("top_k.value"), F.array().cast("array<string>")),
                             F.coalesce(F.col("sample"), F.array().cast("array<string>")))
        flat = profiles.select("table_id", "column_name", F.explode(seen).alias("v"))
        parts.append(hits(flat, "value", F.col("table_id"), F.col("column_name"), F.col("v"), F.lit("frequent or sampled value")))
    if values:
        cells = text_cells(tables).filter(F.contains(fold(F.col("txt")), needle))
        found = cells.groupBy("column_no").agg(F.count(F.lit(1)).alias("n"), F.min("txt").alias("example"), F.min("row_id").alias("first"))
        found = found.join(columns.select("column_no", "table_id", "column_name"), "column_no")
        parts.append(found.select(F.lit("data").alias("kind"), "table_id", "column_name", F.col("example").alias("matched"),
                                  F.format_string("%d row(s); first at row %d", "n", "first").alias("detail"),
                                  (fold(F.col("example")) == needle).alias("exact")))
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("exact"), rank, "table_id", "column_name")
