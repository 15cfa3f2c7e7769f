"""Formula lineage: which sheet or workbook a computed column draws on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import stable_id

# one sheet reference: a quoted name, or a bare one that may carry a [book] and a sheet span, followed by '!'
_BARE = r"[^\s!'(),+\-*/^&=<>;:{}\"\[\]]+"
REFERENCE = rf"(?U)'(?:[^']|'')+'!|(?<![\w.\]'])(?:\[[^\]]+\])?{_BARE}(?::{_BARE})?!"


def formula_refs(formula: Column) -> Column:
    """array<struct(book, sheet)> in first-seen order; text inside string literals does not count."""
    text = F.regexp_replace(formula, '"(?:[^"]|"")*"', '""')
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))

    def split(token: Column) -> Column:
        bare = F.regexp_replace(token, "!$", "")
        quoted = bare.startswith("'")
        name = F.when(quoted, F.replace(F.regexp_replace(bare, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(bare)
        book = F.trim(F.regexp_extract(name, r"\[([^\]]+)\][^\]]*$", 1))
        sheet = F.trim(F.regexp_replace(name, r"^.*\[[^\]]+\]", ""))
        return F.struct(F.when(book != "", book).alias("book"), sheet.alias("sheet"))

    return F.coalesce(F.array_distinct(F.filter(F.transform(found, split), lambda r: r["sheet"] != "")), F.array())


def reference_counts(formulas: DataFrame) -> DataFrame:
    """(table_id, column_id, book, sheet, cells, sample): formulas(table_id, column_id, formula), one row per formula cell."""
    refs = formulas.select("table_id", "column_id", "formula", F.explode(formula_refs(F.col("formula"))).alias("r"))
    return refs.groupBy("table_id", "column_id", F.col("r.book").alias("book"), F.col("r.sheet").alias("sheet")).agg(
        F.count(F.lit(1)).alias("cells"), F.min("formula").alias("sample"))


def lineage(references: DataFrame, tables: DataFrame, sources: DataFrame) -> DataFrame:
    """Resolve references. tables(table_id, source_id, table_name), sources(source_id, path).

    A workbook is known by its file name, by the name without extension, or by its source id. References to the own
    sheet are arithmetic, not lineage.
    """
    def norm(c: Column) -> Column:
        return F.lower(F.trim(c))

    def stem(c: Column) -> Column:
        return F.regexp_replace(c, r"\.[^.]*$", "")

    base = F.regexp_extract("path", r"([^/\\]+)$", 1)
    books = sources.select("source_id", F.explode(F.array(norm(base), norm(stem(base)), norm(F.col("source_id")))).alias("book_key"))
    books = books.filter("book_key <> ''").groupBy("book_key").agg(F.min("source_id").alias("target_source"))
    sheets = tables.select(F.col("source_id").alias("target_source"), norm(F.col("table_name")).alias("sheet_key"),
                           F.col("table_id").alias("target_table_id"))
    own = tables.select("table_id", F.col("source_id").alias("own_source"))
    rows = references.join(own, "table_id", "left").withColumn("exact", norm(F.col("book"))).withColumn("loose", norm(stem(F.col("book"))))
    rows = (rows.join(books.toDF("exact", "by_exact"), "exact", "left").join(books.toDF("loose", "by_loose"), "loose", "left"))
    in_book = F.col("book").isNotNull()
    rows = rows.withColumn("target_source", F.when(in_book, F.coalesce("by_exact", "by_loose")).otherwise(F.col("own_source")))
    rows = rows.withColumn("sheet_key", norm(F.col("sheet"))).join(sheets, ["target_source", "sheet_key"], "left")
    rows = rows.filter(F.col("target_table_id").isNull() | (F.col("target_table_id") != F.col("table_id")))
    status = (F.when(F.col("target_table_id").isNotNull(), "resolved")
              .when(in_book & F.col("target_source").isNull(), "external").otherwise("unresolved"))
    return rows.select(stable_id(F.col("column_id"), F.col("book"), F.col("sheet")).alias("lineage_id"), "table_id", "column_id",
                       F.when(in_book, "workbook").otherwise("sheet").alias("ref_kind"), "book", "sheet", "target_source",
                       "target_table_id", status.alias("status"), "cells", "sample", F.lit("all_formulas").alias("method"))
