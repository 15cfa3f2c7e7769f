"""Documents linked to rows: entities that occur as values in the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..tables import TableSet

LINK_KINDS = ["code", "email", "phone"]


def mentions(tables: TableSet, entity_rows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(value, kind, source_id, block_id, table_id, column_name, rows, first_row).

    Column values and entity values are reduced to distinct ones before they meet, so the join sees each value once
    per column; the occurrences join the few values that matched.
    """
    columns = tables.columns().filter(F.col("sql_type").isin("TEXT", "BLOB") | (F.col("kind") == "mixed"))
    columns = columns.select("column_no", "table_id", "table_name", "column_name")
    # one row per column: bounded by the columns of the tables
    sizes = frequencies.groupBy("column_no").agg(F.count(F.lit(1)).alias("d")).filter("d >= 2").drop("d")
    key = F.upper(F.trim("value_s"))
    values = (frequencies.filter("value_s IS NOT NULL").join(columns, "column_no").join(F.broadcast(sizes), "column_no", "left_semi")
              .groupBy("table_id", "table_name", "column_name", key.alias("key")).agg(F.sum("cnt").alias("rows"), F.min("first_row").alias("first_row")))
    linkable = entity_rows.filter(F.col("kind").isin(LINK_KINDS)).withColumn("key", F.upper("normalized"))
    matched = values.join(linkable.select("key").distinct(), "key", "left_semi")
    return linkable.join(matched, "key").select(F.col("normalized").alias("value"), "kind", "source_id", "block_id", "table_id", "table_name",
                                                "column_name", "rows", "first_row")


def entity_counts(entity_rows: DataFrame) -> DataFrame:
    distinct = entity_rows.select("source_id", "kind", "normalized").distinct()
    return distinct.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("entities"))


def document_summary(blocks: DataFrame, entity_rows: DataFrame, mention_rows: DataFrame | None = None) -> DataFrame:
    """One row per document: blocks, characters, distinct entities and linked values."""
    base = blocks.groupBy("source_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))
    found = entity_rows.select("source_id", "normalized", "kind").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("entities"))
    out = base.join(found, "source_id", "left")
    if mention_rows is not None:
        linked = mention_rows.select("source_id", "value").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("linked_values"))
        out = out.join(linked, "source_id", "left")
    return out.fillna(0)
