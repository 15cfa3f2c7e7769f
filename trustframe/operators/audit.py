"""Does what was published still match its catalog?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import local_frame
from ..tables import TableSet

ISSUE = "code string, subject string, expected long, actual long"


def audit(catalog: DataFrame, stored: TableSet, deep: bool = True) -> DataFrame:
    """(code, subject, expected, actual) where catalog(table_id, row_count, column_count) and stored tables disagree.

    The shallow check compares schemas only; the deep check counts every stored row.
    """
    spark = stored.spark
    actual = local_frame(spark, [(t.table_id, len(t.fields)) for t in stored.tables], "table_id string, columns long")
    both = catalog.join(actual, "table_id", "left")
    parts = [both.filter("columns IS NULL").select(F.lit("AUDIT_TABLE_MISSING").alias("code"), F.col("table_id").alias("subject"),
                                                   F.lit(None).cast("long").alias("expected"), F.lit(None).cast("long").alias("actual")),
             both.filter("columns <> column_count").select(F.lit("AUDIT_COLUMN_COUNT").alias("code"), F.col("table_id").alias("subject"),
                                                           F.col("column_count").cast("long").alias("expected"),
                                                           F.col("columns").alias("actual"))]
    if deep and stored.tables:
        counts = reduce(DataFrame.unionByName, [t.df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t.table_id).alias("table_id"), "rows")
                                                for t in stored.tables])
        parts.append(catalog.join(counts, "table_id").filter("rows <> row_count").select(
            F.lit("AUDIT_ROW_COUNT").alias("code"), F.col("table_id").alias("subject"), F.col("row_count").cast("long").alias("expected"),
            F.col("rows").alias("actual")))
    return reduce(DataFrame.unionByName, parts)


def log_audit(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """The extraction log (table_id, data_rows, columns, status) against the catalog."""
    both = catalog.join(log, "table_id", "left")

    def issue(code: str, condition: str, expected: str | None = None, actual: str | None = None) -> DataFrame:
        return both.filter(condition).select(F.lit(code).alias("code"), F.col("table_id").alias("subject"),
                                             (F.col(expected) if expected else F.lit(None)).cast("long").alias("expected"),
                                             (F.col(actual) if actual else F.lit(None)).cast("long").alias("actual"))

    return reduce(DataFrame.unionByName, [
        issue("AUDIT_EXTRACTION_LOG", "status IS NULL"), issue("AUDIT_EXTRACTION_STATUS", "status <> 'extracted'"),
        issue("AUDIT_ROW_METADATA", "data_rows <> row_count", "row_count", "data_rows"),
        issue("AUDIT_COLUMN_METADATA", "columns <> column_count", "column_count", "columns")])
