"""Is each table safe to use, and what should be known first?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import local_frame


def _count(df: DataFrame | None, name: str, condition: str | None = None, key: str = "table_id") -> DataFrame | None:
    if df is None:
        return None
    kept = df.filter(condition) if condition else df
    return kept.groupBy(F.col(key).alias("table_id")).agg(F.count(F.lit(1)).alias(name))


def readiness(tables: DataFrame, findings: DataFrame | None = None, flags: DataFrame | None = None, grain: DataFrame | None = None,
              regions: DataFrame | None = None, blind_spots: DataFrame | None = None, mismatches: DataFrame | None = None,
              reconciliation: DataFrame | None = None, lineage: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """One row per table: not_ready, needs_review or ready, with the counts behind it."""
    counts = [_count(findings, "quality_errors", "severity = 'error'"), _count(findings, "quality_warnings", "severity = 'warn'"),
              _count(flags, "totals_rows"), _count(regions, "regions", "kind = 'table'"), _count(blind_spots, "blind_spots"),
              _count(mismatches, "verify_mismatches"), _count(reconciliation, "disagreements", "status = 'partial'", "report_id"),
              _count(lineage, "unresolved_sources", "status <> 'resolved'"), _count(anomalies, "anomalies", "severity = 'warn'")]
    names = ["quality_errors", "quality_warnings", "totals_rows", "regions", "blind_spots", "verify_mismatches", "disagreements",
             "unresolved_sources", "anomalies"]
    rows = tables.select("table_id", "table_name", "source_id")
    for name, part in zip(names, counts):
        rows = rows.withColumn(name, F.lit(0).cast("long")) if part is None else rows.join(part, "table_id", "left")
    rows = rows.fillna(0, names)
    rows = rows.join(grain.select("table_id", F.col("status").alias("grain_status")), "table_id", "left") if grain is not None \
        else rows.withColumn("grain_status", F.lit(None).cast("string"))
    review = ((F.col("quality_errors") > 0) | (F.col("blind_spots") > 0) | (F.col("totals_rows") > 0) | (F.col("regions") > 1)
              | (F.col("disagreements") > 0))
    return rows.withColumn("readiness", F.when(F.col("verify_mismatches") > 0, "not_ready").when(review, "needs_review")
                           .otherwise("ready"))


def gaps(ready: DataFrame, rule_results: DataFrame | None = None, sources_fresh: bool = True, promoted: bool = True) -> DataFrame:
    """(kind, table_id, message): everything a reader should know before using the data."""
    parts = []

    def per_table(kind: str, condition: Column, message: Column) -> None:
        parts.append(ready.filter(condition).select(F.lit(kind).alias("kind"), "table_id", message.alias("message")))

    review = F.col("readiness") == "needs_review"
    per_table("verification_mismatch", F.col("readiness") == "not_ready", F.lit("stored data did not verify against its source"))
    for kind, column, text in [("blind_spot", "blind_spots", "%d thing(s) could not be read"),
                               ("quality_error", "quality_errors", "%d quality finding(s) of severity error"),
                               ("totals_row_in_data", "totals_rows", "%d total row(s) inside the data"),
                               ("report_disagrees_with_data", "disagreements", "%d report column(s) differ from the raw data")]:
        per_table(kind, review & (F.col(column) > 0), F.format_string(text, column))
    per_table("several_tables_in_sheet", review & (F.col("regions") > 1), F.format_string("%d separate tables stored as one", "regions"))
    per_table("depends_on_unextracted", F.col("unresolved_sources") > 0,
              F.format_string("%d reference(s) to data outside this project", "unresolved_sources"))
    per_table("grain_unknown", F.col("grain_status") == "unknown", F.lit("no column or pair identifies a row"))
    spark = ready.sparkSession
    run = [] if sources_fresh else [("stale", None, "one or more sources changed since this run")]
    run += [] if promoted else [("not_promoted", None, "this run was not published")]
    parts.append(local_frame(spark, run, "kind string, table_id string, message string"))
    if rule_results is not None:
        failed = rule_results.agg(F.count_if(F.col("status") == "error").alias("e"),
                                  F.count_if((F.col("status") == "fail") & (F.col("severity") == "error")).alias("f"))
        none = F.lit(None).cast("string")
        parts.append(failed.filter("e > 0").select(F.lit("rule_errors").alias("kind"), none.alias("table_id"),
                                                   F.format_string("%d rule(s) could not run", "e").alias("message")))
        parts.append(failed.filter("f > 0").select(F.lit("rule_failures").alias("kind"), none.alias("table_id"),
                                                   F.format_string("%d blocking rule(s) failed", "f").alias("message")))
    return reduce(DataFrame.unionByName, parts)


def verdict(ready: DataFrame, gap_rows: DataFrame) -> DataFrame:
    """0 ready, 1 usable after reading the gaps, 2 not ready."""
    level = F.when(F.col("kind").isin("stale", "not_promoted", "verification_mismatch"), 2).when(
        F.col("kind").isin("rule_errors", "rule_failures"), 1).otherwise(0)
    tables = ready.select(F.when(F.col("readiness") == "not_ready", 2).when(F.col("readiness") == "needs_review", 1).otherwise(0).alias("v"))
    return tables.unionByName(gap_rows.select(level.alias("v"))).agg(F.coalesce(F.max("v"), F.lit(0)).alias("verdict"))


def report(tables: DataFrame, profiles: DataFrame, groups: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(metric, key, value): how many sources, tables and rows, and counts per severity, status or kind."""
    sizes = profiles.groupBy("table_id").agg(F.max("row_count").alias("r"))
    counts = tables.join(sizes, "table_id", "left").agg(F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("tables"),
                                                        F.coalesce(F.sum("r"), F.lit(0)).alias("rows"))
    parts = [counts.select(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(m).cast("long").alias("value"))
             for m in ("sources", "tables", "rows")]
    for metric, (df, column) in groups.items():
        parts.append(df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("value"))
                     .select(F.lit(metric).alias("metric"), "key", "value"))
    return reduce(DataFrame.unionByName, parts)
