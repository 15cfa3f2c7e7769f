"""What changed between two runs: sources, schemas, volumes, contents, rows, categories and KPIs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as V
from ..functions.names import stable_id
from .rows import multiset_difference


@dataclass
class Snapshot:
    """The facts of one run that changes are computed from.

    sources(source_id, sha256); tables(table_id, source_id, table_name, row_count, schema_fingerprint, fingerprint);
    hash_counts(table_id, row_hash, n); columns(table_id, column_name, distinct_count, top_k); kpis(pack, kpi_id, value).
    """

    sources: DataFrame
    tables: DataFrame
    hash_counts: DataFrame
    columns: DataFrame
    kpis: DataFrame


def _change(df: DataFrame, kind: str, severity: Column | str, subject: Column, before: Column, after: Column,
            detail: Column | str) -> DataFrame:
    as_column = [F.lit(x) if isinstance(x, str) else x for x in (severity, detail)]
    return df.select(F.lit(kind).alias("kind"), as_column[0].alias("severity"), subject.alias("subject"),
                     before.cast("string").alias("before"), after.cast("string").alias("after"), as_column[1].alias("detail"))


def baseline(spark: SparkSession, run_id: str) -> DataFrame:
    one = spark.range(1)
    return _change(one, "baseline", "info", F.lit("run"), F.lit(None), F.lit(run_id), "first run")


def _prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys], F.lit(True).alias(f"in_{prefix}"))


def _outer(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return _prefixed(old, "old", keys).join(_prefixed(new, "new", keys), keys, "full_outer")


def table_pairs(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pairs, renamed, removed, added). Unmatched tables pair up when exactly one old table of the same source has the
    new table's schema; each old table is used once."""
    keys = ["source_id", "table_name"]
    same = _prefixed(old, "old", keys).join(_prefixed(new, "new", keys), keys)
    pairs = same.select(F.concat_ws("/", *keys).alias("subject"), F.col("old_table_id").alias("old_id"),
                        F.col("new_table_id").alias("new_id"))
    lost, fresh = old.join(new, keys, "left_anti"), new.join(old, keys, "left_anti")
    cols = ["source_id", "schema_fingerprint"]
    candidates = (lost.select(*cols, F.col("table_id").alias("old_id"), F.col("table_name").alias("old_name"))
                  .join(fresh.select(*cols, F.col("table_id").alias("new_id"), F.col("table_name").alias("new_name")), cols))
    only = candidates.groupBy("new_id", "new_name", *cols).agg(F.count(F.lit(1)).alias("n"), F.min("old_id").alias("old_id"),
                                                               F.min("old_name").alias("old_name")).filter("n = 1")
    taken = only.groupBy("old_id").agg(F.min_by(F.struct("new_id", "new_name", "source_id", "old_name"), "new_id").alias("x"))
    renamed = taken.select("old_id", "x.*").withColumn(
        "subject", F.concat(F.col("source_id"), F.lit("/"), F.col("old_name"), F.lit("->"), F.col("new_name")))
    removed = lost.join(renamed.select(F.col("old_id").alias("table_id")), "table_id", "left_anti")
    added = fresh.join(renamed.select(F.col("new_id").alias("table_id")), "table_id", "left_anti")
    return pairs.unionByName(renamed.select("subject", "old_id", "new_id")), renamed, removed, added


def changes(before: Snapshot, after: Snapshot) -> DataFrame:
    """(change_id, kind, severity, subject, before, after, detail). Two changes of one subject both stay."""
    parts = []
    sources = _outer(before.sources.select("source_id", "sha256"), after.sources.select("source_id", "sha256"), ["source_id"])
    moved = sources.filter(~F.col("old_sha256").eqNullSafe(F.col("new_sha256")) | F.col("in_old").isNull() | F.col("in_new").isNull())
    parts.append(_change(moved, "source", F.when(F.col("in_new").isNull(), "warn").otherwise("info"), F.col("source_id"),
                         F.col("old_sha256"), F.col("new_sha256"),
                         F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")))

    pairs, renamed, removed, added = table_pairs(before.tables, after.tables)
    name = F.concat_ws("/", "source_id", "table_name")
    parts.append(_change(renamed, "schema", "info", F.col("subject"), F.col("old_name"), F.col("new_name"), "renamed"))
    parts.append(_change(removed, "schema", "warn", name, F.col("table_id"), F.lit(None), "removed"))
    parts.append(_change(added, "schema", "info", name, F.lit(None), F.col("table_id"), "added"))

    facts = ["table_id", "row_count", "schema_fingerprint", "fingerprint"]
    both = (pairs.join(before.tables.select(*[F.col(c).alias(f"old_{c}") for c in facts]), F.col("old_id") == F.col("old_table_id"))
            .join(after.tables.select(*[F.col(c).alias(f"new_{c}") for c in facts]), F.col("new_id") == F.col("new_table_id")))
    parts.append(_change(both.filter("old_schema_fingerprint <> new_schema_fingerprint"), "schema", "warn", F.col("subject"),
                         F.col("old_schema_fingerprint"), F.col("new_schema_fingerprint"), "columns changed"))
    ratio = F.abs(F.col("new_row_count") - F.col("old_row_count")) / F.greatest(F.lit(1), "old_row_count")
    parts.append(_change(both.filter("old_row_count <> new_row_count"), "volume",
                         F.when(ratio >= V.VOLUME_WARNING, "warn").otherwise("info"), F.col("subject"), F.col("old_row_count"),
                         F.col("new_row_count"), F.concat(F.lit("change_ratio="), F.round(ratio, 6).cast("string"))))
    parts.append(_change(both.filter("old_fingerprint <> new_fingerprint"), "value", "info", F.col("subject"), F.col("old_fingerprint"),
                         F.col("new_fingerprint"), "row contents differ"))

    def by_subject(frame: DataFrame, side: str) -> DataFrame:
        # a row per table goes to the rows: shuffled by table, all rows of the largest one would meet in a task
        return F.broadcast(pairs.select("subject", F.col(f"{side}_id").alias("table_id"))).join(frame, "table_id").drop("table_id")

    diff = multiset_difference(by_subject(before.hash_counts, "old"), by_subject(after.hash_counts, "new"), ["subject"])
    parts.append(_change(diff.filter("removed > 0 OR added > 0"), "row", "info", F.col("subject"),
                         F.concat(F.lit("removed="), F.col("removed").cast("string")),
                         F.concat(F.lit("added="), F.col("added").cast("string")), "row hash multiset"))

    keys = ["subject", "column_name"]
    old, new = by_subject(before.columns, "old"), by_subject(after.columns, "new")
    tops = _prefixed(old, "old", keys).join(_prefixed(new, "new", keys), keys).filter(
        ~F.to_json("old_top_k").eqNullSafe(F.to_json("new_top_k")))

    def listed(side: str) -> Column:
        return F.coalesce(F.col(f"{side}_top_k.value"), F.array().cast("array<string>"))

    whole = (F.col("old_distinct_count") <= F.size(listed("old"))) & (F.col("new_distinct_count") <= F.size(listed("new")))
    other = (F.size(F.array_except(listed("old"), listed("new"))) > 0) | (F.size(F.array_except(listed("new"), listed("old"))) > 0)
    item = F.concat_ws(".", *keys)
    parts.append(_change(tops.filter(whole & other), "category", "info", item, F.to_json(listed("old")), F.to_json(listed("new")),
                         "complete_domain"))
    parts.append(_change(tops.filter(~(whole & other)), "distribution", "info", item, F.to_json("old_top_k"), F.to_json("new_top_k"),
                         "top_k_frequency"))

    kpis = _outer(before.kpis.select("pack", "kpi_id", "value"), after.kpis.select("pack", "kpi_id", "value"), ["pack", "kpi_id"])
    parts.append(_change(kpis.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))), "kpi", "info",
                         F.concat_ws("/", "pack", "kpi_id"), F.col("old_value"), F.col("new_value"), "value changed"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(stable_id(F.col("kind"), F.col("subject"), F.col("detail")).alias("change_id"), "*")
