"""Row content: hashes, multisets, fingerprints, differences and overlaps, all independent of row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..tables import Table, TableSet


def canonical(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    simple = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    return c.cast("string") if simple else F.to_json(c)


def row_hash(table: Table, columns: list[str] | None = None) -> Column:
    """SHA-256 of the row's values as a JSON list of texts; NULLs keep their place, the row id never takes part."""
    fields = [f for f in table.fields if columns is None or f.name in columns]
    return F.sha2(F.to_json(F.array(*[canonical(f) for f in fields])), 256)


def row_hash_counts(table: Table, columns: list[str] | None = None) -> DataFrame:
    return (table.df.select(F.lit(table.table_id).alias("table_id"), row_hash(table, columns).alias("row_hash"))
            .groupBy("table_id", "row_hash").agg(F.count(F.lit(1)).alias("n")))


def all_row_hash_counts(tables: TableSet) -> DataFrame:
    return reduce(DataFrame.unionByName, [row_hash_counts(t) for t in tables.tables])


def fingerprints(hash_counts: DataFrame) -> DataFrame:
    """One digest per table over its (hash, count) multiset.

    The digest is built from exact sums of four 60-bit slices of every row hash. Sums need constant memory per table,
    combine before the shuffle and can be added up across batches, so no list of hashes ever reaches one task.
    """
    count = F.col("n").cast("decimal(18,0)")
    sums = [F.sum(F.conv(F.substring("row_hash", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") * count).alias(f"s{i}")
            for i in range(4)]
    total = hash_counts.groupBy("table_id").agg(F.sum("n").alias("row_count"), *sums)
    text = F.concat_ws(":", "row_count", *[F.col(f"s{i}").cast("decimal(38,0)").cast("string") for i in range(4)])
    return total.select("table_id", "row_count", F.sha2(text, 256).alias("fingerprint"))


def multiset_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, removed, added): how many rows left and joined, whatever their position (inputs: keys, row_hash, n)."""
    both = before.withColumnRenamed("n", "old_n").join(after.withColumnRenamed("n", "new_n"), [*keys, "row_hash"],
                                                       "full_outer").fillna(0, ["old_n", "new_n"])
    change = F.col("new_n") - F.col("old_n")
    return both.groupBy(*keys).agg(F.sum(F.greatest(-change, F.lit(0))).alias("removed"),
                                   F.sum(F.greatest(change, F.lit(0))).alias("added"))


def overlap_ratios(pairs: DataFrame, hash_counts: DataFrame) -> DataFrame:
    """pairs (table_id_a, table_id_b) -> share of the smaller table's distinct rows that both hold."""
    sizes = hash_counts.groupBy("table_id").agg(F.count(F.lit(1)).alias("size"))
    hashes = hash_counts.select("table_id", "row_hash")
    shared = (pairs.join(hashes.withColumnRenamed("table_id", "table_id_a"), "table_id_a")
              .join(hashes.withColumnRenamed("table_id", "table_id_b"), ["table_id_b", "row_hash"])
              .groupBy("table_id_a", "table_id_b").agg(F.count(F.lit(1)).alias("shared")))
    size_a = sizes.select(F.col("table_id").alias("table_id_a"), F.col("size").alias("size_a"))
    size_b = sizes.select(F.col("table_id").alias("table_id_b"), F.col("size").alias("size_b"))
    joined = (pairs.join(shared, ["table_id_a", "table_id_b"], "left").join(size_a, "table_id_a", "left")
              .join(size_b, "table_id_b", "left").fillna(0, ["shared", "size_a", "size_b"]))
    smaller = F.least("size_a", "size_b")
    return joined.select("table_id_a", "table_id_b", "shared",
                         F.coalesce(F.try_divide(F.col("shared").cast("double"), smaller), F.lit(0.0)).alias("overlap"))
