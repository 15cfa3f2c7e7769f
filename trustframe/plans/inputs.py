"""The given tables, and views with planted defects that Spark derives from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import Table, TableSet, with_file_row_id

ROW_IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
           "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id",
           "labels": "doc_id", "pages": "page_id", "benchmark": "item_id"}
CORE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
        "pages", "benchmark", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def base_table(spark: SparkSession, sf_dir: str, name: str, df: DataFrame | None = None) -> Table:
    df = load(spark, sf_dir, name) if df is None else df
    if name in ROW_IDS:
        return Table(name, df, ROW_IDS[name])
    if name == "conversations":
        return Table(name, df, F.col("conv_id") * 1_000_000 + F.col("turn"))
    if "_row_id" not in df.columns:
        df = with_file_row_id(df)
    return Table(name, df, "_row_id", hide_row_id=True)


def star(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> TableSet:
    return TableSet(spark, [base_table(spark, sf_dir, n) for n in names or CORE])


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with planted null tokens, spelling variants, numbers as text, nulls and a constant column."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    amount = F.format_number("o_totalprice", 2)
    return o.select(
        "o_orderkey",
        F.when(key % 17 == 0, "N/A").when(key % 19 == 0, F.lit(" none ")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 23 == 0, F.upper("o_orderpriority")).when(key % 29 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority")))
        .otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(key % 2 == 0, amount).otherwise(F.lit("unknown")).alias("amount_text"),
        F.when(key % 10 == 0, F.col("o_custkey")).alias("mostly_null"),
        F.when(key % 20 == 0, F.col("o_custkey")).alias("nearly_all_null"),
        F.lit("EGP").alias("currency"))


DIRTY_ORDERS_SQL = """
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 19 = 0 THEN ' none ' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 23 = 0 THEN upper(o_orderpriority) WHEN o_orderkey % 29 = 0 THEN ' ' || lower(o_orderpriority)
         ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 2 = 0 THEN format('{:,.2f}', o_totalprice) ELSE 'unknown' END AS amount_text,
    CASE WHEN o_orderkey % 10 = 0 THEN o_custkey END AS mostly_null,
    CASE WHEN o_orderkey % 20 = 0 THEN o_custkey END AS nearly_all_null,
    'EGP' AS currency
  FROM orders"""


def renamed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under telling column names, as a spreadsheet user would name them."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
        F.to_date("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("priority"))


def sales_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per nation and priority, with a total row per nation ("FRANCE Total") and one grand total."""
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    sums = joined.rollup("n_nationkey", "n_name", "o_orderpriority").agg(
        F.grouping_id().alias("g"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.count(F.lit(1)).alias("orders"))
    sums = sums.filter(F.col("g").isin(0, 1, 7))
    rank = F.coalesce(F.ascii("o_orderpriority") - 48, F.lit(6))
    return sums.select(
        (F.coalesce(F.col("n_nationkey"), F.lit(999)) * 10 + rank).cast("long").alias("row_no"),
        F.when(F.col("g") == 7, "Grand Total").when(F.col("g") == 1, F.concat("n_name", F.lit(" Total")))
        .otherwise(F.col("n_name")).alias("region"),
        F.col("o_orderpriority").alias("priority"), "amount", "orders")


SALES_WITH_TOTALS_SQL = """
  SELECT CAST(coalesce(n_nationkey, 999) * 10 + coalesce(ascii(o_orderpriority) - 48, 6) AS BIGINT) AS row_no,
    CASE WHEN g = 7 THEN 'Grand Total' WHEN g = 1 THEN n_name || ' Total' ELSE n_name END AS region,
    o_orderpriority AS priority, amount, orders
  FROM (SELECT n_nationkey, n_name, o_orderpriority, grouping_id(n_nationkey, n_name, o_orderpriority) AS g,
               round(sum(o_totalprice), 2) AS amount, count(*) AS orders
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ROLLUP (n_nationkey, n_name, o_orderpriority)) WHERE g IN (0, 1, 7)"""
