"""Queries on key numbers, anomalies, and reports that should agree with their data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import anomalies as A, digest as D
from ..operators.quantiles import order_statistics
from ..tables import Table, TableSet
from .facts import Facts
from .inputs import base_table, load, renamed_orders, star

AS_OF = dt.date(2024, 6, 30)


def _orders_facts(spark, df):
    return Facts(TableSet(spark, [Table("orders", df, "order_id")]))


def _shown(digest):
    return digest.select("section", "measure", "dim", "key", F.round("value", 2).alias("value"), "rows",
                         F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"))


def _digest_orders(spark, sf):
    return _shown(_orders_facts(spark, renamed_orders(spark, sf)).digest)


def _digest_sql(source, measures, dims, month, primary):
    """measures: (column, additive); dims and month are column names; primary is the summed measure or None."""
    value = f"coalesce(sum({primary}), 0.0)" if primary else "CAST(count(*) AS DOUBLE)"
    head = primary or "*"
    parts = ["SELECT 'total' AS section, '*' AS measure, CAST(NULL AS VARCHAR) AS dim, 'rows' AS key, CAST(count(*) AS DOUBLE) AS value, "
             "count(*) AS rows, CAST(NULL AS DOUBLE) AS share, CAST(NULL AS BIGINT) AS rank FROM s"]
    for m, additive in measures:
        for fn in (["sum"] if additive else []) + ["avg", "min", "max"]:
            parts.append(f"SELECT 'total', '{m}', NULL, '{fn}', round({fn}({m}), 2), count({m}), NULL, NULL FROM s")
    for d in dims:
        parts.append(f"""SELECT 'by_group', '{head}', '{d}', k, round(v, 2), r, round(v / b, 6), rank FROM
            (SELECT *, CAST(row_number() OVER (ORDER BY v DESC, k) AS BIGINT) AS rank FROM (SELECT CAST({d} AS VARCHAR) AS k, {value} AS v,
            count(*) AS r, (SELECT {value} FROM s) AS b FROM s GROUP BY {d})) WHERE rank <= 10""")
        parts.append(f"""SELECT 'by_group', '{head}', '{d}', '(other ' || (count(*) - 10) || ' groups)', round(max(b) - sum(v) FILTER (rank <= 10), 2), NULL,
            round((max(b) - sum(v) FILTER (rank <= 10)) / max(b), 6), 11 FROM
            (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS rank FROM (SELECT CAST({d} AS VARCHAR) AS k, {value} AS v,
            (SELECT {value} FROM s) AS b FROM s GROUP BY {d})) HAVING count(*) > 10""")
    if month:
        parts.append(f"""SELECT 'by_month', '{head}', '{month}', k, round(v, 2), r, NULL, CAST(row_number() OVER (ORDER BY k) AS BIGINT) FROM
            (SELECT strftime({month}, '%Y-%m') AS k, {value} AS v, count(*) AS r FROM s GROUP BY 1 ORDER BY k DESC LIMIT 60)""")
    return f"WITH s AS ({source}) " + " UNION ALL ".join(parts)


RENAMED_SQL = """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS amount,
  CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS priority FROM orders"""


def _digest_lineitem(spark, sf):
    """Key numbers under declared roles: the column names of this table tell nothing."""
    tables = star(spark, sf, ["lineitem"])
    roles = {("lineitem", c): "quantity" for c in ("l_quantity",)}
    roles |= {("lineitem", "l_extendedprice"): "money", ("lineitem", "l_orderkey"): "code", ("lineitem", "l_partkey"): "code",
              ("lineitem", "l_suppkey"): "code", ("lineitem", "l_discount"): "percentage", ("lineitem", "l_tax"): "percentage",
              ("lineitem", "l_linenumber"): "code"}
    return _shown(Facts(tables, declared_roles=roles).digest)


def _digest_customer(spark, sf):
    """A dimension with more than ten groups: the rest is shown as one remainder row."""
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))
    return _shown(Facts(TableSet(spark, [Table("customers", c, "customer_id")])).digest)


CUSTOMER_SQL = """SELECT c_custkey AS customer_id, n_name AS nation, c_acctbal AS balance, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _choices(spark, sf):
    tables = TableSet(spark, [Table("orders", renamed_orders(spark, sf), "order_id"), *star(spark, sf, ["benchmark"]).tables,
                              Table("none", load(spark, sf, "region").filter("r_regionkey < 0"), "r_regionkey"),
                              Table("pivot", load(spark, sf, "region"), "r_regionkey", pivot_tables=1)])
    found = D.choices_frame(tables, Facts(tables).choices)
    return found.select("table_name", "status", F.array_join("measures", ",").alias("measures"), F.array_join("dims", ",").alias("dims"),
                        "date_column")


#: Columns of order lines as amounts and codes: five of one kind, five of the other.
MANY_ROLES = {c: "quantity" for c in ("l_quantity", "l_discount", "l_tax")} | {"l_extendedprice": "money", "l_partkey": "money"} | {c: "code" for c in (
    "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")}


def _left_out(spark, sf):
    """What the limits of the digest leave out of the order lines, and that nothing is left out without limits."""
    tables, roles = star(spark, sf, ["lineitem"]), {("lineitem", c): r for c, r in MANY_ROLES.items()}
    limited = D.choices_frame(tables, Facts(tables, declared_roles=roles).choices).withColumn("limits", F.lit("as usual"))
    whole = D.choices_frame(tables, Facts(tables, declared_roles=roles, digest_limits=D.Limits(None, None, (2, None))).choices).withColumn("limits", F.lit("none"))
    both = limited.unionByName(whole)
    return both.select("limits", F.size("measures").cast("long").alias("measures"), F.size("dims").cast("long").alias("dims"), F.array_join("left_out", "; ").alias("left_out"))


LEFT_OUT_SQL = """WITH d AS (SELECT count(DISTINCT l_orderkey) AS o, count(DISTINCT l_suppkey) AS s FROM lineitem),
f AS (SELECT o, s, 3 + CASE WHEN s <= 50 THEN 1 ELSE 0 END AS few FROM d)
SELECT 'none' AS limits, 5 AS measures, 5 AS dims, '' AS left_out FROM f
UNION ALL SELECT 'as usual', 4, 3, 'l_orderkey: dimension of ' || o || ' groups; ' || CASE WHEN few = 4 THEN 'l_suppkey: dim number 4; ' ELSE 'l_suppkey: dimension of ' || s || ' groups; ' END
  || 'l_tax: measure number 5' FROM f"""


def _all_measures(spark, sf):
    """Totals of every measure of the order lines, the fifth among them."""
    tables, roles = star(spark, sf, ["lineitem"]), {("lineitem", c): r for c, r in MANY_ROLES.items()}
    digest = Facts(tables, declared_roles=roles, digest_limits=D.Limits(None, None, (2, 50))).digest
    return digest.filter("section = 'total' AND key = 'sum'").select("measure", F.round("value", 2).alias("value"), "rows")


ALL_MEASURES_SQL = " UNION ALL ".join(f"SELECT '{c}' AS measure, round(CAST(sum({c}) AS DOUBLE), 2) AS value, count({c}) AS rows FROM lineitem"
                                      for c in ("l_quantity", "l_extendedprice", "l_partkey", "l_discount", "l_tax"))


CHOICES_SQL = """SELECT 'orders' AS table_name, 'computed' AS status, 'amount' AS measures, 'priority,status' AS dims, 'order_date' AS date_column
UNION ALL SELECT 'benchmark', 'skipped', '', '', NULL UNION ALL SELECT 'none', 'skipped', 'r_regionkey', '', NULL
UNION ALL SELECT 'pivot', 'skipped', '', '', NULL"""


def _grand_total(spark, sf):
    """Orders with one appended row that repeats the sum of all others and carries no label."""
    o = renamed_orders(spark, sf)
    total = o.agg(F.lit(-1).cast("long").alias("order_id"), F.lit(None).cast("long").alias("customer_id"),
                  F.lit(None).cast("string").alias("status"), F.sum("amount").alias("amount"),
                  F.lit(None).cast("date").alias("order_date"), F.lit(None).cast("string").alias("priority"))
    return o.unionByName(total)


def _sum_rows(spark, sf):
    return _orders_facts(spark, _grand_total(spark, sf)).all_flags.select("row_id", "flag", "detail")


SUM_ROWS_SQL = """SELECT CAST(-1 AS BIGINT) AS row_id, 'totals_candidate' AS flag, 'amount equals the sum of all other rows' AS detail"""


def _quantiles(spark, sf):
    l = load(spark, sf, "lineitem")
    values = l.select(F.stack(F.lit(3), F.lit(0), F.col("l_extendedprice"), F.lit(1), F.col("l_quantity"), F.lit(2), F.col("l_discount"))
                      .alias("column_no", "v"))
    q = order_statistics(values)
    return q.select(F.col("column_no").cast("long").alias("column_no"), "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                    F.col("q")[2].alias("q3"))


def _kth_sql(table, column, no):
    pick = ", ".join(f"max(v) FILTER (i = CAST(round_even({f} * (n - 1), 0) AS BIGINT)) AS {name}"
                     for f, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    return (f"SELECT CAST({no} AS BIGINT) AS column_no, max(n) AS n, {pick} FROM (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS i, "
            f"count(*) OVER () AS n FROM {table})")


QUANTILES_SQL = " UNION ALL ".join(_kth_sql("lineitem", c, i) for i, c in enumerate(("l_extendedprice", "l_quantity", "l_discount")))


def _event_choices(spark, sf):
    facts = Facts(star(spark, sf, ["events"]))
    return facts, A.measure_values(facts.tables, facts.choices, facts.all_flags)


def _outliers(spark, sf):
    _, values = _event_choices(spark, sf)
    return A.outliers(values).select("n", "q1", "median", "q3", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count",
                                     "severity", F.array_join(F.transform("examples", lambda x: F.split_part(x, F.lit(":"), F.lit(1))), ",")
                                     .alias("example_rows"))


OUTLIERS_SQL = f"""WITH q AS ({_kth_sql('events', 'value', 0)}),
f AS (SELECT *, q1 - 3 * (q3 - q1) AS low, q3 + 3 * (q3 - q1) AS high FROM q),
b AS (SELECT event_id, value, row_number() OVER (ORDER BY abs(value - median) DESC, event_id) AS rk FROM events, f WHERE value < low OR value > high)
SELECT n, q1, median, q3, round(low, 6) AS low, round(high, 6) AS high, (SELECT count(*) FROM b) AS count,
  CASE WHEN (SELECT count(*) FROM b) / n < 0.01 THEN 'warn' ELSE 'info' END AS severity,
  (SELECT string_agg(event_id, ',' ORDER BY rk) FROM b WHERE rk <= 5) AS example_rows FROM f"""


def _negatives(spark, sf):
    o = renamed_orders(spark, sf).withColumn("amount", F.when(F.col("order_id") % 100 == 0, -F.col("amount")).otherwise(F.col("amount")))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"))
    tables = TableSet(spark, [Table("orders", o, "order_id"), Table("customers", c, "customer_id")])
    facts = Facts(tables)
    found = A.rare_negatives(A.measure_values(tables, facts.choices, facts.all_flags))
    return found.join(tables.columns().select("column_no", "table_name", "column_name"), "column_no").select(
        "table_name", "column_name", "n", "count")


NEGATIVES_SQL = """SELECT 'orders' AS table_name, 'amount' AS column_name, count(*) AS n, count(*) FILTER (o_orderkey % 100 = 0 AND o_totalprice > 0) AS count
  FROM orders HAVING count(*) FILTER (o_orderkey % 100 = 0 AND o_totalprice > 0) BETWEEN 1 AND 0.02 * count(*)
UNION ALL SELECT 'customers', 'balance', count(*), count(*) FILTER (c_acctbal < 0) FROM customer
  HAVING count(*) FILTER (c_acctbal < 0) BETWEEN 1 AND 0.02 * count(*)"""


def _series_orders(spark, sf):
    """Orders without May 1999 and December 2000, and with one month fifty times too large."""
    month = F.date_format("order_date", "yyyy-MM")
    o = renamed_orders(spark, sf).filter(~month.isin("1999-05", "2000-12"))
    return o.withColumn("amount", F.when(month == "2000-03", F.col("amount") * 50).otherwise(F.col("amount")))


def _series(spark, sf):
    return _orders_facts(spark, _series_orders(spark, sf)).digest.filter("section = 'by_month'")


def _missing_months(spark, sf):
    return A.missing_months(_series(spark, sf)).select("dim", "month")


def _trend_jump(spark, sf):
    return A.trend_jumps(_series(spark, sf)).select("month", F.round("value", 2).alias("value"), F.round("med", 2).alias("median"),
                                                    F.round("z", 4).alias("z"))


MONTHLY_SQL = """m AS (SELECT * FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month,
  sum(CASE WHEN strftime(o_orderdate, '%Y-%m') = '2000-03' THEN o_totalprice * 50 ELSE o_totalprice END) AS v
  FROM orders WHERE strftime(o_orderdate, '%Y-%m') NOT IN ('1999-05', '2000-12') GROUP BY 1) ORDER BY month DESC LIMIT 60)"""
MISSING_SQL = f"""WITH {MONTHLY_SQL} SELECT 'order_date' AS dim, strftime(d, '%Y-%m') AS month FROM
  (SELECT unnest(generate_series((SELECT CAST(min(month) || '-01' AS DATE) FROM m), (SELECT CAST(max(month) || '-01' AS DATE) FROM m), INTERVAL 1 MONTH)) AS d)
  WHERE strftime(d, '%Y-%m') NOT IN (SELECT month FROM m)"""
TREND_SQL = f"""WITH {MONTHLY_SQL}, c AS (SELECT median(v) AS med FROM m), s AS (SELECT median(abs(v - med)) AS mad FROM m, c)
  SELECT month, round(v, 2) AS value, round(med, 2) AS median, round(0.6745 * (v - med) / mad, 4) AS z FROM m, c, s
  WHERE abs(0.6745 * (v - med) / mad) >= 3.5"""


def _bad_dates(spark, sf):
    k = F.col("order_id")
    o = renamed_orders(spark, sf).withColumn("order_date", F.when(k % 997 == 0, F.add_months("order_date", -240))
                                             .when(k % 991 == 0, F.add_months("order_date", 480)).otherwise(F.col("order_date")))
    facts = _orders_facts(spark, o)
    return A.dates_out_of_range(facts.choices, facts.all_flags, AS_OF).select(
        "row_id", "column_name", F.date_format("d", "yyyy-MM-dd").alias("d"))


BAD_DATES_SQL = """SELECT o_orderkey AS row_id, 'order_date' AS column_name, strftime(d, '%Y-%m-%d') AS d FROM (SELECT o_orderkey,
  CASE WHEN o_orderkey % 997 = 0 THEN o_orderdate - INTERVAL 240 MONTH WHEN o_orderkey % 991 = 0 THEN o_orderdate + INTERVAL 480 MONTH
  ELSE o_orderdate END AS d FROM orders) WHERE d < DATE '1990-01-01' OR d > DATE '2025-06-30'"""


def _anomalies(spark, sf):
    """Every finding on a table with one of each: gap, jump, rare negatives and impossible dates."""
    k = F.col("order_id")
    o = _series_orders(spark, sf).withColumn("amount", F.when(k % 100 == 0, -F.col("amount")).otherwise(F.col("amount")))
    return _orders_facts(spark, o).anomalies(AS_OF).select("column_name", "kind", "severity", "count", "status")


ANOMALIES_SQL = f"""WITH s AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
  (CASE WHEN o_orderkey % 100 = 0 THEN -1 ELSE 1 END) * (CASE WHEN strftime(o_orderdate, '%Y-%m') = '2000-03' THEN 50 ELSE 1 END) * o_totalprice AS value
  FROM orders WHERE strftime(o_orderdate, '%Y-%m') NOT IN ('1999-05', '2000-12')),
q AS ({_kth_sql('s', 'value', 0)}), b AS (SELECT count(*) AS c, max(n) AS n FROM s, q WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)),
m AS (SELECT * FROM (SELECT month, sum(value) AS v FROM s GROUP BY 1) ORDER BY month DESC LIMIT 60),
c AS (SELECT median(v) AS med FROM m), d AS (SELECT median(abs(v - med)) AS mad FROM m, c),
j AS (SELECT count(*) AS c FROM m, c, d WHERE mad > 0 AND abs(0.6745 * (v - med) / mad) >= 3.5),
g AS (SELECT date_diff('month', CAST(min(month) || '-01' AS DATE), CAST(max(month) || '-01' AS DATE)) + 1 - count(*) AS c FROM m)
SELECT 'amount' AS column_name, 'outlier' AS kind, CASE WHEN c / n < 0.01 THEN 'warn' ELSE 'info' END AS severity, c AS count, 'inferred' AS status FROM b WHERE c > 0
UNION ALL SELECT 'amount', 'negative', 'info', count(*) FILTER (value < 0), 'inferred' FROM s HAVING count(*) FILTER (value < 0) BETWEEN 1 AND 0.02 * count(*)
UNION ALL SELECT 'order_date', 'missing_period', 'warn', c, 'inferred' FROM g WHERE c > 0
UNION ALL SELECT 'order_date', 'trend_jump', 'info', c, 'inferred' FROM j WHERE c > 0"""


def _aggregate(spark, sf):
    t = star(spark, sf, ["orders"]).table("orders")
    return D.aggregate(t, "o_totalprice", "max", "o_orderpriority").withColumnRenamed("o_orderpriority", "grp").unionByName(
        D.aggregate(t, "o_totalprice", "min", "o_orderstatus").withColumnRenamed("o_orderstatus", "grp"))


AGGREGATE_SQL = """SELECT o_orderpriority AS grp, max(o_totalprice) AS value FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, min(o_totalprice) FROM orders GROUP BY 1"""


def _report(spark, sf):
    """A report by priority with one drifted number and a total row."""
    o = load(spark, sf, "orders")
    sums = o.rollup("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("sales"), F.count(F.lit(1)).alias("order_count"))
    label = F.coalesce("o_orderpriority", F.lit("Total"))
    return sums.select(F.coalesce(F.ascii("o_orderpriority") - 48, F.lit(9)).cast("long").alias("row_no"), label.alias("priority name"),
                       F.when(F.col("o_orderpriority") == "2-HIGH", F.round(F.col("sales") * 1.01, 2)).otherwise(F.col("sales")).alias("sales"),
                       F.col("order_count"))


def _reconcile(spark, sf):
    tables = TableSet(spark, [Table("orders", renamed_orders(spark, sf), "order_id", source="data"),
                              Table("report", _report(spark, sf), "row_no", source="reports", hide_row_id=True)])
    found = Facts(tables).reconciliation()
    return found.select("number_column", "label_column", "dim", "agg", "measure", "compared", "matched", "status",
                        F.array_join(F.transform("mismatches", lambda m: m["label"]), ",").alias("mismatch_labels"))


RECONCILE_SQL = """SELECT 'sales' AS number_column, 'priority name' AS label_column, 'priority' AS dim, 'SUM' AS agg, 'amount' AS measure,
  count(DISTINCT o_orderpriority) + 1 AS compared, count(DISTINCT o_orderpriority) AS matched, 'partial' AS status, '2-HIGH' AS mismatch_labels FROM orders
UNION ALL SELECT 'order_count', 'priority name', 'priority', 'COUNT', '*', count(DISTINCT o_orderpriority) + 1,
  count(DISTINCT o_orderpriority) + 1, 'reconciled', '' FROM orders"""


def _customer_report(spark, sf):
    """A report of every customer with orders: names in capitals, one sum in fifty drifted."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    sums = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_custkey", "c_name").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count(F.lit(1)).alias("orders"))
    drift = F.when(F.col("c_custkey") % 50 == 0, F.col("spent") + 10).otherwise(F.col("spent"))
    return sums.select(F.col("c_custkey").alias("row_no"), F.upper("c_name").alias("client"), F.lit("checked").alias("remark"), drift.alias("spent"), "orders")


def _reconcile_customers(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    named = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_name").alias("customer"), "o_orderpriority", F.col("o_totalprice").alias("total_price"), "o_orderdate")
    tables = TableSet(spark, [Table("sales", named, "o_orderkey", source="data"), Table("clients", _customer_report(spark, sf), "row_no", source="reports", hide_row_id=True),
                              base_table(spark, sf, "part"), base_table(spark, sf, "supplier")])
    found = Facts(tables).reconciliation().filter(F.col("report_id") == tables.table("clients").table_id)
    return found.select("number_column", "label_column", "dim", "agg", "measure", "compared", "matched", "status",
                        F.array_join(F.transform("mismatches", lambda m: m["label"]), ",").alias("mismatch_labels"))


RECONCILE_CUSTOMERS_SQL = """WITH r AS (SELECT DISTINCT c_custkey, upper(c_name) AS name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'spent' AS number_column, 'client' AS label_column, 'customer' AS dim, 'SUM' AS agg, 'total_price' AS measure, count(*) AS compared,
  count(*) FILTER (c_custkey % 50 <> 0) AS matched, CASE WHEN bool_or(c_custkey % 50 = 0) THEN 'partial' ELSE 'reconciled' END AS status,
  coalesce((SELECT string_agg(name, ',' ORDER BY c_custkey) FROM (SELECT * FROM r WHERE c_custkey % 50 = 0 ORDER BY c_custkey LIMIT 10)), '') AS mismatch_labels FROM r
UNION ALL SELECT 'orders', 'client', 'customer', 'COUNT', '*', count(*), count(*), 'reconciled', '' FROM r"""

QUERIES = {
    "digest_orders": _digest_orders, "digest_lineitem": _digest_lineitem, "digest_customer": _digest_customer,
    "digest_choices": _choices, "digest_left_out": _left_out, "digest_all_measures": _all_measures, "sum_rows_planted": _sum_rows, "quantiles_lineitem": _quantiles, "outliers_events": _outliers,
    "negatives_planted": _negatives, "missing_months_planted": _missing_months, "trend_jump_planted": _trend_jump,
    "dates_out_of_range_planted": _bad_dates, "anomalies_planted": _anomalies, "aggregate_tool": _aggregate,
    "reconcile_priority_report": _reconcile, "reconcile_customer_report": _reconcile_customers,
}
ORACLE = {
    "digest_orders": _digest_sql(RENAMED_SQL, [("amount", True)], ["priority", "status"], "order_date", "amount"),
    "digest_lineitem": _digest_sql("SELECT * FROM lineitem", [("l_extendedprice", True), ("l_quantity", True)],
                                   ["l_linestatus", "l_returnflag", "l_linenumber"], "l_shipdate", "l_extendedprice"),
    "digest_customer": _digest_sql(CUSTOMER_SQL, [("balance", True)], ["segment", "nation"], None, "balance"),
    "digest_choices": CHOICES_SQL, "digest_left_out": LEFT_OUT_SQL, "digest_all_measures": ALL_MEASURES_SQL, "sum_rows_planted": SUM_ROWS_SQL, "quantiles_lineitem": QUANTILES_SQL,
    "outliers_events": OUTLIERS_SQL, "negatives_planted": NEGATIVES_SQL, "missing_months_planted": MISSING_SQL,
    "trend_jump_planted": TREND_SQL, "dates_out_of_range_planted": BAD_DATES_SQL, "anomalies_planted": ANOMALIES_SQL, "aggregate_tool": AGGREGATE_SQL,
    "reconcile_priority_report": RECONCILE_SQL, "reconcile_customer_report": RECONCILE_CUSTOMERS_SQL,
}
