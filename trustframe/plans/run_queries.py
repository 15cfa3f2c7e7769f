"""Queries on rules, repairs, run-to-run changes, lineage, readiness, audits, publishing and SQL views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import (audit as U, changes as H, lineage as G, profile as P, quality as Q, readiness as Y, repair as E,
                         rows, rules as R)
from ..session import materialize, new_folder
from ..sources.publish import NotPublished, RunStore
from ..sources.views import Views
from ..tables import Table, TableSet, with_file_row_id
from .facts import Facts
from .inputs import (DIRTY_ORDERS_SQL, SALES_WITH_TOTALS_SQL, dirty_orders, load, renamed_orders, sales_with_totals, star)
from .read_api import Reader, capped, envelopes
from .refresh import refresh, snapshot

PACK = {
    "pack": {"name": "sales", "version": "1"},
    "term": [{"term": "revenue", "meaning": "price after discount", "unit": "USD"}],
    "key": [{"table": "local/orders", "columns": ["o_orderkey"]}],
    "relation": [{"from_table": "local/orders", "from_column": "o_custkey", "to_table": "local/customer", "to_column": "c_custkey"}],
    "rule": [
        {"id": "no_negative_price", "sql": "SELECT count(*) FROM {{table:local/orders}} WHERE o_totalprice < 0", "expect": "zero"},
        {"id": "has_orders", "sql": "SELECT count(*) FROM {{table:local/orders}}", "expect": "nonzero"},
        {"id": "no_small_orders", "sql": "SELECT count(*) FROM {{table:local/orders}} WHERE o_totalprice < 5000", "expect": "zero",
         "severity": "error"},
        {"id": "three_states", "sql": "SELECT count(DISTINCT o_orderstatus) FROM {{table:local/orders}}", "expect": "equals:3"},
        {"id": "broken", "sql": "SELECT missing_column FROM {{table:local/orders}}", "expect": "zero"},
        {"id": "known_customers", "sql": "SELECT count(*) FROM {{table:local/orders}} o LEFT ANTI JOIN {{table:local/customer}} c "
                                         "ON o.o_custkey = c.c_custkey", "expect": "zero"}],
    "kpi": [{"id": "orders", "sql": "SELECT count(*) FROM {{table:local/orders}}", "unit": "orders"},
            {"id": "lines_shipped", "sql": "SELECT sum(CAST(l_quantity AS BIGINT)) FROM {{table:local/lineitem}}", "unit": "pieces"}],
}


def _pack_run(spark, sf):
    tables = star(spark, sf, ["orders", "customer", "lineitem"])
    return R.run_packs(spark, R.parse_packs([PACK]), Views(tables).resolved)


def _rules(spark, sf):
    results, _ = _pack_run(spark, sf)
    return results.select("rule_id", "status", "severity", F.when(F.col("status") != "error", F.col("actual")).alias("actual"))


RULES_SQL = """SELECT 'no_negative_price' AS rule_id, CASE WHEN count(*) FILTER (o_totalprice < 0) = 0 THEN 'pass' ELSE 'fail' END AS status, 'warn' AS severity,
  CAST(count(*) FILTER (o_totalprice < 0) AS VARCHAR) AS actual FROM orders
UNION ALL SELECT 'has_orders', 'pass', 'warn', CAST(count(*) AS VARCHAR) FROM orders
UNION ALL SELECT 'no_small_orders', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, 'error', CAST(count(*) AS VARCHAR) FROM orders WHERE o_totalprice < 5000
UNION ALL SELECT 'three_states', CASE WHEN count(DISTINCT o_orderstatus) = 3 THEN 'pass' ELSE 'fail' END, 'warn', CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders
UNION ALL SELECT 'broken', 'error', 'warn', NULL
UNION ALL SELECT 'known_customers', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, 'warn', CAST(count(*) AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""


def _kpis(spark, sf):
    return _pack_run(spark, sf)[1].select("kpi_id", "pack", "value", "unit")


KPIS_SQL = """SELECT 'orders' AS kpi_id, 'sales' AS pack, CAST(count(*) AS VARCHAR) AS value, 'orders' AS unit FROM orders
UNION ALL SELECT 'lines_shipped', 'sales', CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR), 'pieces' FROM lineitem"""


def _count_rules(spark, sf):
    t = star(spark, sf, ["lineitem"]).table("lineitem")
    return R.count_rules(t, {"discount_over_9": "l_discount > 0.09", "no_tax": "l_tax = 0", "late": F.col("l_shipdate") > "2001-01-01",
                             "negative": "l_quantity < 0"})


COUNT_RULES_SQL = """SELECT 'discount_over_9' AS rule_id, count(*) FILTER (l_discount > 0.09) AS violations FROM lineitem
UNION ALL SELECT 'no_tax', count(*) FILTER (l_tax = 0) FROM lineitem
UNION ALL SELECT 'late', count(*) FILTER (l_shipdate > TIMESTAMP '2001-01-01') FROM lineitem
UNION ALL SELECT 'negative', count(*) FILTER (l_quantity < 0) FROM lineitem"""


# ---- repairs ----------------------------------------------------------------------------------------------------
def _dirty(spark, sf):
    return TableSet(spark, [Table("dirty_orders", dirty_orders(spark, sf), "o_orderkey")])


def _repairs(spark, sf):
    return E.repairs(_dirty(spark, sf)).select("column_name", "row_id", "original_value", "repaired_value", "rule")


TOKENS = "('n/a','na','null','none','-','--','nil','(blank)','blank')"
REPAIRS_SQL = f"""WITH d AS ({DIRTY_ORDERS_SQL}),
v AS (SELECT 'priority' AS c, priority AS x, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM d GROUP BY 2
  UNION ALL SELECT 'amount_text', amount_text, count(*) FROM d GROUP BY 2),
b AS (SELECT *, first_value(x) OVER (PARTITION BY c, lower(trim(x)) ORDER BY n DESC, x) AS canon FROM v),
cells AS (SELECT o_orderkey, 'priority' AS c, priority AS x FROM d UNION ALL SELECT o_orderkey, 'status', status FROM d
  UNION ALL SELECT o_orderkey, 'amount_text', amount_text FROM d)
SELECT c AS column_name, o_orderkey AS row_id, x AS original_value, NULL AS repaired_value, 'null_token' AS rule FROM cells WHERE lower(trim(x)) IN {TOKENS}
UNION ALL SELECT cells.c, o_orderkey, cells.x, canon, 'category_consolidation' FROM cells JOIN b ON cells.c = b.c AND cells.x = b.x WHERE b.x <> canon
UNION ALL SELECT c, o_orderkey, x, CASE WHEN CAST(replace(x, ',', '') AS DECIMAL(18,2)) >= 10000000 THEN 'big' ELSE
  rtrim(regexp_replace(replace(x, ',', ''), '(\\.[0-9]*?)0+$', '\\1'), '.') || CASE WHEN regexp_matches(x, '\\.0+$') THEN '.0' ELSE '' END END, 'text_as_number'
  FROM cells WHERE c = 'amount_text' AND regexp_matches(trim(x), '^-?[0-9,]+\\.?[0-9]*$')
  AND rtrim(regexp_replace(replace(x, ',', ''), '(\\.[0-9]*?)0+$', '\\1'), '.') || CASE WHEN regexp_matches(x, '\\.0+$') THEN '.0' ELSE '' END <> trim(x)"""


def _repaired(spark, sf):
    tables = _dirty(spark, sf)
    enabled = ("null_token", "category_consolidation")
    return E.repaired_view(tables.tables[0], E.repairs(tables, enabled)).select("o_orderkey", "status", "priority", "amount_text", "currency")


REPAIRED_SQL = f"""WITH d AS ({DIRTY_ORDERS_SQL}) SELECT d.o_orderkey, CASE WHEN lower(trim(status)) IN {TOKENS} THEN NULL ELSE status END AS status,
  o_orderpriority AS priority, amount_text, currency FROM d JOIN orders USING (o_orderkey)"""


def _repairs_after_second_file(spark, sf):
    """Repairs found in a first file and stored by row id are shown after a second file arrived whose path sorts first: they
    still change the rows they were found in, and no other."""
    folder, registry = new_folder(spark, "orders-files"), new_folder(spark, "file-numbers")
    dirty = dirty_orders(spark, sf).select("o_orderkey", "status", "priority")

    def arrived():
        files = with_file_row_id(spark.read.option("recursiveFileLookup", True).schema(dirty.schema).parquet(folder), registry=registry)
        return Table("dirty", files, "_row_id", hide_row_id=True)

    dirty.filter("o_orderkey % 2 = 0").coalesce(1).write.parquet(f"{folder}/m")
    stored = materialize(E.repairs(TableSet(spark, [arrived()]), ("null_token", "category_consolidation")), "stored-repairs")
    dirty.filter("o_orderkey % 2 = 1").coalesce(1).write.parquet(f"{folder}/a")
    return E.repaired_view(arrived(), stored).select("o_orderkey", "status", "priority")


REPAIRS_AFTER_SQL = f"""WITH d AS ({DIRTY_ORDERS_SQL}) SELECT d.o_orderkey, CASE WHEN lower(trim(status)) IN {TOKENS} AND d.o_orderkey % 2 = 0 THEN NULL ELSE status END AS status,
  CASE WHEN d.o_orderkey % 2 = 0 THEN o_orderpriority ELSE priority END AS priority FROM d JOIN orders USING (o_orderkey)"""


# ---- changes ----------------------------------------------------------------------------------------------------
def _two_runs(spark, sf):
    """Run two drops some orders, gains others, renames a table, drops one, adds one and moves a KPI."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    r, n, s = (load(spark, sf, x) for x in ("region", "nation", "supplier"))
    one = TableSet(spark, [Table("orders", o.filter("o_orderkey % 10 <> 0"), "o_orderkey"), Table("zones", r, "r_regionkey"),
                           Table("nation", n, "n_nationkey"), Table("supplier", s.select("s_suppkey", "s_name"), "s_suppkey")])
    two = TableSet(spark, [Table("orders", o.filter("o_orderkey % 10 <> 1"), "o_orderkey"), Table("regions", r, "r_regionkey"),
                           Table("supplier", s.select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey"),
                           Table("extra", load(spark, sf, "benchmark"), "item_id")])
    kpi = o.agg(F.lit("sales").alias("pack"), F.lit("orders").alias("kpi_id"), F.count(F.lit(1)).cast("string").alias("value"))
    kpi2 = o.filter("o_orderkey > 0").agg(F.lit("sales").alias("pack"), F.lit("orders").alias("kpi_id"), F.count(F.lit(1)).cast("string").alias("value"))
    return snapshot(Facts(one), materialize(kpi, "kpis")), snapshot(Facts(two), materialize(kpi2, "kpis"))


def _changes(spark, sf):
    c = H.changes(*_two_runs(spark, sf)).filter(~F.col("kind").isin("source", "value", "distribution", "category"))
    plain = F.when(F.col("kind").isin("volume", "row", "kpi") | (F.col("detail") == "renamed"), F.concat_ws(" ", "before", "after"))
    return c.select("kind", "severity", "subject", plain.alias("values"))


CHANGES_SQL = """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 1)
SELECT 'schema' AS kind, 'info' AS severity, 'local/zones->regions' AS subject, 'zones regions' AS "values"
UNION ALL SELECT 'schema', 'warn', 'local/nation', NULL UNION ALL SELECT 'schema', 'info', 'local/extra', NULL
UNION ALL SELECT 'schema', 'warn', 'local/supplier', NULL
UNION ALL SELECT 'volume', 'info', 'local/orders', (SELECT count(*) FROM a) || ' ' || (SELECT count(*) FROM b) WHERE (SELECT count(*) FROM a) <> (SELECT count(*) FROM b)
UNION ALL SELECT 'row', 'info', 'local/orders', 'removed=' || (SELECT count(*) FROM a WHERE o_orderkey % 10 = 1) || ' added=' || (SELECT count(*) FROM b WHERE o_orderkey % 10 = 0)
UNION ALL SELECT 'row', 'info', 'local/supplier', 'removed=' || (SELECT count(*) FROM supplier) || ' added=' || (SELECT count(*) FROM supplier)
UNION ALL SELECT 'kpi', 'info', 'sales/orders', (SELECT count(*) FROM orders) || ' ' || (SELECT count(*) FROM orders WHERE o_orderkey > 0)"""


def _change_counts(spark, sf):
    return H.changes(*_two_runs(spark, sf)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("changes"))


def _row_difference(spark, sf):
    l = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    a = rows.row_hash_counts(Table("lines", l.filter("l_orderkey % 10 <> 0"), "l_orderkey"), ["l_linenumber", "l_returnflag"])
    b = rows.row_hash_counts(Table("lines", l.filter("l_orderkey % 7 <> 1"), "l_orderkey"), ["l_linenumber", "l_returnflag"])
    return rows.multiset_difference(a, b, ["table_id"]).select("removed", "added")


ROW_DIFFERENCE_SQL = """WITH a AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1, 2),
b AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 1 GROUP BY 1, 2)
SELECT CAST(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)) AS BIGINT) AS removed, CAST(sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)) AS BIGINT) AS added
FROM a FULL JOIN b USING (l_linenumber, l_returnflag)"""


# ---- lineage ----------------------------------------------------------------------------------------------------
def _formulas(spark, sf):
    """One formula per order line, drawing on a sheet, a quoted sheet, another workbook, and itself."""
    k = F.col("o_orderkey")
    o = load(spark, sf, "orders")
    f = (F.when(k % 4 == 0, F.format_string("='Raw Data'!D%d*1.14", k))
         .when(k % 4 == 1, F.format_string("=SUM(Jan!A%d)+[Sales.xlsx]Feb!B1", k))
         .when(k % 4 == 2, F.format_string("='It''s'!A%d&\"x!y\"", k)).otherwise(F.format_string("=Report!A%d", k)))
    return o.select(F.lit("t-report").alias("table_id"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("column_id"), f.alias("formula"))


def _lineage(spark, sf):
    from ..session import local_frame
    catalog = local_frame(spark, [("t-raw", "own", "Raw Data"), ("t-report", "own", "Report"), ("t-feb", "sales-1", "feb")],
                          "table_id string, source_id string, table_name string")
    sources = local_frame(spark, [("own", "/data/Own.xlsx"), ("sales-1", "/data/Sales.xlsx")], "source_id string, path string")
    found = G.lineage(materialize(G.reference_counts(_formulas(spark, sf)), "references"), catalog, sources)
    return found.select("column_id", "ref_kind", "book", "sheet", "target_table_id", "status", "cells")


LINEAGE_SQL = """SELECT 'c0' AS column_id, 'sheet' AS ref_kind, NULL AS book, 'Raw Data' AS sheet, 't-raw' AS target_table_id, 'resolved' AS status, count(*) AS cells FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT 'c1', 'sheet', NULL, 'Jan', NULL, 'unresolved', count(*) FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT 'c1', 'workbook', 'Sales.xlsx', 'Feb', 't-feb', 'resolved', count(*) FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT 'c2', 'sheet', NULL, 'It''s', NULL, 'unresolved', count(*) FROM orders WHERE o_orderkey % 4 = 2"""


# ---- readiness, audit, publishing -------------------------------------------------------------------------------
def _ready_facts(spark, sf):
    return Facts(TableSet(spark, [Table("orders", renamed_orders(spark, sf), "order_id"),
                                  Table("sales", sales_with_totals(spark, sf), "row_no", hide_row_id=True),
                                  Table("dirty_orders", dirty_orders(spark, sf), "o_orderkey"),
                                  Table("kinds", load(spark, sf, "part").select("p_partkey", "p_type", "p_size"), "p_partkey", hide_row_id=True)]))


def _readiness(spark, sf):
    f = _ready_facts(spark, sf)
    return Y.readiness(f.tables.catalog(), f.findings, f.flags, f.grain).select("table_name", "quality_errors", "totals_rows",
                                                                                "grain_status", "readiness")


READINESS_SQL = f"""SELECT 'orders' AS table_name, CAST(0 AS BIGINT) AS quality_errors, CAST(0 AS BIGINT) AS totals_rows, 'inferred' AS grain_status, 'ready' AS readiness
UNION ALL SELECT 'dirty_orders', 2, 0, 'inferred', 'needs_review' WHERE (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) * 10 <= (SELECT count(*) FROM orders)
UNION ALL SELECT 'sales', 0, (SELECT count(*) FROM ({SALES_WITH_TOTALS_SQL}) WHERE region LIKE '% Total'), 'inferred', 'needs_review'
UNION ALL SELECT 'kinds', 0, 0, 'unknown', 'ready'"""


def _gaps(spark, sf):
    f = _ready_facts(spark, sf)
    ready = materialize(Y.readiness(f.tables.catalog(), f.findings, f.flags, f.grain), "ready")
    results, _ = _pack_run(spark, sf)
    g = Y.gaps(ready, results, sources_fresh=False)
    names = f.tables.catalog().select("table_id", "table_name")
    listed = g.join(names, "table_id", "left").select("kind", "table_name")
    return listed.unionByName(Y.verdict(ready, g).select(F.concat(F.lit("verdict "), F.col("verdict").cast("string")).alias("kind"),
                                                         F.lit(None).cast("string").alias("table_name")))


GAPS_SQL = """SELECT * FROM (VALUES ('stale', NULL), ('rule_errors', NULL), ('rule_failures', NULL), ('quality_error', 'dirty_orders'),
  ('totals_row_in_data', 'sales'), ('grain_unknown', 'kinds'), ('verdict 2', NULL)) v(kind, table_name)
  WHERE kind <> 'rule_failures' OR (SELECT count(*) FROM orders WHERE o_totalprice < 5000) > 0"""


def _report(spark, sf):
    f = _ready_facts(spark, sf)
    return Y.report(f.tables.catalog(), f.profiles, {"table_kind": (f.kinds, "table_kind"), "quality": (f.findings, "severity"),
                                                     "keys": (f.keys, "status")}).filter("metric IN ('sources', 'tables', 'rows', 'table_kind')")


REPORT_SQL = f"""WITH s AS (SELECT count(*) AS n FROM ({SALES_WITH_TOTALS_SQL}))
SELECT 'sources' AS metric, NULL AS key, CAST(1 AS BIGINT) AS value UNION ALL SELECT 'tables', NULL, 4
UNION ALL SELECT 'rows', NULL, (SELECT 2 * count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT n FROM s)
UNION ALL SELECT 'table_kind', 'data', CASE WHEN (SELECT n FROM s) <= 50 THEN 3 ELSE 4 END
UNION ALL SELECT 'table_kind', 'report', 1 WHERE (SELECT n FROM s) <= 50"""


def _audit(spark, sf):
    """The stored run lost rows of one table, a column of another, and a whole table."""
    before = Facts(star(spark, sf, ["orders", "customer", "nation", "region"]))
    counts = before.profiles.groupBy("table_id").agg(F.max("row_count").alias("row_count"))
    catalog = before.tables.catalog().select("table_id", "table_name", "column_count").join(counts, "table_id")
    stored = TableSet(spark, [Table("orders", load(spark, sf, "orders").filter("o_orderkey % 100 <> 7"), "o_orderkey"),
                              Table("customer", load(spark, sf, "customer").drop("c_acctbal"), "c_custkey"),
                              Table("region", load(spark, sf, "region"), "r_regionkey")])
    names = catalog.select(F.col("table_id").alias("subject"), "table_name")
    return U.audit(catalog, stored).join(names, "subject").select("code", "table_name", "expected", "actual")


AUDIT_SQL = """SELECT 'AUDIT_ROW_COUNT' AS code, 'orders' AS table_name, count(*) AS expected, count(*) FILTER (o_orderkey % 100 <> 7) AS actual FROM orders
UNION ALL SELECT 'AUDIT_COLUMN_COUNT', 'customer', 5, 4 UNION ALL SELECT 'AUDIT_TABLE_MISSING', 'nation', NULL, NULL"""


def _publish(spark, sf):
    """Three runs of facts: two pass, one fails its audit and leaves the last good run current."""
    store = RunStore(spark, new_folder(spark, "store"))
    for run_id, cut in (("r1", 1), ("r2", 2), ("r3", 3)):
        tables = TableSet(spark, [Table("orders", load(spark, sf, "orders").filter(f"o_orderkey >= {cut}"), "o_orderkey")])
        store.write(run_id, "profiles", P.profile(tables))
        broken = U.audit(tables.catalog().withColumn("row_count", F.lit(-1).cast("long")), tables) if run_id == "r3" else None
        try:
            store.finish(run_id, issues=broken)
        except NotPublished:
            pass
    current, previous = store.current(), store.previous()
    return store.read("profiles").select("column_name", "n", F.lit(current).alias("run_id"), F.lit(previous).alias("previous_run"))


PUBLISH_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, 'r2' AS run_id, 'r1' AS previous_run FROM orders WHERE o_orderkey >= 2"
                                 for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


def _refresh(spark, sf):
    """Two whole runs over renamed orders and customers; the second misses some orders. What the last one published."""
    store = RunStore(spark, new_folder(spark, "store"))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))
    pack = {"pack": {"name": "p", "version": "1"}, "key": [{"table": "orders", "columns": ["order_id"]}],
            "kpi": [{"id": "orders", "sql": "SELECT count(*) FROM {{table:local/orders}}"}]}
    for run_id, cut in (("r1", 0), ("r2", 10)):
        o = renamed_orders(spark, sf).filter(f"order_id >= {cut}")
        tables = TableSet(spark, [Table("orders", o, "order_id"), Table("customers", c, "customer_id")])
        refresh(tables, store, run_id, dt.date(2024, 6, 30), [pack])
    kinds = store.read("changes").groupBy(F.concat(F.lit("change "), "kind").alias("fact")).agg(F.count(F.lit(1)).alias("rows"))
    links = store.read("relationships").groupBy(F.concat(F.lit("link "), "from_name").alias("fact")).agg(F.count(F.lit(1)).alias("rows"))
    keys = store.read("keys").filter("status = 'confirmed'").groupBy(F.concat(F.lit("key "), F.array_join("column_names", ",")).alias("fact")).agg(
        F.count(F.lit(1)).alias("rows"))
    kpi = store.read("kpis").select(F.lit("kpi").alias("fact"), F.col("value").cast("long").alias("rows"))
    return kinds.filter("fact IN ('change volume', 'change row', 'change kpi', 'change value')").unionByName(links).unionByName(keys).unionByName(kpi)


REFRESH_SQL = """SELECT * FROM (VALUES ('change volume', CAST(1 AS BIGINT)), ('change row', 1), ('change kpi', 1), ('change value', 1), ('link customer_id', 1),
  ('key order_id', 1)) v(fact, "rows") UNION ALL SELECT 'kpi', count(*) FROM orders WHERE o_orderkey >= 10"""


# ---- views and read tools ---------------------------------------------------------------------------------------
def _sql_views(spark, sf):
    """Free SQL: the plain name leaves out total rows, the qualified name keeps them."""
    tables = TableSet(spark, [Table("sales", sales_with_totals(spark, sf), "row_no", source="reports"), *star(spark, sf, ["nation"]).tables])
    views = Views(tables, Q.totals_rows(tables))
    return views.sql("""WITH everything AS (SELECT regexp_replace(region, ' Total$', '') AS nation, sum(orders) AS all_orders FROM reports__sales GROUP BY 1)
                        SELECT n.n_name AS nation, sum(s.orders) AS clean_orders, max(e.all_orders) AS all_orders,
                        rank() OVER (ORDER BY sum(s.orders) DESC, n.n_name) AS place
                        FROM nation n JOIN sales s ON s.region = n.n_name JOIN everything e ON e.nation = n.n_name GROUP BY n.n_name""").select(
        "nation", "clean_orders", "all_orders", F.col("place").cast("long").alias("place"))


SQL_VIEWS_SQL = f"""WITH s AS ({SALES_WITH_TOTALS_SQL}) SELECT n_name AS nation, CAST(sum(orders) AS BIGINT) AS clean_orders,
  CAST((SELECT sum(orders) FROM s r WHERE regexp_replace(r.region, ' Total$', '') = n_name) AS BIGINT) AS all_orders,
  CAST(rank() OVER (ORDER BY sum(orders) DESC, n_name) AS BIGINT) AS place FROM nation JOIN s ON region = n_name GROUP BY n_name"""


def _sql_functions(spark, sf):
    """Text normal forms inside free SQL."""
    views = Views(star(spark, sf, ["orders", "part"]))
    return views.sql("""SELECT fold(o_orderpriority) AS form, count(*) AS n FROM orders GROUP BY 1
                        UNION ALL SELECT search_form(concat('Größe_', p_type, '  ٣')), count(*) FROM part GROUP BY 1""")


SQL_FUNCTIONS_SQL = """SELECT replace(lower(o_orderpriority), '-', ' ') AS form, count(*) AS n FROM orders GROUP BY 1
UNION ALL SELECT 'grösse ' || lower(p_type) || ' 3', count(*) FROM part GROUP BY 1"""


def _sql_set_operations(spark, sf):
    """INTERSECT, EXCEPT and UNION, with and without ALL, over several tables in free SQL."""
    views = Views(star(spark, sf, ["orders", "customer", "supplier", "nation"]))
    return views.sql("""WITH customers AS (SELECT c_nationkey AS nation, c_acctbal > 0 AS pays FROM customer),
                             suppliers AS (SELECT s_nationkey AS nation, s_acctbal > 0 AS pays FROM supplier)
        SELECT 'both' AS part, nation, count(*) AS n FROM (SELECT * FROM customers INTERSECT ALL SELECT * FROM suppliers) GROUP BY nation
        UNION ALL SELECT 'customers only', nation, count(*) FROM (SELECT * FROM customers EXCEPT ALL SELECT * FROM suppliers) GROUP BY nation
        UNION SELECT 'without orders', c_nationkey, count(*) FROM customer
              WHERE c_custkey IN (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) GROUP BY c_nationkey
        UNION SELECT 'unused nation', nation, 1 FROM (SELECT n_nationkey AS nation FROM nation EXCEPT (SELECT nation FROM customers INTERSECT SELECT nation FROM suppliers))""")


SET_OPERATIONS_SQL = """WITH customers AS (SELECT c_nationkey AS nation, c_acctbal > 0 AS pays FROM customer),
  suppliers AS (SELECT s_nationkey AS nation, s_acctbal > 0 AS pays FROM supplier)
SELECT 'both' AS part, nation, count(*) AS n FROM (SELECT * FROM customers INTERSECT ALL SELECT * FROM suppliers) GROUP BY nation
UNION ALL SELECT 'customers only', nation, count(*) FROM (SELECT * FROM customers EXCEPT ALL SELECT * FROM suppliers) GROUP BY nation
UNION ALL SELECT 'without orders', c_nationkey, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY c_nationkey
UNION ALL SELECT 'unused nation', n_nationkey, 1 FROM nation WHERE n_nationkey NOT IN (SELECT nation FROM customers INTERSECT SELECT nation FROM suppliers)"""


def _sql_envelopes(spark, sf):
    """What the bounded SQL tool says of a whole, a row-capped and a byte-capped answer."""
    reader = Reader(Facts(star(spark, sf, ["orders", "nation"])))
    asked = ["SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey ORDER BY n_regionkey",
             "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey"]
    shown = envelopes(spark, [reader.query(asked[0]), reader.query(asked[1], rows=20), reader.query(asked[2], size=100)])
    return shown.select("tool", F.array_join("columns", ",").alias("columns"), F.concat(F.lit("["), F.array_join("rows", ", "), F.lit("]")).alias("rows"), "row_count", "total_rows",
                        "truncated", F.col("evidence")["statement"].alias("statement"))


SQL_ENVELOPES_SQL = """WITH a AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1),
o AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20),
c AS (SELECT n_nationkey, n_name, sum(length('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') + 2) OVER (ORDER BY n_nationkey) AS b FROM nation)
SELECT 'sql' AS tool, 'n_regionkey,n' AS columns, '[' || string_agg('[' || n_regionkey || ', ' || n || ']', ', ' ORDER BY n_regionkey) || ']' AS "rows", count(*) AS row_count, count(*) AS total_rows,
  false AS truncated, 'SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey ORDER BY n_regionkey' AS statement FROM a
UNION ALL SELECT 'sql', 'o_orderkey,o_orderstatus', '[' || string_agg('[' || o_orderkey || ', "' || o_orderstatus || '"]', ', ' ORDER BY o_orderkey) || ']', count(*), (SELECT count(*) FROM orders),
  true, 'SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey' FROM o
UNION ALL SELECT 'sql', 'n_nationkey,n_name', '[' || string_agg('[' || n_nationkey || ', "' || n_name || '"]', ', ' ORDER BY n_nationkey) || ']', count(*), (SELECT count(*) FROM nation),
  true, 'SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey' FROM c WHERE b <= 100"""


def _capped(spark, sf):
    """A bounded read of the ten cheapest parts within 400 bytes."""
    p = load(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_partkey")
    return capped(p, rows=10, size=400)


CAPPED_SQL = """SELECT p_partkey, p_name FROM (SELECT *, sum(length('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}') + 2) OVER (ORDER BY p_partkey) AS b,
  row_number() OVER (ORDER BY p_partkey) AS i FROM part) WHERE b <= 400 AND i <= 10"""


def _schema_tool(spark, sf):
    r = Reader(Facts(star(spark, sf, ["region", "nation", "orders"])))
    return r.schema().select("table_name", "rows", F.array_join("columns", ",").alias("columns"))


SCHEMA_SQL = """SELECT 'region' AS table_name, (SELECT count(*) FROM region) AS rows, 'r_regionkey,r_name' AS columns
UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 'n_nationkey,n_name,n_regionkey'
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority'"""


def _describe_tool(spark, sf):
    r = Reader(Facts(star(spark, sf, ["orders"])))
    return r.describe("orders").select("column_name", "n", "nulls", "distinct_count", F.size("top_k").cast("long").alias("shown"),
                                       F.col("top_k")[0]["cnt"].alias("top_count"))


DESCRIBE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_count, "
    f"CAST(least(5, count(DISTINCT {c})) AS BIGINT) AS shown, (SELECT max(k) FROM (SELECT count(*) AS k FROM orders GROUP BY {c})) AS top_count FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


def _trace_tool(spark, sf):
    """The rows behind the largest price of each priority, by source row."""
    facts = Facts(star(spark, sf, ["orders"]))
    t = facts.tables.table("orders")
    top = t.df.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("row"))
    traced = t.df.join(top.select("row"), t.row_column == F.col("row"))
    return traced.select("o_orderkey", "o_totalprice", F.lit(t.table_id).alias("table_id").isNotNull().alias("known"))


TRACE_SQL = """SELECT o_orderkey, o_totalprice, true AS known FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1"""

QUERIES = {
    "rules_pack": _rules, "kpis_pack": _kpis, "count_rules_lineitem": _count_rules, "repairs_planted": _repairs,
    "repaired_view_planted": _repaired, "repairs_after_second_file": _repairs_after_second_file, "changes_two_runs": _changes, "change_counts": _change_counts, "row_difference_lineitem": _row_difference,
    "lineage_formulas": _lineage, "readiness": _readiness, "gaps": _gaps, "catalog_report": _report, "audit_tables": _audit,
    "publish_runs": _publish, "refresh_two_runs": _refresh, "sql_views": _sql_views, "sql_functions": _sql_functions, "sql_set_operations": _sql_set_operations, "sql_envelopes": _sql_envelopes, "capped_read": _capped, "schema_tool": _schema_tool, "describe_tool": _describe_tool,
    "trace_tool": _trace_tool,
}
ORACLE = {
    "rules_pack": RULES_SQL, "kpis_pack": KPIS_SQL, "count_rules_lineitem": COUNT_RULES_SQL, "repairs_planted": REPAIRS_SQL,
    "repaired_view_planted": REPAIRED_SQL, "repairs_after_second_file": REPAIRS_AFTER_SQL, "changes_two_runs": CHANGES_SQL, "row_difference_lineitem": ROW_DIFFERENCE_SQL,
    "lineage_formulas": LINEAGE_SQL, "readiness": READINESS_SQL, "gaps": GAPS_SQL, "catalog_report": REPORT_SQL, "audit_tables": AUDIT_SQL,
    "publish_runs": PUBLISH_SQL, "refresh_two_runs": REFRESH_SQL, "sql_views": SQL_VIEWS_SQL, "sql_functions": SQL_FUNCTIONS_SQL, "sql_set_operations": SET_OPERATIONS_SQL, "sql_envelopes": SQL_ENVELOPES_SQL, "capped_read": CAPPED_SQL, "schema_tool": SCHEMA_SQL,
    "describe_tool": DESCRIBE_SQL, "trace_tool": TRACE_SQL,
}
