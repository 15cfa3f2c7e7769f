"""Queries on profiles, row contents, quality, keys, meaning and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..operators import profile as P, quality as Q, relations as R, rows, semantics as S
from ..operators.frequencies import value_frequencies
from ..tables import Table, TableSet
from .facts import Facts
from .inputs import (CORE, DIRTY_ORDERS_SQL, SALES_WITH_TOTALS_SQL, base_table, dirty_orders, load, renamed_orders,
                     sales_with_totals, star)

NUMBERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"], "documents": ["doc_id", "n_chars"], "labels": ["doc_id", "quality", "toxic"],
    "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"]}
TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"],
    "labels": [], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"]}
TIMES = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}


def _time_text(c: str, agg: str) -> str:
    whole = f"strftime({agg}({c}), '%Y-%m-%d %H:%M:%S')"
    micro = f"(CASE WHEN microsecond({agg}({c})) % 1000000 = 0 THEN '' ELSE rtrim(strftime({agg}({c}), '.%f'), '0') END)"
    return f"{whole} || {micro}"


def _profile_sql(names):
    parts = []
    for t in names:
        for c in NUMBERS[t]:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls, "
                         f"count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS DOUBLE) AS min_num, CAST(max({c}) AS DOUBLE) "
                         f"AS max_num, round(avg({c}), 4) AS mean, NULL AS min_text, NULL AS max_text FROM {t}")
        for c in TEXTS[t] + TIMES.get(t, []):
            lo, hi = (_time_text(c, "min"), _time_text(c, "max")) if c in TIMES.get(t, []) else (f"min({c})", f"max({c})")
            parts.append(f"SELECT '{t}', '{c}', count({c}), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, "
                         f"{lo}, {hi} FROM {t}")
    return " UNION ALL ".join(parts)


def _profile(names):
    def run(spark, sf):
        p = P.profile(star(spark, sf, names))
        return p.select("table_name", "column_name", "n", "nulls", "distinct_count", "min_num", "max_num",
                        F.round("mean", 4).alias("mean"), "min_text", "max_text")
    return run


def _topk(names):
    def run(spark, sf):
        top = P.top_values(star(spark, sf, names), 5).filter(~F.col("is_digest") & (F.col("kind") != "datetime"))
        return top.select("table_name", "column_name", F.col("rank").cast("long").alias("rank"), "value_num",
                          F.when(F.col("kind") == "text", F.col("value_text")).alias("value_text"), "cnt")
    return run


def _topk_sql(names):
    parts = []
    for t in names:
        for c in NUMBERS[t]:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) "
                         f"AS BIGINT) AS rank, CAST({c} AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS value_text, count(*) AS cnt "
                         f"FROM {t} GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) <= 5")
        for c in TEXTS[t]:
            parts.append(f"SELECT '{t}', '{c}', row_number() OVER (ORDER BY count(*) DESC, {c}), NULL, {c}, count(*) "
                         f"FROM {t} GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) <= 5")
    return " UNION ALL ".join(parts)


def _hash_orders(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    counts = rows.row_hash_counts(Table("orders", o, "o_orderkey"), ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return counts.select("row_hash", "n")


HASH_ORDERS_SQL = """SELECT sha256(CAST(to_json([CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS VARCHAR)) AS row_hash,
  count(*) AS n FROM orders GROUP BY 1"""

FINGERPRINT_TABLES = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
                      "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"],
                      "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]}


def _fingerprints(spark, sf):
    parts = None
    for name, columns in FINGERPRINT_TABLES.items():
        t = base_table(spark, sf, name)
        one = rows.fingerprints(rows.row_hash_counts(t, columns)).select(F.lit(name).alias("table_name"), "row_count", "fingerprint")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _fingerprint_sql():
    parts = []
    for name, columns in FINGERPRINT_TABLES.items():
        texts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
        sums = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))
        parts.append(f"SELECT '{name}' AS table_name, count(*) AS row_count, sha256(CAST(count(*) AS VARCHAR) || ':' || {sums}) AS fingerprint "
                     f"FROM (SELECT sha256(CAST(to_json([{texts}]) AS VARCHAR)) AS h FROM {name})")
    return " UNION ALL ".join(parts)


def _dirty_set(spark, sf):
    return TableSet(spark, [Table("dirty_orders", dirty_orders(spark, sf), "o_orderkey",
                                  headers={"nearly_all_null": None}),
                            Table("sales", sales_with_totals(spark, sf), "row_no", hide_row_id=True)])


def _findings(spark, sf):
    tables = _dirty_set(spark, sf)
    f = Q.findings(tables).join(tables.catalog().select("table_id", "table_name"), "table_id")
    named = tables.columns().select("column_id", "column_name")
    return f.join(named, "column_id", "left").select("code", "severity", "table_name", "column_name", "count",
                                                     F.array_join("examples", "|").alias("examples"))


def _findings_sql():
    text = ["status", "priority", "amount_text", "currency"]
    every = text + ["o_orderkey", "mostly_null", "nearly_all_null"]
    tokens = "('n/a','na','null','none','-','--','nil','(blank)','blank')"
    parts = []
    for c in every:
        parts.append(f"SELECT 'DQ_HIGH_NULL' AS code, CASE WHEN count({c}) * 10 <= count(*) THEN 'error' ELSE 'warn' END AS severity, "
                     f"'dirty_orders' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS count, '' AS examples "
                     f"FROM d HAVING count({c}) * 2 <= count(*)")
        parts.append(f"SELECT 'DQ_CONSTANT', 'info', 'dirty_orders', '{c}', count({c}), '' FROM d "
                     f"HAVING count({c}) > 1 AND count(DISTINCT {c}) = 1")
    for c in text:
        parts.append(f"SELECT 'DQ_NULL_TOKEN', 'warn', 'dirty_orders', '{c}', count(*), "
                     f"array_to_string(list_sort(list(DISTINCT {c}))[1:3], '|') FROM d "
                     f"WHERE lower(trim({c})) IN {tokens} HAVING count(*) > 0")
    parts.append("SELECT 'DQ_GENERATED_HEADER', 'info', 'dirty_orders', 'nearly_all_null', CAST(1 AS BIGINT), 'nearly_all_null'")
    parts.append("SELECT 'DQ_TOTALS_ROW_IN_DATA', 'warn', 'sales', NULL, count(*), "
                 "array_to_string(list_sort(list(DISTINCT region))[1:3], '|') FROM s WHERE region LIKE '% Total'")
    for c in ("region", "priority", "amount", "orders"):
        parts.append(f"SELECT 'DQ_HIGH_NULL', CASE WHEN count({c}) * 10 <= count(*) THEN 'error' ELSE 'warn' END, 'sales', '{c}', "
                     f"count(*) - count({c}), '' FROM s HAVING count({c}) * 2 <= count(*)")
    return f"WITH d AS ({DIRTY_ORDERS_SQL}), s AS ({SALES_WITH_TOTALS_SQL}) " + " UNION ALL ".join(parts)


def _totals(spark, sf):
    sales = TableSet(spark, [Table("sales", sales_with_totals(spark, sf), "row_no", hide_row_id=True)])
    return Q.totals_rows(sales).select("row_id", "flag", "detail")


TOTALS_SQL = f"""SELECT row_no AS row_id, 'totals_candidate' AS flag, region AS detail FROM ({SALES_WITH_TOTALS_SQL})
  WHERE lower(trim(region)) IN ('total', 'grand total') OR (length(region) <= 40 AND (lower(region) LIKE '% total' OR lower(region) LIKE 'total %'))"""


def _clean_sums(spark, sf):
    t = Table("sales", sales_with_totals(spark, sf), "row_no", hide_row_id=True)
    clean = Q.without_flagged(t, Q.totals_rows(TableSet(spark, [t])))
    return clean.groupBy("priority").agg(F.round(F.sum("amount"), 2).alias("amount"), F.sum("orders").alias("orders"))


CLEAN_SUMS_SQL = f"""SELECT priority, round(sum(amount), 2) AS amount, CAST(sum(orders) AS BIGINT) AS orders FROM ({SALES_WITH_TOTALS_SQL})
  WHERE NOT (lower(region) LIKE '% total' OR lower(region) = 'grand total') GROUP BY priority"""


def _keys(spark, sf):
    tables = star(spark, sf)
    return Facts(tables).keys.join(tables.catalog().select("table_id", "table_name"), "table_id").select(
        "table_name", F.array_join("column_names", ",").alias("columns"), F.round("uniqueness", 6).alias("uniqueness"),
        F.round("null_rate", 6).alias("null_rate"), "status", "method")


def _keys_sql():
    parts = []
    for t in CORE:
        for c in NUMBERS[t] + TEXTS[t] + TIMES.get(t, []):
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS columns, round(count(DISTINCT {c}) / count(*), 6) AS uniqueness, "
                         f"round((count(*) - count({c})) / count(*), 6) AS null_rate, 'inferred' AS status, "
                         f"'single_column_uniqueness' AS method FROM {t} HAVING count(DISTINCT {c}) / count(*) >= 0.98 "
                         f"AND (count(*) - count({c})) / count(*) <= 0.02")
    # a table without a single key gets its first qualifying pair; of the given tables only line items can need one
    singles = " OR ".join(f"count(DISTINCT {c}) / count(*) >= 0.98" for c in NUMBERS["lineitem"] + TEXTS["lineitem"] + TIMES["lineitem"])
    parts.append("SELECT 'lineitem', 'l_orderkey,l_extendedprice', round((SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_extendedprice FROM lineitem)) / count(*), 6), "
                 f"0, 'inferred', 'composite_uniqueness' FROM lineitem HAVING NOT ({singles}) AND count(DISTINCT l_orderkey) / count(*) >= 0.1 "
                 "AND count(DISTINCT l_extendedprice) / count(*) >= 0.1 "
                 "AND (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_extendedprice FROM lineitem)) / count(*) >= 0.98")
    return " UNION ALL ".join(parts)


def _composite(spark, sf):
    """A table whose key is a pair of columns, one without any key, and one whose key the user declares."""
    k = F.col("o_orderkey")
    o = load(spark, sf, "orders").select(
        k, F.floor(k / 3).alias("block"), ((k % 3) * 10_000_000 + F.floor(k / 6)).alias("slot"),
        F.when(k % 100 != 0, F.floor(k / 2)).alias("half"), "o_orderstatus")
    p = load(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 4).alias("a"), F.floor(F.col("p_partkey") / 5).alias("b"))
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    tables = TableSet(spark, [Table("slots", o, "o_orderkey", hide_row_id=True), Table("parts", p, "p_partkey", hide_row_id=True),
                              Table("turns", c, F.col("conv_id") * 1000 + F.col("turn"))])
    facts = Facts(tables, declared_keys={"turns": ["conv_id", "turn"]})
    return facts.keys.join(tables.catalog().select("table_id", "table_name"), "table_id").select(
        "table_name", F.array_join("column_names", ",").alias("columns"), F.round("uniqueness", 6).alias("uniqueness"),
        F.round("null_rate", 6).alias("null_rate"), "status", "method")


def _composite_late(spark, sf):
    """Nine candidate columns over every order, of which only the eighth and ninth together are a key."""
    k = F.col("o_orderkey")
    columns = [F.floor((k + i) / 9).alias(f"c{i + 1}") for i in range(7)]
    o = load(spark, sf, "orders").select(k, *columns, F.floor(k / 8).alias("c8"), ((k % 8) * 1_000_000_000 + F.floor(k / 64)).alias("c9"), "o_orderpriority")
    tables = TableSet(spark, [Table("late", o, "o_orderkey", hide_row_id=True)])
    return Facts(tables).keys.select(F.array_join("column_names", ",").alias("columns"), F.round("uniqueness", 6).alias("uniqueness"),
                                     F.round("null_rate", 6).alias("null_rate"), "status", "method")


COMPOSITE_LATE_SQL = """
WITH d AS (SELECT o_orderkey // 8 AS c8, (o_orderkey % 8) * 1000000000 + o_orderkey // 64 AS c9 FROM orders)
SELECT 'c8,c9' AS columns, round((SELECT count(*) FROM (SELECT DISTINCT c8, c9 FROM d)) / count(*), 6) AS uniqueness, CAST(0 AS DOUBLE) AS null_rate,
       'inferred' AS status, 'composite_uniqueness' AS method FROM d"""


COMPOSITE_SQL = """
WITH d AS (SELECT o_orderkey // 3 AS block, (o_orderkey % 3) * 10000000 + o_orderkey // 6 AS slot FROM orders)
SELECT 'slots' AS table_name, 'block,slot' AS columns,
       round((SELECT count(*) FROM (SELECT DISTINCT block, slot FROM d)) / count(*), 6) AS uniqueness, CAST(0 AS DOUBLE) AS null_rate,
       'inferred' AS status, 'composite_uniqueness' AS method FROM d
UNION ALL SELECT 'turns', 'conv_id,turn', NULL, NULL, 'confirmed', 'declared'"""


def _relations(spark, sf):
    tables = star(spark, sf)
    named = R.named_relationships(tables, Facts(tables).relationships)
    return named.select("from_table", "from_name", "to_table", "to_name", F.round("containment", 6).alias("containment"),
                        F.round("score", 4).alias("score"), "status", "method")


# (child table, child column, parent table, parent column, name score): name scores are 2 * matched / total letters
NAME_PAIRS = [("nation", "n_regionkey", "region", "r_regionkey", 0.9), ("customer", "c_nationkey", "nation", "n_nationkey", 0.9),
              ("supplier", "s_nationkey", "nation", "n_nationkey", 0.9), ("orders", "o_custkey", "customer", "c_custkey", 0.875),
              ("lineitem", "l_orderkey", "orders", "o_orderkey", 16 / 18), ("lineitem", "l_partkey", "part", "p_partkey", 0.875),
              ("lineitem", "l_suppkey", "supplier", "s_suppkey", 0.875), ("labels", "doc_id", "documents", "doc_id", 1.0),
              ("documents", "doc_id", "labels", "doc_id", 1.0), ("customer", "c_acctbal", "supplier", "s_acctbal", 0.875),
              ("supplier", "s_acctbal", "customer", "c_acctbal", 0.875), ("documents", "text", "benchmark", "text", 1.0),
              ("benchmark", "text", "documents", "text", 1.0), ("documents", "text", "conversations", "text", 1.0),
              ("conversations", "text", "documents", "text", 1.0), ("benchmark", "text", "conversations", "text", 1.0),
              ("conversations", "text", "benchmark", "text", 1.0)]


def _relations_sql():
    parts = []
    for ct, cc, pt, pc, name in NAME_PAIRS:
        parts.append(
            f"SELECT '{ct}' AS from_table, '{cc}' AS from_name, '{pt}' AS to_table, '{pc}' AS to_name, "
            f"round(avg(CASE WHEN v IN (SELECT {pc} FROM {pt}) THEN 1.0 ELSE 0.0 END), 6) AS containment, "
            f"round(least(1.0, 0.65 * avg(CASE WHEN v IN (SELECT {pc} FROM {pt}) THEN 1.0 ELSE 0.0 END) + 0.25 * {name!r} "
            f"+ 0.1 * (SELECT count(DISTINCT {pc}) / count(*) FROM {pt})), 4) AS score, 'inferred' AS status, "
            f"'key_name_containment' AS method FROM (SELECT DISTINCT {cc} AS v FROM {ct}) "
            f"HAVING avg(CASE WHEN v IN (SELECT {pc} FROM {pt}) THEN 1.0 ELSE 0.0 END) >= 0.9 "
            f"AND (SELECT count(DISTINCT {pc}) / count(*) FROM {pt}) >= 0.98 "
            f"AND count(*) >= (SELECT CASE WHEN count(*) < 50 THEN 3 ELSE 5 END FROM {ct})")
    return " UNION ALL ".join(parts)


def _recipes(spark, sf):
    tables = star(spark, sf, ["region", "nation", "customer", "orders"])
    return R.join_recipes(tables, Facts(tables).relationships).select("from_table", "to_table", "join_sql", "status")


RECIPES_SQL = """SELECT 'nation' AS from_table, 'region' AS to_table, 'FROM `nation` a JOIN `region` b ON a.`n_regionkey` = b.`r_regionkey`' AS join_sql, 'inferred' AS status
UNION ALL SELECT 'customer', 'nation', 'FROM `customer` a JOIN `nation` b ON a.`c_nationkey` = b.`n_nationkey`', 'inferred'
UNION ALL SELECT 'orders', 'customer', 'FROM `orders` a JOIN `customer` b ON a.`o_custkey` = b.`c_custkey`', 'inferred'"""


def _renamed_set(spark, sf):
    c = load(spark, sf, "customer")
    return TableSet(spark, [
        Table("orders", renamed_orders(spark, sf), "order_id"),
        Table("customers", c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                                    F.col("c_acctbal").alias("balance_usd"), F.col("c_mktsegment").alias("segment"),
                                    F.col("c_nationkey").alias("nation code")), "customer_id")])


def _roles(spark, sf):
    return S.column_roles(_renamed_set(spark, sf)).select(
        "table_name", "column_name", "role", "confidence", "status", "unit", "currency")


def _roles_sql():
    # name class per column, then the numeric/textual rules on measured uniqueness
    rules = [("orders", "order_id", "o_orderkey", "id", "num"), ("orders", "customer_id", "o_custkey", "id", "num"),
             ("orders", "status", "o_orderstatus", "", "text"), ("orders", "amount", "o_totalprice", "money", "num"),
             ("orders", "order_date", "o_orderdate", "", "date"), ("orders", "priority", "o_orderpriority", "", "text"),
             ("customers", "customer_id", "c_custkey", "id", "num"), ("customers", "customer_name", "c_name", "", "text"),
             ("customers", "balance_usd", "c_acctbal", "money", "num"), ("customers", "segment", "c_mktsegment", "", "text"),
             ("customers", "nation code", "c_nationkey", "id", "num")]
    source = {"orders": "orders", "customers": "customer"}
    parts = []
    for t, c, raw, word, kind in rules:
        u, d = f"count(DISTINCT {raw}) / greatest(1, count({raw}))", f"count(DISTINCT {raw})"
        if kind == "date":
            role, conf = "max('date')", "max(0.95)"
        elif word == "id":
            role = f"CASE WHEN {u} >= 0.9 THEN 'identifier' ELSE 'code' END"
            conf = f"CASE WHEN {u} >= 0.9 THEN 0.9 ELSE {'0.6' if kind == 'num' else '0.55'} END"
        elif word == "money":
            role, conf = "max('money')", "max(0.75)"
        else:
            role = (f"CASE WHEN {d} <= 2 AND bool_and(lower({raw}) IN ('true','false','yes','no','y','n','0','1')) THEN 'boolean' "
                    f"WHEN {u} <= 0.5 AND {d} <= 50 THEN 'category' WHEN {u} >= 0.98 THEN 'identifier' "
                    f"WHEN {u} >= 0.7 THEN 'free_text' ELSE 'unknown' END")
            conf = f"CASE WHEN {u} <= 0.5 AND {d} <= 50 THEN 0.6 WHEN {u} >= 0.98 THEN 0.4 WHEN {u} >= 0.7 THEN 0.5 ELSE 0.0 END"
        unit, cur = ("'currency'", "'USD'") if "usd" in c else ("NULL", "NULL")
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {role} AS role, CAST({conf} AS DOUBLE) AS confidence, "
                     f"'inferred' AS status, {unit} AS unit, {cur} AS currency FROM {source[t]}")
    return " UNION ALL ".join(parts)


def _grain(spark, sf):
    tables = star(spark, sf, ["region", "nation", "customer", "orders", "labels", "events"])
    nokey = Table("sizes", load(spark, sf, "part").select("p_partkey", "p_size", "p_type"), "p_partkey", hide_row_id=True)
    tables = TableSet(spark, tables.tables + [nokey])
    facts = Facts(tables, declared_keys={"customer": ["c_custkey"], "orders": ["o_orderkey"], "events": ["event_id"]})
    return facts.grain.select("table_name", "columns", "status", F.round("confidence", 6).alias("confidence"), "method")


GRAIN_SQL = """SELECT 'region' AS table_name, 'r_regionkey' AS columns, 'inferred' AS status, CAST(1 AS DOUBLE) AS confidence, 'single_column_uniqueness' AS method
UNION ALL SELECT 'nation', 'n_nationkey', 'inferred', (SELECT count(DISTINCT n_nationkey) / count(*) FROM nation), 'single_column_uniqueness'
UNION ALL SELECT 'labels', 'doc_id', 'inferred', (SELECT count(DISTINCT doc_id) / count(*) FROM labels), 'single_column_uniqueness'
UNION ALL SELECT 'customer', 'c_custkey', 'confirmed', (SELECT count(DISTINCT c_custkey) / count(*) FROM customer), 'declared'
UNION ALL SELECT 'orders', 'o_orderkey', 'confirmed', (SELECT count(DISTINCT o_orderkey) / count(*) FROM orders), 'declared'
UNION ALL SELECT 'events', 'event_id', 'confirmed', (SELECT count(DISTINCT event_id) / count(*) FROM events), 'declared'
UNION ALL SELECT 'sizes', NULL, 'unknown', CAST(0 AS DOUBLE), 'none'"""


def _coverage(spark, sf):
    tables = star(spark, sf, ["orders", "lineitem", "events"])
    return S.time_coverage(P.profile(tables)).select("table_name", "column_name", "min_value", "max_value")


COVERAGE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_time_text(c, 'min')} AS min_value, {_time_text(c, 'max')} AS max_value FROM {t}"
    for t, cs in TIMES.items() for c in cs)


def _duplicates(spark, sf):
    """Two monthly copies of orders that share most rows, an exact copy of nation, and an unrelated table."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    n = load(spark, sf, "nation")
    tables = TableSet(spark, [
        Table("orders", o.filter("o_orderkey % 10 <> 0"), "o_orderkey", source="jan"),
        Table("orders", o.filter("o_orderkey % 10 <> 1"), "o_orderkey", source="feb"),
        Table("nation", n, "n_nationkey", source="jan"), Table("nations", n, "n_nationkey", source="feb"),
        Table("region", load(spark, sf, "region"), "r_regionkey", source="feb")])
    d = S.duplicate_tables(tables)
    named = tables.catalog().select("table_id", F.concat("source_id", F.lit("/"), "table_name").alias("name"))
    pairs = d.join(named.toDF("table_id_a", "a"), "table_id_a").join(named.toDF("table_id_b", "b"), "table_id_b")
    return pairs.select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("other"), F.round("score", 6).alias("score"))


DUPLICATES_SQL = """
SELECT 'feb/orders' AS one, 'jan/orders' AS other, round(0.5 + 0.5 * (SELECT count(*) FROM orders WHERE o_orderkey % 10 NOT IN (0, 1))
  / least((SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0), (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 1)), 6) AS score
UNION ALL SELECT 'feb/nations', 'jan/nation', CAST(1 AS DOUBLE)"""


def _kinds(spark, sf):
    tables = TableSet(spark, [*star(spark, sf, ["nation", "orders"]).tables,
                              Table("sales", sales_with_totals(spark, sf), "row_no", hide_row_id=True),
                              Table("none", load(spark, sf, "region").filter("r_regionkey < 0"), "r_regionkey"),
                              Table("calc", load(spark, sf, "supplier"), "s_suppkey", formula_cells=10 ** 9),
                              Table("pivot", load(spark, sf, "region"), "r_regionkey", pivot_tables=1),
                              Table("memo", load(spark, sf, "region"), "r_regionkey", header_row=None)])
    return S.table_kinds(tables, P.profile(tables), Q.totals_rows(tables)).select("table_name", "row_count", "table_kind", "confidence")


KINDS_SQL = f"""SELECT 'nation' AS table_name, (SELECT count(*) FROM nation) AS row_count, 'data' AS table_kind, CAST(0.7 AS DOUBLE) AS confidence
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 'data', 0.7
UNION ALL SELECT 'sales', count(*), CASE WHEN count(*) <= 50 THEN 'report' ELSE 'data' END, CASE WHEN count(*) <= 50 THEN 0.4 ELSE 0.7 END FROM ({SALES_WITH_TOTALS_SQL})
UNION ALL SELECT 'none', 0, 'empty', 1.0
UNION ALL SELECT 'calc', (SELECT count(*) FROM supplier), 'report', 0.5
UNION ALL SELECT 'pivot', (SELECT count(*) FROM region), 'dashboard', 0.6
UNION ALL SELECT 'memo', (SELECT count(*) FROM region), CASE WHEN (SELECT count(*) FROM region) <= 20 THEN 'notes' ELSE 'data' END, CASE WHEN (SELECT count(*) FROM region) <= 20 THEN 0.6 ELSE 0.4 END"""


def _definitions(spark, sf):
    tables = _renamed_set(spark, sf)
    return Facts(tables).definitions.select("term", "meaning", "unit", "status", "origin")


DEFINITIONS_SQL = """SELECT 'orders' AS term, chr(39) || 'orders' || chr(39) || ' (local): ' || count(*) || ' row(s). one row per orders, identified by order_id (inferred, ' ||
  CAST(round(100 * count(DISTINCT o_orderkey) / count(*)) AS INT) || '% unique). time coverage: ' || strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' ||
  strftime(max(o_orderdate), '%Y-%m-%d') || '.' AS meaning, NULL AS unit, 'inferred' AS status, 'auto' AS origin FROM orders
UNION ALL SELECT 'customers', chr(39) || 'customers' || chr(39) || ' (local): ' || count(*) || ' row(s). one row per customers, identified by customer_id (inferred, ' ||
  CAST(round(100 * count(DISTINCT c_custkey) / count(*)) AS INT) || '% unique).', NULL, 'inferred', 'auto' FROM customer
UNION ALL SELECT 'balance_usd', 'money column in USD', 'USD', 'inferred', 'auto'"""


def _samples(spark, sf):
    s = P.sample_values(star(spark, sf, ["nation", "customer", "orders", "events"]), 5)
    return s.groupBy("column_id").agg(F.count(F.lit(1)).alias("shown")).groupBy("shown").agg(F.count(F.lit(1)).alias("columns"))


def _samples_sql():
    parts = [f"SELECT least(5, count(DISTINCT {c})) AS shown FROM {t}" for t in ("nation", "customer", "orders", "events")
             for c in NUMBERS[t] + TEXTS[t] + TIMES.get(t, [])]
    return f"SELECT CAST(shown AS BIGINT) AS shown, count(*) AS columns FROM ({' UNION ALL '.join(parts)}) GROUP BY shown"


def _approximate(spark, sf):
    p = P.approximate_profile(star(spark, sf, ["orders", "lineitem", "documents"]))
    return p.select("table_name", "column_name", "n", "nulls")


APPROXIMATE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls FROM {t}"
    for t in ("orders", "lineitem", "documents") for c in NUMBERS[t] + TEXTS[t] + TIMES.get(t, []))


def _long_values(spark, sf):
    """Documents whose text occurs more than once: found by digest, shown in full."""
    tables = star(spark, sf, ["documents"])
    t = tables.table("documents")
    repeated = value_frequencies(tables).filter((F.col("column_no") == tables.number(t, "text")) & (F.col("cnt") > 1)
                                                & F.col("digest").isNotNull())
    return P.resolve_long_values(t, "text", repeated).select("first_row", "cnt", F.col("full_text").alias("text"))


LONG_VALUES_SQL = """SELECT min(doc_id) AS first_row, count(*) AS cnt, text FROM documents WHERE length(text) > 256
  GROUP BY text HAVING count(*) > 1"""

SHEET_CODES = ["DQ_HEADER_UNDETECTED", "DQ_VERY_WIDE", "DQ_FORMULAS_VALUE_ONLY", "DQ_PIVOT_OUTPUT_ONLY", "DQ_MERGED_IN_DATA",
               "DQ_HEADER_LOW_CONFIDENCE", "DQ_EXCEL_ERRORS", "DQ_MIXED_TYPE"]


def _sheet_findings(spark, sf):
    """What a sheet scan counts beside the cells: headers, formulas, pivots, merged areas, error cells, width, mixed columns."""
    orders, suppliers = load(spark, sf, "orders"), load(spark, sf, "supplier")
    thirds = F.col("o_orderkey") % 3 == 0
    mixed = F.struct(F.when(thirds, F.col("o_totalprice").cast("double")).alias("num"), F.when(~thirds, F.col("o_orderpriority")).alias("txt"))
    broken = F.col("o_custkey") % 10 == 0
    ledger = orders.select("o_orderkey", F.when(~broken, F.col("o_custkey")).alias("customer"), "o_orderstatus", mixed.alias("amount"))
    seen = orders.agg(F.count_if(broken).alias("errors"), F.count_if(F.col("o_totalprice") > 1000).alias("formulas"),
                      F.countDistinct("o_orderstatus").alias("pivots"), F.count_if(F.col("o_orderstatus") == "P").alias("merged")).first()
    wide = suppliers.select("s_suppkey", *[(F.col("s_suppkey") % (i + 2)).alias(f"c{i}") for i in range(499)])
    tables = TableSet(spark, [
        Table("ledger", ledger, "o_orderkey", headers={"customer": None, "o_orderstatus": None}, errors={"customer": seen["errors"]}, header_row=None,
              formula_cells=seen["formulas"], pivot_tables=seen["pivots"], merged_in_data=seen["merged"]),
        Table("Wide Sheet", wide, "s_suppkey")])
    found = Q.findings(tables).filter(F.col("code").isin(SHEET_CODES)).join(tables.catalog().select("table_id", "table_name"), "table_id")
    return found.join(tables.columns().select("column_id", "column_name"), "column_id", "left").select(
        "finding_id", "code", "severity", "table_name", "column_name", "count")


SHEET_FINDINGS_SQL = """
WITH f(code, severity, table_name, column_name, count) AS (
  SELECT 'DQ_HEADER_UNDETECTED', 'info', 'ledger', NULL::VARCHAR, CAST(1 AS BIGINT)
  UNION ALL SELECT 'DQ_VERY_WIDE', 'warn', 'Wide Sheet', NULL, 500
  UNION ALL SELECT 'DQ_FORMULAS_VALUE_ONLY', 'warn', 'ledger', NULL, count(*) FROM orders WHERE o_totalprice > 1000 HAVING count(*) > 0
  UNION ALL SELECT 'DQ_PIVOT_OUTPUT_ONLY', 'warn', 'ledger', NULL, count(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'DQ_MERGED_IN_DATA', 'warn', 'ledger', NULL, 1 FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
  UNION ALL SELECT 'DQ_HEADER_LOW_CONFIDENCE', 'warn', 'ledger', NULL, 2
  UNION ALL SELECT 'DQ_EXCEL_ERRORS', 'warn', 'ledger', 'customer', count(*) FROM orders WHERE o_custkey % 10 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'DQ_MIXED_TYPE', 'warn', 'ledger', 'amount', count(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice::VARCHAR ELSE o_orderpriority END) FROM orders),
ids AS (SELECT *, 'local/sheet-' || sha256(lower(table_name))[1:12] AS table_id FROM f)
SELECT sha1(code || '|' || table_id || coalesce('/col-' || sha256(column_name)[1:12], ''))[1:20] AS finding_id, code, severity, table_name, column_name, count
FROM ids"""


def _printed(spark, sf):
    """Values as they are shown: times of day, dates and stamps; numbers with NaN and infinities."""
    events = load(spark, sf, "events")
    ts, v = F.col("ts").cast("timestamp_ntz"), F.col("value").cast("double")
    third, kind = F.pmod("event_id", F.lit(3)), F.pmod("event_id", F.lit(5))
    zero_day = F.make_timestamp_ntz(F.lit(1899), F.lit(12), F.lit(30), F.hour(ts), F.minute(ts), F.second(ts))
    stamp = F.when(third == 0, zero_day).when(third == 1, F.date_trunc("day", ts).cast("timestamp_ntz")).otherwise(F.date_trunc("second", ts).cast("timestamp_ntz"))
    number = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).when(kind == 2, F.lit(float("-inf"))).otherwise(F.floor(v).cast("double"))
    return events.select("event_id", dates.stamp_to_iso(stamp).alias("shown_at"), numbers.printable(number).alias("shown_value"))


PRINTED_SQL = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M:%S') WHEN event_id % 3 = 1 OR date_trunc('second', ts) = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d')
                      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown_at,
  CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS shown_value
FROM events"""


QUERIES = {
    "profile_all": _profile(CORE), "profile_orders": _profile(["orders"]), "profile_lineitem": _profile(["lineitem"]),
    "topk_all": _topk(CORE[:7]), "samples": _samples, "profile_approximate": _approximate, "long_values_documents": _long_values,
    "row_hash_multiset_orders": _hash_orders, "table_fingerprints": _fingerprints,
    "sheet_findings_planted": _sheet_findings, "printed_events": _printed,
    "dq_planted": _findings, "totals_rows_planted": _totals, "clean_sums_planted": _clean_sums,
    "keys_all": _keys, "composite_keys": _composite, "composite_keys_late": _composite_late, "relationships_all": _relations, "join_recipes": _recipes,
    "roles_renamed": _roles, "grain": _grain, "time_coverage": _coverage, "duplicates_split_orders": _duplicates,
    "table_kinds": _kinds, "definitions": _definitions,
}
ORACLE = {
    "profile_all": _profile_sql(CORE), "profile_orders": _profile_sql(["orders"]), "profile_lineitem": _profile_sql(["lineitem"]),
    "topk_all": _topk_sql(CORE[:7]), "samples": _samples_sql(), "profile_approximate": APPROXIMATE_SQL,
    "long_values_documents": LONG_VALUES_SQL, "row_hash_multiset_orders": HASH_ORDERS_SQL, "table_fingerprints": _fingerprint_sql(),
    "sheet_findings_planted": SHEET_FINDINGS_SQL, "printed_events": PRINTED_SQL,
    "dq_planted": _findings_sql(), "totals_rows_planted": TOTALS_SQL, "clean_sums_planted": CLEAN_SUMS_SQL,
    "keys_all": _keys_sql(), "composite_keys": COMPOSITE_SQL, "composite_keys_late": COMPOSITE_LATE_SQL, "relationships_all": _relations_sql(), "join_recipes": RECIPES_SQL,
    "roles_renamed": _roles_sql(), "grain": GRAIN_SQL, "time_coverage": COVERAGE_SQL, "duplicates_split_orders": DUPLICATES_SQL,
    "table_kinds": KINDS_SQL, "definitions": DEFINITIONS_SQL,
}
