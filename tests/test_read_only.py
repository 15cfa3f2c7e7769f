"""SQL that looks like one SELECT but writes, runs code or reads files is refused by its plan."""

import pytest

from trustframe import Table, TableSet
from trustframe.operators.admission import SqlRefused, UnknownRelation, admit
from trustframe.operators.rules import PackError, resolve_tables, single_select
from trustframe.sources.views import Views

pytestmark = pytest.mark.usefixtures("spark")


@pytest.mark.parametrize("sql", [
    "WITH q AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT * FROM q",
    "WITH q AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM q",
    "with q as (select 1) /* x */ insert /* y */ into t select * from q",
    "SELECT * FROM text.`/etc/hostname`", "select * from `parquet` . `/data`", "SELECT * FROM orders, csv.`/x`", "SELECT (SELECT max(value) FROM text.`/x`)",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "select `java_method` ('a', 'b')", "SELECT try_reflect('a', 'b')",
    "SELECT TRANSFORM(a) USING 'cat' FROM t", "SELECT 1; SELECT 2", "DROP TABLE t",
    "SELECT * FROM (text.`/etc/hostname`)", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT a FROM t UNION ALL TABLE text.`/etc/hostname`",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.name')",
    "SELECT a FROM t WHERE a IN (SELECT value FROM csv.`/x`)", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM json.`/x` WHERE b = a)",
    "SELECT a FROM t LEFT JOIN LATERAL (SELECT * FROM orc.`/x`) ON true", "SELECT max(a) FILTER (WHERE a > (SELECT count(*) FROM avro.`/x`)) FROM t",
    "SELECT sum(a) OVER (ORDER BY (SELECT 1 FROM binaryfile.`/x`)) FROM t", "SELECT transform(a, x -> reflect('a', 'b', x)) FROM t",
    "SELECT * FROM t LATERAL VIEW explode(split(java_method('a', 'b'), ',')) v AS c", "SELECT * FROM other_catalog.db.t", "SELECT * FROM default.t",
    "SELECT input_file_name() FROM t", "SELECT current_user()", "SELECT version()", "SELECT * FROM t VERSION AS OF 1", "SELECT :name", "SELECT /*+ BROADCAST(t) */ * FROM t",
    "SELECT * FROM some_table_function(TABLE(t))", "SELECT aes_decrypt(a, b) FROM t", "SELECT from_protobuf(a, 'm', '/x') FROM t", "SELECT xpath(a, '/x') FROM t",
    "WITH q AS (SELECT * FROM text.`/x`) SELECT 1", "SELECT * FROM (VALUES (reflect('a', 'b'))) v(a)", "EXPLAIN SELECT 1", "SHOW TABLES", "VALUES (1)", "",
    "SELECT system.builtin.reflect('a', 'b')", "SELECT unknown_function(1)", "SELECT session_user", "SELECT * FROM t PIVOT (max(reflect('a', 'b')) FOR c IN (1))"])
def test_refused(sql):
    with pytest.raises(PackError):
        single_select(sql)


@pytest.mark.parametrize("sql", [
    "SELECT 'insert into x' AS a, \"reflect(\" AS b FROM orders -- delete from orders", "WITH q AS (SELECT 1 AS a) SELECT * FROM q JOIN r USING (a)",
    "SELECT o.text FROM orders o WHERE o.note = 'text.`/x`'", "SELECT a FROM s INTERSECT SELECT a FROM t", "SELECT a FROM s EXCEPT ALL SELECT a FROM t MINUS SELECT 1",
    "WITH RECURSIVE q(a) AS (SELECT 1 UNION ALL SELECT a + 1 FROM q WHERE a < 9) SELECT * FROM q",
    "SELECT a + 1 AS b, count(*) FILTER (WHERE x > 1), sum(DISTINCT b) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS w FROM t "
    "WHERE a BETWEEN 1 AND 2 AND b LIKE 'x%' OR c NOT IN (1, 2) AND d IN (SELECT 1) AND NOT EXISTS (SELECT 1 FROM u) GROUP BY ALL HAVING count(*) > 1 ORDER BY 1 LIMIT 3 OFFSET 2",
    "SELECT transform(a, x -> x + 1), filter(a, (x, i) -> x > i), CAST(a AS INT), a::string, CASE WHEN a THEN b ELSE c END, DATE '2020-01-01', INTERVAL 1 DAY, a.b, a[1], "
    "struct(1), extract(YEAR FROM d), current_date, x IS NULL, -a, a || b, a DIV b, a % b, ~a, a & b, try_cast(a AS INT), trim(BOTH 'x' FROM y), substring(a FROM 1 FOR 2), "
    "position('a' IN b), a <=> b, a IS TRUE, a IS DISTINCT FROM b, a ILIKE 'b', a LIKE ANY ('a', 'b'), a NOT RLIKE 'x', timestampdiff(DAY, a, b), first(a) IGNORE NULLS, "
    "percentile_cont(0.5) WITHIN GROUP (ORDER BY a), map('a', 1)['a'], t.* FROM t GROUP BY CUBE (a, b)",
    "SELECT DISTINCT a, rank() OVER w FROM t WINDOW w AS (PARTITION BY a)", "SELECT * FROM t LATERAL VIEW posexplode(a) x AS y, z", "SELECT * FROM range(10)",
    "SELECT * FROM (VALUES (1, 2), (3, 4)) AS v(a, b)", "SELECT * FROM t PIVOT (sum(a) FOR b IN (1, 2))", "SELECT * FROM t UNPIVOT (a FOR b IN (c, d))",
    "SELECT a, grouping(a) FROM t GROUP BY GROUPING SETS ((a), (b)) SORT BY a", "SELECT * EXCEPT (a) FROM t NATURAL JOIN u", "SELECT * FROM t LEFT JOIN LATERAL (SELECT t.a) ON true",
    "SELECT fold(a), search_form(b) FROM t", "SELECT t.*, (SELECT max(a) FROM u WHERE u.b = t.b) FROM t TABLESAMPLE (10 PERCENT)"])
def test_allowed(sql):
    assert single_select(sql + " ;") == sql


def test_only_named_relations_are_read():
    assert admit("SELECT * FROM Orders o, q JOIN r", ["orders", "Q", "r"]).relations == {"Orders", "q", "r"}
    with pytest.raises(UnknownRelation) as e:
        admit("SELECT * FROM orders JOIN secret", ["orders"])
    assert e.value.name == "secret"
    assert admit("WITH s AS (SELECT 1), t AS (SELECT * FROM s) SELECT * FROM t", []).relations == frozenset()
    for sql in ("WITH t AS (SELECT * FROM s), s AS (SELECT 1) SELECT * FROM t", "WITH s AS (SELECT * FROM s) SELECT * FROM s",
                "SELECT * FROM s, (WITH s AS (SELECT 1) SELECT * FROM s)"):
        with pytest.raises(UnknownRelation):
            admit(sql, [])
    assert resolve_tables("SELECT count(*) FROM {{table:a/orders}} JOIN lines", {"a/orders": "a__orders", "b/lines": "b__lines"}).startswith("SELECT count(*) FROM `a__orders`")
    with pytest.raises(PackError):
        resolve_tables("SELECT * FROM {{table:a/orders}}, other", {"a/orders": "a__orders"})


def test_views_refuse_files_code_and_other_relations(spark, tmp_path):
    (tmp_path / "secret.txt").write_text("secret")
    spark.range(3).createOrReplaceTempView("not_registered")
    views = Views(TableSet(spark, [Table("things", spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), "id"),
                                   *[Table("twice", spark.range(2).toDF("id"), "id", source=s) for s in ("x", "y")]]))
    file = f"`{tmp_path}/secret.txt`"
    for sql in (f"SELECT * FROM (text.{file})", f"SELECT * FROM IDENTIFIER('text.{file}')", f"SELECT name FROM things UNION ALL TABLE text.{file}",
                "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.name')", "SELECT * FROM not_registered"):
        with pytest.raises(SqlRefused):
            views.sql(sql)
    assert [r.name for r in views.sql("SELECT name FROM things EXCEPT SELECT 'a'").collect()] == ["b"]
    assert views.sql("SELECT * FROM x__twice INTERSECT ALL SELECT * FROM Y__twice").count() == 2
    with pytest.raises(ValueError, match="several sources: write"):
        views.sql("SELECT * FROM twice")
    with pytest.raises(ValueError, match="tables to use: things"):
        views.sql("SELECT * FROM thing")
