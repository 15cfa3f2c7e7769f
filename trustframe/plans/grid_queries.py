"""Queries on sheets of cells. The sheets are laid out by Spark from the customers, a hundred to a sheet."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import grid as G, naming as N, regions as R
from ..session import materialize
from ..sources import workbook as W
from .inputs import load


def _cell(row, col, kind, num=None, txt=None, fmt=None):
    none = F.lit(None)
    return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
                    (none if num is None else num).cast("double").alias("num"), (none if txt is None else txt).cast("string").alias("txt"),
                    F.lit(fmt).cast("string").alias("format"), none.cast("string").alias("formula"))


def _spread(df, cells):
    return df.select(F.lit("book").alias("source_id"), "sheet", F.explode(F.array(*cells)).alias("c")).select("source_id", "sheet", "c.*")


def _blocks(spark, sf):
    """Customers with their sheet, dealt by it: a narrow customer table is few files, and so would be the cells."""
    key = F.col("c_custkey")
    named = load(spark, sf, "customer").withColumn("sheet", F.concat(F.lit("block-"), F.floor(key / 100).cast("string")))
    return named.repartition("sheet")


HEADERS = {2: "customer id", 3: "name", 4: "balance (EGP)", 5: "name", 6: "overdrawn", 7: "opened"}


def customer_sheets(spark, sf):
    """A title, a blank row, a header in row 3 and one customer per row, with errors, mixed values, booleans and dates."""
    c = _blocks(spark, sf)
    key, row = F.col("c_custkey"), F.col("c_custkey") % 100 + 4
    balance = F.when(key % 50 == 7, "error").when(key % 33 == 5, "text").otherwise("num")
    body = _spread(c, [
        _cell(row, 2, "num", key), _cell(row, 3, "text", txt=F.col("c_name")),
        _cell(row, 4, balance, F.when(balance == "num", F.col("c_acctbal")),
              F.when(balance == "error", "#N/A").when(balance == "text", "n/a")),
        _cell(row, 5, "text", txt=F.col("c_mktsegment")), _cell(row, 6, "bool", (F.col("c_acctbal") < 0).cast("int")),
        _cell(row, 7, "date", 45000 + key % 365, fmt="yyyy-mm-dd"), _cell(row, 8, "num", F.col("c_nationkey"))])
    top = c.select("sheet").distinct()
    head = _spread(top, [_cell(F.lit(1), 2, "text", txt=F.lit("Customers by block"))]
                   + [_cell(F.lit(3), col, "text", txt=F.lit(h)) for col, h in HEADERS.items()])
    return materialize(body.unionByName(head), "cells")


BLOCKS = "(SELECT *, 'block-' || (c_custkey // 100) AS sheet FROM customer)"


def _sheets(spark, sf):
    b = G.build(customer_sheets(spark, sf))
    return b.sheets.select("sheet", *[F.col(c).cast("long").alias(c) for c in ("first_row", "last_row", "first_col", "last_col", "header_row", "data_rows",
                                                                                "blank_rows")], "header_confidence")


SHEETS_SQL = f"""SELECT sheet, CAST(1 AS BIGINT) AS first_row, max(c_custkey % 100 + 4) AS last_row, CAST(2 AS BIGINT) AS first_col, CAST(8 AS BIGINT) AS last_col,
  CAST(3 AS BIGINT) AS header_row, count(*) AS data_rows, CAST(0 AS BIGINT) AS blank_rows, round(0.4 * 6 / 7 + 0.3 + 0.2 * 5 / 6 + 0.1, 3) AS header_confidence
  FROM {BLOCKS} GROUP BY sheet"""


def _columns(spark, sf):
    b = G.build(customer_sheets(spark, sf))
    return b.columns.select("sheet", F.col("position").cast("long").alias("position"), "name", "header", "column_kind", "date_kind", "non_null", "error_cells")


def _columns_sql():
    bal = ("CASE WHEN bool_or(c_custkey % 33 = 5 AND c_custkey % 50 <> 7) AND bool_or(c_custkey % 50 <> 7 AND c_custkey % 33 <> 5) THEN 'mixed' "
           "WHEN bool_or(c_custkey % 33 = 5 AND c_custkey % 50 <> 7) THEN 'text' WHEN bool_and(c_acctbal = floor(c_acctbal)) THEN 'int' ELSE 'real' END")
    errors = "count(*) FILTER (c_custkey % 50 = 7)"
    rows = [(1, "'customer_id'", "'customer id'", "'int'", "NULL"), (2, "'name'", "'name'", "'text'", "NULL"),
            (3, "'balance_EGP'", "'balance (EGP)'", bal, "NULL"), (4, "'name_2'", "'name'", "'text'", "NULL"),
            (5, "'overdrawn'", "'overdrawn'", "'bool'", "NULL"), (6, "'opened'", "'opened'", "'date'", "'date'"), (7, "'col_7'", "NULL", "'int'", "NULL")]
    return " UNION ALL ".join(
        f"SELECT sheet, CAST({p} AS BIGINT) AS position, {n} AS name, {h} AS header, {k} AS column_kind, {d} AS date_kind, "
        f"count(*) - {errors if p == 3 else 0} AS non_null, {errors if p == 3 else 'CAST(0 AS BIGINT)'} AS error_cells FROM {BLOCKS} GROUP BY sheet"
        for p, n, h, k, d in rows)


def _values(spark, sf):
    return G.build(customer_sheets(spark, sf)).values.select("sheet", F.col("row").cast("long").alias("row"), "name", "num", "txt")


VALUES_SQL = f"""WITH b AS {BLOCKS} SELECT sheet, c_custkey % 100 + 4 AS row, 'customer_id' AS name, CAST(c_custkey AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt FROM b
UNION ALL SELECT sheet, c_custkey % 100 + 4, 'name', NULL, c_name FROM b
UNION ALL SELECT sheet, c_custkey % 100 + 4, 'balance_EGP', CASE WHEN c_custkey % 33 <> 5 THEN c_acctbal END, CASE WHEN c_custkey % 33 = 5 THEN 'n/a' END FROM b WHERE c_custkey % 50 <> 7
UNION ALL SELECT sheet, c_custkey % 100 + 4, 'name_2', NULL, c_mktsegment FROM b
UNION ALL SELECT sheet, c_custkey % 100 + 4, 'overdrawn', CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END, NULL FROM b
UNION ALL SELECT sheet, c_custkey % 100 + 4, 'opened', NULL, strftime(DATE '1899-12-30' + CAST(45000 + c_custkey % 365 AS INT), '%Y-%m-%d') FROM b
UNION ALL SELECT sheet, c_custkey % 100 + 4, 'col_7', CAST(c_nationkey AS DOUBLE), NULL FROM b"""


def _errors(spark, sf):
    b = G.build(customer_sheets(spark, sf))
    found = b.errors.select("sheet", F.col("row").cast("long").alias("row"), F.col("error").alias("text"), F.lit("error").alias("what"))
    kept = b.preamble.select("sheet", F.col("row").cast("long").alias("row"), "text", F.lit("preamble").alias("what"))
    return found.unionByName(kept)


ERRORS_SQL = f"""SELECT sheet, c_custkey % 100 + 4 AS row, '#N/A' AS text, 'error' AS what FROM {BLOCKS} WHERE c_custkey % 50 = 7
UNION ALL SELECT DISTINCT sheet, 1, 'Customers by block', 'preamble' FROM {BLOCKS}"""


def _verify(spark, sf):
    cells = customer_sheets(spark, sf)
    return G.verify(cells, G.build(cells)).groupBy("check", "ok").agg(F.count(F.lit(1)).alias("checks"))


def _verify_sql():
    bal = "bool_or(c_custkey % 50 <> 7 AND c_custkey % 33 <> 5)"
    return (f"WITH s AS (SELECT sheet, CASE WHEN {bal} THEN 3 ELSE 2 END AS sums FROM {BLOCKS} GROUP BY sheet) "
            "SELECT 'counta' AS \"check\", true AS ok, 7 * count(*) AS checks FROM s UNION ALL SELECT 'sum', true, CAST(sum(sums) AS BIGINT) FROM s "
            "UNION ALL SELECT 'cells_total', true, count(*) FROM s")


def region_sheets(spark, sf):
    """Three tables on each sheet: customers, a small one beside them, and another after a gap."""
    c = _blocks(spark, sf)
    row = F.col("c_custkey") % 100 + 2
    body = _spread(c, [_cell(row, 1, "num", F.col("c_custkey")), _cell(row, 2, "num", F.col("c_acctbal"))])
    texts = [(1, 1, "id"), (1, 2, "balance"), (1, 5, "code"), (1, 6, "desc"), (2, 5, "x"), (2, 6, "one"), (3, 5, "y"), (3, 6, "two"),
             (110, 1, "region"), (110, 2, "total"), (111, 1, "east"), (112, 1, "west")]
    fixed = [_cell(F.lit(r), col, "text", txt=F.lit(t)) for r, col, t in texts]
    fixed += [_cell(F.lit(r), 2, "num", F.lit(r * 10)) for r in (111, 112)]
    return materialize(body.unionByName(_spread(c.select("sheet").distinct(), fixed)), "cells")


def _regions(spark, sf):
    r = R.regions(region_sheets(spark, sf))
    return r.select("sheet", "kind", *[F.col(c).cast("long").alias(c) for c in ("region_no", "first_row", "first_col", "last_row", "last_col", "header_row", "cells")])


REGIONS_SQL = f"""SELECT sheet, 'table' AS kind, CAST(1 AS BIGINT) AS region_no, CAST(1 AS BIGINT) AS first_row, CAST(1 AS BIGINT) AS first_col, max(c_custkey % 100 + 2) AS last_row,
  CAST(2 AS BIGINT) AS last_col, CAST(1 AS BIGINT) AS header_row, 2 * count(*) + 2 AS cells FROM {BLOCKS} GROUP BY sheet
UNION ALL SELECT DISTINCT sheet, 'table', 2, 1, 5, 3, 6, 1, 6 FROM {BLOCKS} UNION ALL SELECT DISTINCT sheet, 'table', 3, 110, 1, 112, 2, 110, 6 FROM {BLOCKS}"""


def _region_cells(spark, sf):
    cells = region_sheets(spark, sf)
    found = R.region_cells(cells, materialize(R.regions(cells), "regions"))
    return found.groupBy("sheet", F.col("region_no").cast("long").alias("region_no"), "name").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("num"), 2).alias("total"), F.min("txt").alias("least"))


REGION_CELLS_SQL = f"""SELECT sheet, CAST(1 AS BIGINT) AS region_no, 'id' AS name, count(*) AS cells, CAST(sum(c_custkey) AS DOUBLE) AS total, NULL AS least FROM {BLOCKS} GROUP BY sheet
UNION ALL SELECT sheet, 1, 'balance', count(*), round(sum(c_acctbal), 2), NULL FROM {BLOCKS} GROUP BY sheet
UNION ALL SELECT DISTINCT sheet, 2, 'code', 2, NULL, 'x' FROM {BLOCKS} UNION ALL SELECT DISTINCT sheet, 2, 'desc', 2, NULL, 'one' FROM {BLOCKS}
UNION ALL SELECT DISTINCT sheet, 3, 'region', 2, NULL, 'east' FROM {BLOCKS} UNION ALL SELECT DISTINCT sheet, 3, 'total', 2, 2230.0, NULL FROM {BLOCKS}"""


def _header_groups(spark, sf):
    """Quarter labels over plan and actual columns, one sheet per hundred customers."""
    c = _blocks(spark, sf)
    key, row = F.col("c_custkey"), F.col("c_custkey") % 100 + 3
    body = _spread(c, [_cell(row, 1, "text", txt=F.col("c_name"))] + [_cell(row, col, "num", key * col) for col in range(2, 6)])
    labels = [(1, 2, "Q1"), (1, 4, "Q2"), (2, 1, "item"), (2, 2, "Plan"), (2, 3, "Actual"), (2, 4, "Plan"), (2, 5, "Actual")]
    cells = body.unionByName(_spread(c.select("sheet").distinct(), [_cell(F.lit(r), col, "text", txt=F.lit(t)) for r, col, t in labels]))
    cells = materialize(cells, "cells")
    g = G.header_groups(cells, materialize(G.sheets(cells), "sheets"))
    return g.select("sheet", F.col("col").cast("long").alias("col"), F.array_join("path", "/").alias("path"), "method")


HEADER_GROUPS_SQL = f"""SELECT DISTINCT sheet, CAST(c AS BIGINT) AS col, p AS path, 'label_run' AS method FROM {BLOCKS},
  (VALUES (2, 'Q1'), (3, 'Q1'), (4, 'Q2'), (5, 'Q2')) v(c, p)"""


# ---- spreadsheet files ------------------------------------------------------------------------------------------
def make_workbook(rows: list[list], sheet: str = "Customers", merges: list[str] = (), date1904: bool = False) -> bytes:
    """A small spreadsheet file: texts inline, numbers, booleans, dates as (serial,) tuples, formulas as '=...' texts."""
    def cell(r, c, v):
        ref = f"{chr(64 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
        if isinstance(v, str) and v.startswith("="):
            return f'<c r="{ref}"><f>{v[1:]}</f><v>0</v></c>'
        if isinstance(v, str) and v.startswith("#"):
            return f'<c r="{ref}" t="e"><v>{v}</v></c>'
        if isinstance(v, str):
            return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        return f'<c r="{ref}"><v>{v!r}</v></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
    merged = f'<mergeCells>{"".join(f"<mergeCell ref={chr(34)}{m}{chr(34)}/>" for m in merges)}</mergeCells>' if merges else ""
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                           f'<workbookPr date1904="{int(date1904)}"/><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                      '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData>{body}</sheetData>{merged}</worksheet>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def customer_workbooks(spark, sf):
    """One spreadsheet file per hundred customers (source_id, content)."""
    def write(block: pd.DataFrame) -> pd.DataFrame:
        rows = [["customer_id", "name", "balance", "opened"]]
        for r in block.sort_values("c_custkey").itertuples():
            rows.append([int(r.c_custkey), r.c_name, float(r.c_acctbal), (45000 + int(r.c_custkey) % 365,)])
        return pd.DataFrame({"source_id": [block["sheet"].iloc[0]], "content": [make_workbook(rows)]})

    blocks = _blocks(spark, sf).select("sheet", "c_custkey", "c_name", "c_acctbal")
    return blocks.groupBy("sheet").applyInPandas(write, "source_id string, content binary")


def _workbooks(spark, sf):
    built = G.build(materialize(W.cells(W.workbook_parts(customer_workbooks(spark, sf))), "cells"))
    return built.values.select("source_id", "sheet", F.col("row").cast("long").alias("row"), "name", "column_kind", "num", "txt")


WORKBOOKS_SQL = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY c_custkey) + 1 AS row FROM {BLOCKS}),
k AS (SELECT sheet, CASE WHEN bool_and(c_acctbal = floor(c_acctbal)) THEN 'int' ELSE 'real' END AS kind FROM b GROUP BY sheet)
SELECT sheet AS source_id, 'Customers' AS sheet, row, 'customer_id' AS name, 'int' AS column_kind, CAST(c_custkey AS DOUBLE) AS num, NULL AS txt FROM b
UNION ALL SELECT sheet, 'Customers', row, 'name', 'text', NULL, c_name FROM b
UNION ALL SELECT b.sheet, 'Customers', row, 'balance', kind, c_acctbal, NULL FROM b JOIN k ON b.sheet = k.sheet
UNION ALL SELECT sheet, 'Customers', row, 'opened', 'date', NULL, strftime(DATE '1899-12-30' + CAST(45000 + c_custkey % 365 AS INT), '%Y-%m-%d') FROM b"""

WIDE = 17


def _large_sheet(spark, sf):
    """One sheet with every order line, a row apart for each line number, and the orders beside them: bands, blocks and boxes."""
    lines, orders = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    at = 2 + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    values = [F.pmod(F.col("l_partkey") * (i + 1) + F.col("l_orderkey"), F.lit(97 + i)).cast("double") for i in range(WIDE)]
    left = lines.select(at.cast("int").alias("row"), F.posexplode(F.array(*values)).alias("pos", "num"))
    none = F.lit(None).cast("string")
    one = left.select(F.lit("book").alias("source_id"), F.lit("all").alias("sheet"), "row", (F.col("pos") + 1).alias("col"), F.lit("num").alias("kind"), "num",
                      none.alias("txt"), none.alias("format"), none.alias("formula"))
    row = 3 + F.col("o_orderkey") * 8
    two = orders.select(F.lit("book").alias("source_id"), F.lit("all").alias("sheet"), F.explode(F.array(
        _cell(row, 20, "num", num=F.col("o_orderkey")), _cell(row, 21, "text", txt=F.col("o_orderpriority")), _cell(row, 22, "num", num=F.col("o_totalprice")))).alias("c")).select("source_id", "sheet", "c.*")
    names = [(i + 1, f"measure {i}") for i in range(WIDE)] + [(20, "order"), (21, "priority"), (22, "price")]
    head = spark.range(1).select(F.lit("book").alias("source_id"), F.lit("all").alias("sheet"),
                                 F.explode(F.array(*[_cell(F.lit(2), c, "text", txt=F.lit(n)) for c, n in names])).alias("c")).select("source_id", "sheet", "c.*")
    cells = one.unionByName(two).unionByName(head)                  # laid out faster than read back, and read twice
    return R.regions(cells).select("sheet", "kind", *[F.col(c).cast("long").alias(c) for c in ("region_no", "first_row", "first_col", "last_row", "last_col", "header_row", "cells")])


LARGE_SHEET_SQL = f"""SELECT 'all' AS sheet, 'table' AS kind, 1 AS region_no, 2 AS first_row, 1 AS first_col, max(2 + l_orderkey * 8 + l_linenumber) AS last_row, {WIDE} AS last_col,
  2 AS header_row, {WIDE} * (count(*) + 1) AS cells FROM lineitem
UNION ALL SELECT 'all', 'table', 2, 2, 20, max(3 + o_orderkey * 8), 22, 2, 3 * (count(*) + 1) FROM orders"""


def _unique_columns(spark, sf):
    """Every word of every document as a header of its own column: blanks are numbered, repeats get a number behind."""
    words = load(spark, sf, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+|[-]+"), F.lit(0))).alias("col", "header"))
    named = N.unique_names(words, ["doc_id"], "the")
    return named.select("doc_id", F.col("position").cast("long").alias("position"), "name", "header")


UNIQUE_COLUMNS_SQL = """WITH w AS (SELECT doc_id, unnest(h) AS header, generate_subscripts(h, 1) AS position FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[-]+') AS h FROM documents)),
b AS (SELECT *, CASE WHEN header[1] = '-' THEN 'col_' || position ELSE header END AS base FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(base) ORDER BY position) + CASE WHEN lower(base) = 'the' THEN 1 ELSE 0 END AS k FROM b)
SELECT doc_id, position, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name, header FROM n"""


def _unique_tables(spark, sf):
    """Table names for sheets that are called like parts: size first for the smaller ones, one store per brand."""
    sheet = F.when(F.col("p_size") < 25, F.concat_ws(" ", "p_size", "p_type")).otherwise(F.concat(F.lit("  "), F.col("p_type"), F.lit("!")))
    sheets = load(spark, sf, "part").select("p_brand", "p_partkey", sheet.alias("sheet"))
    return N.unique_tables(sheets, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "sheet", "table_name")


UNIQUE_TABLES_SQL = """WITH s AS (SELECT p_brand, p_partkey, CASE WHEN p_size < 25 THEN p_size || ' ' || p_type ELSE '  ' || p_type || '!' END AS sheet,
  CASE WHEN p_size < 25 THEN 't_' || p_size || '_' ELSE '' END || replace(p_type, ' ', '_') AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(base) ORDER BY p_partkey) AS k FROM s)
SELECT p_brand, p_partkey, sheet, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS table_name FROM n"""


QUERIES = {
    "grid_large_sheet": _large_sheet, "unique_columns_documents": _unique_columns, "unique_tables_parts": _unique_tables,
    "grid_sheets": _sheets, "grid_columns": _columns, "grid_values": _values, "grid_errors": _errors, "grid_verify": _verify,
    "grid_regions": _regions, "grid_region_cells": _region_cells, "grid_header_groups": _header_groups, "workbook_scan": _workbooks,
}
ORACLE = {
    "grid_large_sheet": LARGE_SHEET_SQL, "unique_columns_documents": UNIQUE_COLUMNS_SQL, "unique_tables_parts": UNIQUE_TABLES_SQL,
    "grid_sheets": SHEETS_SQL, "grid_columns": _columns_sql(), "grid_values": VALUES_SQL, "grid_errors": ERRORS_SQL, "grid_verify": _verify_sql(),
    "grid_regions": REGIONS_SQL, "grid_region_cells": REGION_CELLS_SQL, "grid_header_groups": HEADER_GROUPS_SQL, "workbook_scan": WORKBOOKS_SQL,
}
