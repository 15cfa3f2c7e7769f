"""Tables rebuilt from a long table of sheet cells: extents, headers, names, types, values and their verification.

A cell is (source_id, sheet, row, col, kind, num, txt, format, formula) with kind num, text, bool, date or error. All
work is on this long form: one aggregate per sheet, row or column, however many sheets there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.dates import clock, format_class, serial_to_iso
from ..functions.names import clean_header
from ..functions.numbers import plain_number
from ..session import materialize
from .naming import unique_names

CELL = ("source_id string, sheet string, row int, col int, kind string, num double, txt string, format string, formula string")
S = ["source_id", "sheet"]
WIDTH_ROWS = 200
RESERVED = "_row_id"


def present(cells: DataFrame) -> DataFrame:
    """Cells that hold a value (error cells do not)."""
    return cells.filter("kind <> 'error' AND (kind <> 'text' OR txt <> '')")


def extents(cells: DataFrame) -> DataFrame:
    """First and last row and column that hold anything; styled but empty cells are not in the cell table."""
    held = cells.filter("kind <> 'text' OR txt <> ''")
    return held.groupBy(*S).agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"),
                                F.max("col").alias("last_col"))


def row_shape(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, filled, texts, distinct_texts): what the header test looks at."""
    text = F.when(F.col("kind") == "text", F.lower(F.trim("txt")))
    return cells.groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("filled"), F.count(text).alias("texts"),
                                           F.count_distinct(text).alias("distinct_texts"))


def header_like(width: Column) -> Column:
    """At least 60% filled, 80% of that text, half of the texts different."""
    filled, texts = F.col("filled"), F.col("texts")
    return ((filled >= F.greatest(F.lit(1.0), 0.6 * width)) & (texts >= 0.8 * filled) & (F.col("distinct_texts") >= 0.5 * texts))


def find_headers(cells: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header_row): first header-like row of the first thirty with data right below. boxes(keys, first_row, width).

    Only the head of each box is looked at, so the shuffle holds thirty rows per sheet or region.
    """
    head = cells.join(boxes.select(*keys, "first_row", "width"), keys).filter(F.col("row") <= F.col("first_row") + V.HEADER_SCAN_ROWS)
    return first_headers(row_shape(head, [*keys, "first_row", "width"]), keys)


def first_headers(shape: DataFrame, keys: list[str]) -> DataFrame:
    """The same from the shapes of the head rows, which carry `first_row` and `width` of their box."""
    below = shape.select(*keys, (F.col("row") - 1).alias("row")).distinct()
    good = shape.filter(header_like(F.col("width")) & (F.col("row") < F.col("first_row") + V.HEADER_SCAN_ROWS))
    return good.join(below, [*keys, "row"], "left_semi").groupBy(*keys).agg(F.min("row").alias("header_row"))


def sheets(cells: DataFrame) -> DataFrame:
    """One row per sheet: extent, header row, its confidence with reasons, first data row."""
    ext = extents(cells)
    here = present(cells)
    top = here.join(ext.select(*S, "first_row"), S).filter(F.col("row") < F.col("first_row") + WIDTH_ROWS)
    width = top.groupBy(*S).agg(F.count_distinct("col").alias("width"))
    boxes = materialize(ext.join(width, S, "left").fillna(0, ["width"]), "boxes")
    found = materialize(boxes.join(find_headers(here, boxes, S), S, "left"), "headers")
    at = found.select(*S, F.col("header_row").alias("row"), "first_row", "width", "header_row")
    shape = row_shape(here.join(at.select(*S, "row"), [*S, "row"], "left_semi"), S)
    below = here.join(found.select(*S, (F.col("header_row") + 1).alias("row")), [*S, "row"], "left_semi").select(*S).distinct()
    rows = found.join(shape.drop("row"), S, "left").join(below.withColumn("has_next", F.lit(True)), S, "left").fillna(False, ["has_next"])
    filled = F.try_divide(F.col("filled"), F.greatest(F.lit(1), "width"))
    texts = F.try_divide(F.col("texts"), F.greatest(F.lit(1), "filled"))
    unique = F.coalesce(F.try_divide(F.col("distinct_texts"), F.greatest(F.lit(1), "texts")), F.lit(0.0))
    score = 0.4 * F.least(F.lit(1.0), filled) + 0.3 * texts + 0.2 * unique + F.when(F.col("has_next"), 0.1).otherwise(0.0)
    none = F.col("header_row").isNull()
    above = F.col("header_row") - F.col("first_row")
    reasons = F.when(none, F.array(F.lit("no header row found; columns were named generically"))).otherwise(F.array_compact(F.array(
        F.format_string("%d/%d columns have a header value", "filled", "width"),
        F.format_string("%d/%d header values are text", "texts", "filled"),
        F.when(unique < 1, "some header labels repeat"),
        F.when(~F.col("has_next"), "no data row follows the header"),
        F.when(above > 0, F.format_string("%d row(s) above the header kept as preamble", above)))))
    return rows.select(*S, "first_row", "last_row", "first_col", "last_col", "width", "header_row",
                       F.when(none, 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 3)).alias("header_confidence"),
                       reasons.alias("header_reasons"),
                       F.when(none, F.col("first_row")).otherwise(F.col("header_row") + 1).alias("data_first"))


def shown_text(kind: Column, num: Column, txt: Column, fmt: Column) -> Column:
    """A header or preamble cell as people see it: dates in ISO form, whole numbers without a fraction."""
    return (F.when(kind == "text", txt).when(kind == "date", date_text(num, fmt))
            .when(kind == "bool", F.when(num == 1, "TRUE").otherwise("FALSE")).otherwise(plain_number(num)))


def date_text(num: Column, fmt: Column) -> Column:
    """ISO text of a date cell: time only for time formats, no time part at midnight."""
    whole = num == F.floor(num)
    return F.when(format_class(fmt) == "time", clock(F.rint(num * 86400))).when(
        whole, serial_to_iso(num, F.lit("date"), F.lit(False))).otherwise(serial_to_iso(num, F.lit("datetime"), F.lit(False)))


@dataclass
class Built:
    """The parts of rebuilt tables, all keyed by (source_id, sheet)."""

    sheets: DataFrame
    columns: DataFrame
    values: DataFrame
    errors: DataFrame
    preamble: DataFrame


def column_types(body: DataFrame) -> DataFrame:
    """Per column: which kinds occur, whole numbers only, dates, errors. A format is read once per column and kind, not per cell."""
    kind, num, n = F.col("kind"), F.col("num"), F.col("n")
    numeric = kind.isin("num", "date")
    alike = body.groupBy(*S, "col", "kind", "format").agg(
        F.bool_and(F.when(numeric, (num == F.floor(num)) & (F.abs(num) < V.MAX_EXACT_INTEGER))).alias("whole"),
        F.bool_or(num != F.floor(num)).alias("fraction"), F.count(F.lit(1)).alias("n"))
    fmt = format_class(F.col("format"))
    timed = (kind == "date") & ((fmt == "time") | F.col("fraction"))

    def cells_where(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    stats = alike.groupBy(*S, "col").agg(
        F.bool_or(numeric).alias("has_num"), F.bool_or(kind == "text").alias("has_text"), F.bool_or(kind == "bool").alias("has_bool"),
        F.bool_and("whole").alias("all_int"), cells_where(kind == "date").alias("dates"), F.bool_or(timed).alias("has_time"),
        F.bool_and(F.when(kind == "date", fmt == "time")).alias("all_time"),
        cells_where(kind == "error").alias("error_cells"), cells_where(kind != "error").alias("non_null"))
    n, t, b = F.col("has_num"), F.col("has_text"), F.col("has_bool")
    decided = (F.when(F.col("dates") > 0, "date").when(n & ~t & ~b, F.when(F.col("all_int"), "int").otherwise("real"))
               .when(t & ~n & ~b, "text").when(b & ~n & ~t, "bool").when(n | t | b, "mixed").otherwise("text"))
    date_kind = F.when(F.col("dates") > 0, F.when(F.col("all_time"), "time").when(F.col("has_time"), "datetime").otherwise("date"))
    return stats.select(*S, "col", decided.alias("column_kind"), date_kind.alias("date_kind"), "non_null", "error_cells")


def build(cells: DataFrame) -> Built:
    """Rebuild one table per sheet. Nothing is dropped: preamble and error cells are kept beside the values.

    `cells` is read several times: hand over a stored cell table. Sheets and columns are small and are written once.
    """
    cells = cells.filter("kind <> 'text' OR txt <> ''")
    sheet_rows = materialize(sheets(cells), "sheets")
    placed = cells.join(sheet_rows.select(*S, "header_row", "data_first"), S)
    body = placed.filter(F.col("row") >= F.col("data_first")).drop("header_row", "data_first")
    shown = shown_text(F.col("kind"), F.col("num"), F.col("txt"), F.col("format"))
    # written apart: a test of the cleaned header would be pushed below the join and clean every cell
    heads = materialize(placed.filter("row = header_row AND kind <> 'error'").select(*S, "col", shown.alias("header")), "heads")
    types = column_types(body)
    named = heads.filter(clean_header(F.col("header")) != "")
    kept = types.join(heads, [*S, "col"], "left").unionByName(
        named.join(types, [*S, "col"], "left_anti").select(
            *S, "col", F.lit("text").alias("column_kind"), F.lit(None).cast("string").alias("date_kind"),
            F.lit(0).cast("long").alias("non_null"), F.lit(0).cast("long").alias("error_cells"), "header"))
    kept = materialize(kept, "column-types")
    columns = unique_names(kept.select(*S, "col", "header"), S, RESERVED).join(kept.drop("header"), [*S, "col"])
    columns = materialize(columns, "columns")

    kind, num, txt, ck = F.col("kind"), F.col("num"), F.col("txt"), F.col("column_kind")
    truth = F.when(num == 1, "TRUE").otherwise("FALSE")
    out_num = (F.when(ck.isin("int", "real", "mixed") & kind.isin("num", "date"), num).when((ck == "bool") & (kind == "bool"), num))
    out_txt = (F.when(kind == "text", txt).when((kind == "bool") & (ck != "bool"), truth)
               .when((ck == "date") & (kind == "date"), date_text(num, F.col("format")))
               .when((ck == "date") & (kind == "num"), plain_number(num)))
    values = body.filter("kind <> 'error'").join(columns.select(*S, "col", "name", "column_kind"), [*S, "col"]).select(
        *S, "row", "col", "name", "column_kind", out_num.alias("num"), out_txt.alias("txt"))
    errors = body.filter("kind = 'error'").select(*S, "row", "col", F.col("txt").alias("error"))
    preamble = placed.filter("header_row IS NOT NULL AND row < header_row").select(*S, "row", "col", shown.alias("text"))
    used = body.select(*S, "row").distinct().groupBy(*S).agg(F.count(F.lit(1)).alias("data_rows"))
    sheet_rows = sheet_rows.join(used, S, "left").fillna(0, ["data_rows"]).withColumn(
        "blank_rows", F.col("last_row") - F.col("data_first") + 1 - F.col("data_rows"))
    return Built(sheet_rows, columns, values, errors, preamble)


def verify(cells: DataFrame, built: Built) -> DataFrame:
    """(source_id, sheet, name, check, read, stored, ok): counts and sums per column, and every cell of the sheet."""
    held = cells.filter("kind <> 'text' OR txt <> ''")
    body = held.join(built.sheets.select(*S, "data_first"), S).filter("row >= data_first")
    read = body.groupBy(*S, "col").agg(F.count(F.lit(1)).cast("double").alias("read_n"),
                                       F.coalesce(F.sum(F.when(F.col("kind").isin("num", "date"), F.col("num"))), F.lit(0.0)).alias("read_sum"))
    numeric = F.col("column_kind").isin("int", "real", "mixed")
    kept = built.values.groupBy(*S, "col").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(numeric, F.col("num"))), F.lit(0.0)).alias("stored_sum"),
        F.coalesce(F.sum(F.when(numeric, F.abs("num"))), F.lit(0.0)).alias("magnitude"))
    errors = built.errors.groupBy(*S, "col").agg(F.count(F.lit(1)).alias("e"))
    both = (built.columns.select(*S, "col", "name", "column_kind").join(read, [*S, "col"], "left").join(kept, [*S, "col"], "left")
            .join(errors, [*S, "col"], "left").fillna(0, ["read_n", "read_sum", "n", "stored_sum", "magnitude", "e"]))
    both = both.withColumn("stored_n", (F.col("n") + F.col("e")).cast("double"))
    counts = both.select(*S, "name", F.lit("counta").alias("check"), F.col("read_n").alias("read"), F.col("stored_n").alias("stored"),
                         (F.col("read_n") == F.col("stored_n")).alias("ok"))
    room = 1e-9 * F.greatest(F.abs("read_sum"), F.abs("stored_sum"), "magnitude", F.lit(1.0))
    sums = both.filter(numeric).select(*S, "name", F.lit("sum").alias("check"), F.col("read_sum").alias("read"),
                                       F.col("stored_sum").alias("stored"), (F.abs(F.col("read_sum") - F.col("stored_sum")) <= room).alias("ok"))
    total = held.groupBy(*S).agg(F.count(F.lit(1)).cast("double").alias("read"))
    header = held.join(built.sheets.filter("header_row IS NOT NULL").select(*S, F.col("header_row").alias("row")), [*S, "row"], "left_semi")
    parts = [x.groupBy(*S).agg(F.count(F.lit(1)).alias("k")) for x in (built.values, built.errors, built.preamble, header)]
    stored = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy(*S).agg(F.sum("k").cast("double").alias("stored"))
    whole = total.join(stored, S, "left").fillna(0.0, ["stored"]).select(
        *S, F.lit("(whole sheet)").alias("name"), F.lit("cells_total").alias("check"), "read", "stored", (F.col("read") == F.col("stored")).alias("ok"))
    return counts.unionByName(sums).unionByName(whole)


def formula_cells(cells: DataFrame, built: Built) -> DataFrame:
    """(source_id, sheet, name, formula) of every formula inside the data: the input of lineage."""
    body = cells.filter("formula IS NOT NULL").join(built.sheets.select(*S, "data_first"), S).filter("row >= data_first")
    return body.join(built.columns.select(*S, "col", "name"), [*S, "col"]).select(*S, "name", "formula")


def wide_table(built: Built, source_id: str, sheet: str) -> DataFrame:
    """One rebuilt table as rows and typed columns. The column list is metadata and is read to name them."""
    def mine(df: DataFrame) -> DataFrame:
        return df.filter((F.col("source_id") == source_id) & (F.col("sheet") == sheet))

    cols = mine(built.columns).orderBy("position").select("name", "column_kind").collect()
    values = mine(built.values).groupBy(F.col("row").cast("long").alias(RESERVED)).pivot("name", [c.name for c in cols]).agg(
        F.first(F.struct("num", "txt")))
    types = {"int": "long", "real": "double"}

    def typed(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in types:
            return c["num"].cast(types[kind]).alias(name)
        if kind == "bool":
            return (c["num"] == 1).alias(name)
        return (c if kind == "mixed" else c["txt"]).alias(name)

    return values.select(RESERVED, *[typed(c.name, c.column_kind) for c in cols])


def header_groups(cells: DataFrame, sheet_rows: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(source_id, sheet, col, path, method) for grouped headers: up to three label rows right above the header.

    merged(source_id, sheet, row1, col1, row2, col2). A label spans its merged area, or runs to the next label when its
    row has several. A row counts only if it has fewer labels than the header has names and some label spans two names;
    the first row that does not ends the search upwards.
    """
    here = present(cells).filter("kind <> 'text' OR trim(txt) <> ''")
    at = sheet_rows.filter("header_row IS NOT NULL").select(*S, "header_row")
    near = here.join(at, S).withColumn("level", F.col("header_row") - F.col("row")).filter(F.col("level").between(0, V.GROUP_LEVELS))
    named = near.filter("level = 0").select(*S, "col")
    header = named.groupBy(*S).agg(F.count(F.lit(1)).alias("names"), F.max("col").alias("last_named")).filter("names >= 2")
    text = F.trim(shown_text(F.col("kind"), F.col("num"), F.col("txt"), F.col("format")))
    labels = near.filter("level > 0").select(*S, "level", "row", "col", text.alias("label")).join(header, S)
    by_row = Window.partitionBy(*S, "level")
    labels = labels.withColumn("labels", F.count(F.lit(1)).over(by_row)).withColumn("next_col", F.lead("col").over(by_row.orderBy("col")))
    if merged is not None:
        areas = merged.select(*S, F.col("row1").alias("row"), F.col("col1").alias("col"), F.col("col2").alias("merged_to"))
        labels = labels.join(areas, [*S, "row", "col"], "left")
    else:
        labels = labels.withColumn("merged_to", F.lit(None).cast("int"))
    run_to = F.coalesce(F.col("next_col") - 1, F.col("last_named"))
    span = F.when(F.col("merged_to").isNotNull(), F.col("merged_to")).when(F.col("labels") >= 2, run_to)
    labels = labels.withColumn("to", span).withColumn("method", F.when(F.col("merged_to").isNotNull(), "merged_area").otherwise("label_run"))

    # every header name takes the nearest label at or left of it, if that label reaches this far
    levels = labels.select(*S, "level").distinct()
    spots = named.join(levels, S).select(*S, "level", "col", F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("to"),
                                         F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("from"), F.lit(1).alias("is_name"))
    marks = labels.filter(F.col("to").isNotNull()).select(*S, "level", "col", "label", "to", "method", F.col("col").alias("from"), F.lit(0).alias("is_name"))
    order = Window.partitionBy(*S, "level").orderBy("col", "is_name").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.unionByName(spots)
    for c in ("label", "to", "method", "from"):
        filled = filled.withColumn(f"near_{c}", F.last(c, ignorenulls=True).over(order))
    covered = filled.filter("is_name = 1 AND near_label IS NOT NULL AND col <= near_to").select(
        *S, "level", "col", F.col("near_label").alias("label"), F.col("near_method").alias("method"), F.col("near_from").alias("from"))
    wide = covered.groupBy(*S, "level", "from").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select(*S, "level").distinct()
    few = labels.filter("labels < names").select(*S, "level").distinct()
    good = few.join(wide, [*S, "level"], "left_semi")
    chain = Window.partitionBy(*S).orderBy("level")
    good = good.withColumn("at", F.row_number().over(chain)).filter("at = level").drop("at")
    paths = covered.join(good, [*S, "level"], "left_semi").groupBy(*S, "col").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("l"), "label")))["label"].alias("path"))
    methods = labels.filter(F.col("to").isNotNull()).join(good, [*S, "level"], "left_semi").groupBy(*S).agg(
        F.array_join(F.array_sort(F.collect_set("method")), "+").alias("method"))
    return paths.join(methods, S)
