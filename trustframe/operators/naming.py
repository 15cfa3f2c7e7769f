"""Unique names for columns and tables: in order, each takes its own name or the first free one with a number behind.

What a name meets depends only on names of its stem (its letters without `_2`, `_2_3` ... behind), so the names of one
stem of one table are numbered apart from all others. Stems with one spelling, or without repeats, need a row number and no
more; the few that mix repeats with numbered spellings are walked through in order, each spelling from where it stopped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import clean_header, table_identifier


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Names of one stem in order; every spelling remembers the last number it tried."""
    rows = rows.sort_values("_order")
    taken, tried, names = {*rows["_reserved"]}, {}, []
    for base, folded in zip(rows["_base"], rows["_folded"]):
        name, key = base, folded
        while key in taken:
            number = tried[folded] = tried.get(folded, 1) + 1
            name, key = f"{base}_{number}", f"{folded}_{number}"
        taken.add(key)
        names.append(name)
    return rows.assign(name=names)


def unique_identifiers(rows: DataFrame, keys: list[str], order: str, base: Column, reserved: str = "") -> DataFrame:
    """`rows` with a column `name`, unique within `keys` whatever the case; `order` numbers the rows of a key, and
    `reserved` is taken from the start."""
    stem = F.regexp_replace(F.col("_folded"), "(_[0-9]+)+$", "")
    based = rows.withColumn("_base", base).withColumn("_folded", F.lower("_base")).withColumn("_order", F.col(order).cast("long"))
    based = based.withColumn("_stem", stem).withColumn("_reserved", F.lit(reserved.lower()))
    # one shuffle and one sort by stem: a row's place in its stem gives its number among rows of its spelling, and the counts
    by_stem, by_spelling = Window.partitionBy(*keys, "_stem"), Window.partitionBy(*keys, "_stem", "_folded")
    placed = based.withColumn("_place", F.row_number().over(by_stem.orderBy("_folded", "_order")))
    placed = placed.withColumn("_nth", F.col("_place") - F.min("_place").over(by_spelling) + 1)
    shaped = placed.withColumns({
        "_rows": F.count(F.lit(1)).over(by_stem),
        "_spellings": F.count_if(F.col("_folded").isNotNull() & (F.col("_nth") == 1)).over(by_stem),
        "_meets": F.bool_or(F.col("_folded") == F.col("_reserved")).over(by_stem)})
    simple = (F.col("_spellings") == 1) | ((F.col("_spellings") == F.col("_rows")) & ~F.col("_meets"))
    shaped = shaped.withColumn("_simple", simple).drop("_place", "_rows", "_spellings", "_meets")
    number = F.col("_nth") + (F.col("_folded") == F.col("_reserved")).cast("int")
    name = F.when(number == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), number.cast("string")))
    easy = shaped.filter("_simple").withColumn("name", name)
    rest = shaped.filter("NOT _simple").groupBy(*keys, "_stem").applyInPandas(_walk, easy.schema)
    return easy.unionByName(rest).drop("_base", "_folded", "_order", "_stem", "_reserved", "_simple", "_nth")


def unique_names(headers: DataFrame, keys: list[str], reserved: str) -> DataFrame:
    """(keys, col, position, name, header): cleaned headers, blank ones become col_N, repeats get _2, _3 ..."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("col"))       # one table's columns
    placed = headers.select(*keys, "col", place.alias("position"), clean_header(F.col("header")).alias("_clean"), "header")
    base = F.when(F.col("_clean") == "", F.concat(F.lit("col_"), F.col("position").cast("string"))).otherwise(F.col("_clean"))
    return unique_identifiers(placed, keys, "position", base, reserved).select(*keys, "col", "position", "name", "header")


def unique_tables(sheets: DataFrame, keys: list[str], order: str, sheet: str = "sheet") -> DataFrame:
    """`sheets` with `table_name`: identifiers that are unique within `keys` (a source, or a store)."""
    return unique_identifiers(sheets, keys, order, table_identifier(F.col(sheet))).withColumnRenamed("name", "table_name")
