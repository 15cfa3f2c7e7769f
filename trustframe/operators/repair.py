"""Repair suggestions: null markers, spelling variants and numbers kept as text. Stored data is never changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import stable_id
from ..functions.numbers import number_repair
from ..functions.text import category_form, is_null_token
from ..session import materialize
from ..tables import Table, TableSet
from .frequencies import LONG_TEXT
from .quality import text_columns

RULES = ("null_token", "category_consolidation", "text_as_number")       # where several apply to a cell, the last one shows


def text_cells(tables: TableSet) -> DataFrame:
    """(column_no, row_id, txt) of every text cell."""
    parts = []
    for t in tables.tables:
        columns = text_columns(t)
        if columns:
            args = [F.lit(len(columns))]
            for name, c in columns:
                args += [F.lit(tables.number(t, name)), c]
            parts.append(t.df.select(t.row_column.alias("row_id"), F.stack(*args).alias("column_no", "txt")).filter("txt IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def _key(c: Column) -> Column:
    """Short texts stand for themselves; long ones travel as their hash."""
    return F.when(F.length(c) > LONG_TEXT, F.sha2(c, 256)).otherwise(c)


def spelling_map(cells: DataFrame) -> DataFrame:
    """(column_no, value, canonical, canonical_row): variants of one spelling and the most frequent one.

    Counting combines before the shuffle; only spellings with several variants survive, so hot values stay one row.
    """
    variants = cells.select("column_no", _key(category_form(F.col("txt"))).alias("form"), _key(F.col("txt")).alias("value"),
                            (F.length("txt") > LONG_TEXT).alias("is_long"), "row_id")
    counted = variants.groupBy("column_no", "form", "value", "is_long").agg(F.count(F.lit(1)).alias("cnt"),
                                                                            F.min("row_id").alias("first_row"))
    best = counted.groupBy("column_no", "form").agg(
        F.count(F.lit(1)).alias("variants"),
        F.min_by(F.struct("value", "is_long", "first_row"), F.struct(-F.col("cnt"), F.col("value"))).alias("b")).filter("variants > 1")
    return counted.join(best, ["column_no", "form"]).filter(F.col("value") != F.col("b.value")).select(
        "column_no", "value", F.col("b.value").alias("canonical"), F.col("b.is_long").alias("canonical_long"),
        F.col("b.first_row").alias("canonical_row"), "cnt")


def repairs(tables: TableSet, enabled: tuple[str, ...] = RULES) -> DataFrame:
    """(repair_id, table_id, column_id, row_id, original_value, repaired_value, rule); rules left out suggest nothing.

    One pass finds the spelling variants, one more tests every cell against all rules. The map of variants is written
    once: it joins as a broadcast while it is small and as a (skew-aware) shuffle join beyond that.
    """
    cells, txt = text_cells(tables), F.col("txt")

    def suggestion(rule: str, applies: Column, repaired: Column) -> Column:
        return F.when(applies, F.struct(F.lit(rule).alias("rule"), repaired.cast("string").alias("repaired_value")))

    options = []
    if "null_token" in enabled:
        options.append(suggestion("null_token", is_null_token(txt), F.lit(None)))
    if "category_consolidation" in enabled:
        mapping = spelling_map(cells)
        wanted = mapping.filter("canonical_long").select("column_no", "canonical_row").distinct()
        full = cells.withColumnRenamed("row_id", "canonical_row").join(wanted, ["column_no", "canonical_row"]).select(
            "column_no", "canonical_row", F.col("txt").alias("full_text"))
        mapping = mapping.join(full, ["column_no", "canonical_row"], "left")
        target = F.when(F.col("canonical_long"), F.col("full_text")).otherwise(F.col("canonical"))
        mapping = materialize(mapping.select("column_no", "value", target.alias("target")), "spellings")
        cells = cells.withColumn("value", _key(txt)).join(mapping, ["column_no", "value"], "left")
        options.append(suggestion("category_consolidation", F.col("target").isNotNull(), F.col("target")))
    if "text_as_number" in enabled:
        options.append(suggestion("text_as_number", number_repair(txt).isNotNull(), number_repair(txt)))
    named = tables.columns().select("column_no", "column_id", "column_name", "table_id")
    if not options:
        return tables.spark.createDataFrame([], "repair_id string, table_id string, column_id string, column_name string, row_id long, "
                                                "original_value string, repaired_value string, rule string")
    found = cells.select("column_no", "row_id", txt.alias("original_value"), F.explode(F.array_compact(F.array(*options))).alias("s")).select(
        "column_no", "row_id", "original_value", "s.*").join(named, "column_no")
    return found.select(stable_id(F.col("table_id"), F.col("column_id"), F.col("row_id"), F.col("rule")).alias("repair_id"),
                        "table_id", "column_id", "column_name", "row_id", "original_value", "repaired_value", "rule")


def repaired_view(table: Table, suggestions: DataFrame) -> DataFrame:
    """The table with suggestions shown in place. A match flag decides, because NULL is a legal repaired value."""
    order = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    mine = suggestions.filter(F.col("table_id") == table.table_id)
    cell = mine.groupBy("row_id", "column_name").agg(F.max_by(F.struct("repaired_value"), order).alias("fix"))
    per_row = cell.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "fix"))).alias("_fixes"))
    rows = table.df.withColumn("_at", table.row_column).join(per_row.withColumnRenamed("row_id", "_at"), "_at", "left")
    texts = {name for name, _ in text_columns(table)}

    def shown(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name not in texts or dict(table.df.dtypes)[name] != "string":
            return c
        fix = F.try_element_at("_fixes", F.lit(name))
        return F.when(fix.isNotNull(), fix["repaired_value"]).otherwise(c).alias(name)

    return rows.select(*[shown(n) for n in table.df.columns])
