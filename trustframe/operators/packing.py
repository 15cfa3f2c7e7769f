"""Choosing what fits a token budget: items in order, skipping those that no longer fit.

Whether an item fits depends on everything taken before it, but the candidates can be narrowed exactly: once an item of
some size is skipped, no later item of that size fits either, because the room only shrinks. Per pack and size only the
first budget/size items can ever be taken. That bound holds for any number of items in a pack, so even a pack with a
third of all rows sends at most budget * ln(budget) small rows to the final pass, and no text travels there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import token_units

UNITS_PER_TOKEN = 7
SALTS = 64


def fitting_items(items: DataFrame, pack: list[str], order: list[str], size: Column, budget_units: int, start_units: int = 0) -> DataFrame:
    """(pack, order) of the items taken: each in order, while start + sizes stay within the budget."""
    sized = items.select(*pack, *order, size.cast("long").alias("size"))
    room = budget_units - start_units
    small = sized.filter(F.col("size") <= room)
    allowed = F.when(F.col("size") > 0, F.floor(F.lit(room) / F.col("size"))).otherwise(F.lit(1 << 40))
    # a hot (pack, size) group is cut down inside salted parts first, then as a whole
    salted = small.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    for keys in ([*pack, "size", "salt"], [*pack, "size"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("place", place).filter(F.col("place") <= allowed)
    candidates = salted.select(*pack, *order, "size")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        left, keep = room, []
        for s in rows["size"]:
            keep.append(s <= left)
            left -= s if keep[-1] else 0
        return rows[keep][[*pack, *order]]

    schema = candidates.select(*pack, *order).schema
    return candidates.groupBy(*pack).applyInPandas(greedy, schema)


def pack_texts(items: DataFrame, pack: list[str], order: list[str], text: str, budget_tokens: int) -> DataFrame:
    """The items (all columns) that fit each pack's budget of estimated tokens."""
    taken = fitting_items(items, pack, order, token_units(F.col(text)), budget_tokens * UNITS_PER_TOKEN)
    return items.join(taken, [*pack, *order], "left_semi")


def omissions(items: DataFrame, taken: DataFrame, pack: list[str], order: list[str], section: str) -> DataFrame:
    """How many items of each section did not fit."""
    return items.join(taken.select(*pack, *order), [*pack, *order], "left_anti").groupBy(*pack, section).agg(
        F.count(F.lit(1)).alias("omitted"))


def pack_hash(taken: DataFrame, pack: list[str], order: list[str], text: str) -> DataFrame:
    """One digest per pack over its items in order; the taken items are bounded by the budget."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return taken.groupBy(*pack).agg(F.substring(F.sha2(F.to_json(listed["_t"]), 256), 1, 16).alias("hash"), F.count(F.lit(1)).alias("items"))
