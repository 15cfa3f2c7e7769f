"""Exact k-th smallest values of very large columns.

Every wanted rank sits in a bracket of two values, at first the least and the greatest. A pass counts the values below and
inside each bracket and cuts those that hold more than `bound` values at a grid of approximate quantiles, so that a few
hundredths of them stay; passes repeat until no bracket holds more. Then only the distinct values inside are sorted, at
most `bound` in a task however large the column is. Equal values are one row, so a hot value is no burden. Ranks rest on
counts, never on the sketch: a rank outside its bracket stops the job instead of returning a wrong value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import local_frame

ACCURACY = 10_000
#: Values that one task may sort for one rank.
BOUND = 1_000_000
#: Steps of the quantile grid; a step is ten times the error of the sketch.
GRID = 1_000


def _next_bracket(low, high, rank: int, below: int, inside: int, grid: list) -> tuple:
    """A narrower bracket around the rank: the grid points a step beyond it on either side."""
    at = (rank - below) * (len(grid) - 1) // max(1, inside - 1)
    return (low if at < 1 else grid[at - 1]), (high if at + 2 >= len(grid) else grid[at + 2])


def order_statistics(values: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75), group: str = "column_no",
                     value: str = "v", accuracy: int = ACCURACY, bound: int = BOUND) -> DataFrame:
    """(group, n, q): q holds the elements at offsets round(fraction * (n - 1)) of the sorted group, halves to even.

    Groups are columns: one row per group and round reaches the driver.
    """
    spark, v, k = values.sparkSession, F.col(value), len(fractions)
    values = values.filter(v.isNotNull()).select(group, value)
    kind, group_kind = values.schema[value].dataType, values.schema[group].dataType
    steps = min(GRID, accuracy // 10)
    grid = [i / steps for i in range(steps + 1)]
    first = values.groupBy(group).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
                                      F.percentile_approx(v, grid, accuracy).alias("grid")).collect()
    brackets, open_ = {}, {}
    for r in first:
        for i, f in enumerate(fractions):
            rank = round(f * (r["n"] - 1))
            brackets[r[group], i] = (r["least"], r["most"], rank)
            if r["n"] > bound and r["least"] != r["most"]:
                open_[r[group], i] = _next_bracket(r["least"], r["most"], rank, 0, r["n"], r["grid"])
    sizes = {r[group]: r["n"] for r in first}
    pair = StructType([StructField("low", kind), StructField("high", kind)])

    def located(chosen: dict) -> DataFrame:
        """Values beside the brackets of their group: an array with an entry, or null, per fraction."""
        rows = [(g, [(*chosen[g, i][:2],) if (g, i) in chosen else None for i in range(k)]) for g in sorted({g for g, _ in chosen})]
        return values.join(local_frame(spark, rows, StructType([StructField(group, group_kind), StructField("b", ArrayType(pair))])), group)

    while open_:
        counts = []
        for i in range(k):
            b = F.col("b")[i]
            between = (v > b["low"]) & (v < b["high"])
            counts += [F.count_if(v < b["low"]).alias(f"below{i}"), F.count_if(v <= b["low"]).alias(f"upto{i}"), F.count_if(between).alias(f"between{i}"),
                       F.count_if(v <= b["high"]).alias(f"end{i}"), F.percentile_approx(F.when(between, v), grid, accuracy).alias(f"grid{i}")]
        still = {}
        for r in located(open_).groupBy(group).agg(*counts).collect():
            for i in range(k):
                if (r[group], i) not in open_:
                    continue
                (low, high), rank = open_[r[group], i], brackets[r[group], i][2]
                below, upto, between, end = (r[f"{c}{i}"] for c in ("below", "upto", "between", "end"))
                if not below <= rank < end:
                    raise RuntimeError("a rank fell outside its bracket")
                if rank < upto or rank >= upto + between:               # one of the ends itself
                    low = high = low if rank < upto else high
                elif between > bound:
                    least, most = r[f"grid{i}"][0], r[f"grid{i}"][-1]
                    still[r[group], i] = _next_bracket(least, most, rank, upto, between, r[f"grid{i}"])
                brackets[r[group], i] = (low, high, rank)
        open_ = still

    ranks = local_frame(spark, [(g, i, rank, sizes[g]) for (g, i), (_, _, rank) in brackets.items()],
                        StructType([StructField(group, group_kind), StructField("i", LongType()), StructField("rank", LongType()), StructField("n", LongType())]))
    spots = F.transform("b", lambda b, i: F.struct(i.cast("long").alias("i"), F.when(v < b["low"], 0).when(v <= b["high"], 1).alias("zone")))
    near = located(brackets).select(group, v.alias("x"), F.explode(F.filter(spots, lambda s: s["zone"].isNotNull())).alias("s"))
    counted = near.groupBy(group, "s.i", F.when(F.col("s.zone") == 1, F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(group, "i").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("upto", F.sum("c").over(order)).join(ranks, [group, "i"])
    hit = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))
    safe = F.when(F.col("x").isNull(), F.raise_error(F.lit("a rank fell outside its bracket")).cast(kind)).otherwise(F.col("x"))
    found = running.filter(hit).select(group, "n", "i", safe.alias("x"))
    return found.groupBy(group, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))
