"""Key candidates: single columns from the profile, pairs of columns only where no single column qualifies."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed_values as V
from ..functions.names import stable_id
from ..session import local_frame, materialize
from ..tables import Table, TableSet
from .frequencies import LONG_TEXT
from .profile import profile
from .rows import canonical

#: Pairs of columns counted exactly in one scan, each of which multiplies the rows that are shuffled.
PAIRS_PER_SCAN = 15
#: Rows of the sample that refutes pairs; smaller tables are counted at once.
SAMPLE_ROWS = 10_000
#: Standard deviations by which a sample or a sketch must miss a key's counts to refute it.
SIGMAS = 6
#: Sketches have 2^12 registers: 4 kB a pair, 1.6 % standard error.
SKETCH_BITS = 12
KEY_SCHEMA = ("key_id string, table_id string, columns array<string>, column_names array<string>, uniqueness double, "
              "null_rate double, status string, method string, score double")


def single_keys(profiles: DataFrame) -> DataFrame:
    uniq, nulls = F.col("distinct_count") / F.col("row_count"), F.col("nulls") / F.col("row_count")
    rows = profiles.filter("row_count > 1 AND n > 0").withColumn("uniqueness", uniq).withColumn("null_rate", nulls)
    rows = rows.filter((F.col("uniqueness") >= V.KEY_UNIQUENESS) & (F.col("null_rate") <= V.KEY_NULL_RATE))
    return rows.select(stable_id(F.col("table_id"), F.col("column_id")).alias("key_id"), "table_id",
                       F.array("column_id").alias("columns"), F.array("column_name").alias("column_names"),
                       "uniqueness", "null_rate", F.lit("inferred").alias("status"),
                       F.lit("single_column_uniqueness").alias("method"),
                       F.least(F.lit(1.0), "uniqueness").alias("score"))


def comparable(table: Table, name: str) -> Column:
    """A value of a column as text, long ones by their digest."""
    field = next(f for f in table.fields if f.name == name)
    c = canonical(field)
    if isinstance(field.dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        return F.when(F.length(c) > LONG_TEXT, F.sha2(c, 256)).otherwise(c)
    return c


def hashed(table: Table, name: str) -> Column:
    """64 bits of a value; null stays null."""
    c = comparable(table, name)
    return F.when(c.isNotNull(), F.xxhash64(c))


def pair_counts(table: Table, pairs: list[tuple[int, str, str]]) -> DataFrame:
    """(pair_no, distinct_pairs, filled) for numbered column pairs, in one scan and one shuffle."""
    args = [F.lit(len(pairs))]
    for number, a, b in pairs:
        args += [F.lit(number), comparable(table, a), comparable(table, b)]
    cells = table.df.select(F.stack(*args).alias("pair_no", "a", "b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return (cells.groupBy("pair_no", "a", "b").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("pair_no").agg(F.count(F.lit(1)).alias("distinct_pairs"), F.sum("c").alias("filled")))


def refuted_by_sample(sample: DataFrame, pairs: list[tuple[int, int, int]]) -> set[int]:
    """Numbers of the column pairs that a uniform row sample (columns h0.. of hashed values) shows to be no key.

    Rows that repeat a pair, or hold a null in it, are at most 1 - KEY_UNIQUENESS of a key's rows, and a sample of s rows
    holds no more of them than a binomial draw of that share; SIGMAS standard deviations above it a pair is refuted.
    """
    args = [F.lit(len(pairs))]
    for number, a, b in pairs:
        args += [F.lit(number), F.col(f"h{a}"), F.col(f"h{b}")]
    rows = sample.count()
    share = 1 - V.KEY_UNIQUENESS
    most = share * rows + SIGMAS * math.sqrt(share * rows)
    counts = sample.select(F.stack(*args).alias("pair_no", "a", "b")).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("pair_no", "a", "b").count()
    distinct = {r["pair_no"]: r["n"] for r in counts.groupBy("pair_no").agg(F.count(F.lit(1)).alias("n")).collect()}    # a row per pair
    return {number for number, _, _ in pairs if rows - distinct.get(number, 0) > most}


def sketched_counts(table: Table, pairs: list[tuple[int, str, str]]) -> dict[int, float]:
    """Estimated distinct values of each pair, from one scan that fills a mergeable sketch per pair."""
    values = {n: hashed(table, n) for _, a, b in pairs for n in (a, b)}
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(F.when(values[a].isNotNull() & values[b].isNotNull(), F.xxhash64(values[a], values[b])), SKETCH_BITS)).alias(f"p{i}")
                for i, (_, a, b) in enumerate(pairs)]
    row = table.df.agg(*sketches).first()
    return {number: float(row[f"p{i}"]) for i, (number, _, _) in enumerate(pairs)}


def pair_results(tables: TableSet, table: Table, candidates: list[tuple]) -> DataFrame:
    """The first of these numbered pairs of candidate columns that identifies rows, counted exactly; no row if none does."""
    rows = candidates[0][1].row_count
    counts = pair_counts(table, [(i, a.column_name, b.column_name) for i, a, b in candidates])
    names = local_frame(tables.spark, [(i, [a.column_id, b.column_id], [a.column_name, b.column_name]) for i, a, b in candidates],
                        "pair_no int, columns array<string>, column_names array<string>")
    good = counts.withColumn("uniqueness", F.col("distinct_pairs") / F.lit(rows)).filter(
        F.col("uniqueness") >= V.KEY_UNIQUENESS)
    best = good.join(names, "pair_no").agg(*[F.min_by(c, "pair_no").alias(c) for c in
                                             ("columns", "column_names", "uniqueness", "filled")])
    return best.filter("columns IS NOT NULL").select(
        stable_id(F.lit(table.table_id), F.col("columns")[0], F.col("columns")[1]).alias("key_id"),
        F.lit(table.table_id).alias("table_id"), "columns", "column_names", "uniqueness",
        (1 - F.col("filled") / F.lit(rows)).alias("null_rate"), F.lit("inferred").alias("status"),
        F.lit("composite_uniqueness").alias("method"), F.least(F.lit(1.0), "uniqueness").alias("score"))


def first_pair(tables: TableSet, table: Table, columns: list) -> DataFrame | None:
    """The first pair of `columns` that identifies rows; None if no pair can.

    A table of up to SAMPLE_ROWS rows is counted at once. Of a larger one a row sample refutes most pairs (first scan),
    sketches refute those that repeat too often for a sample to show (second scan, where more than PAIRS_PER_SCAN are left),
    and the survivors are counted exactly, in the order of the columns, until a scan has found a key.
    """
    rows = columns[0].row_count
    ordered = list(combinations(columns[:V.COMPOSITE_COLUMNS], 2)) + [(a, b) for a, b in combinations(columns, 2) if b in columns[V.COMPOSITE_COLUMNS:]]
    pairs = [(i, a, b) for i, (a, b) in enumerate(ordered) if a.distinct_count * b.distinct_count >= V.KEY_UNIQUENESS * rows]
    if pairs and rows > SAMPLE_ROWS:
        at = {c.column_name: i for i, c in enumerate(columns)}
        part = F.pmod(F.xxhash64(table.row_column, F.lit(7)), F.lit(rows // SAMPLE_ROWS)) == 0
        sample = materialize(table.df.filter(part).select(*[hashed(table, n).alias(f"h{i}") for n, i in at.items()]), "key-sample")
        gone = refuted_by_sample(sample, [(i, at[a.column_name], at[b.column_name]) for i, a, b in pairs])
        pairs = [p for p in pairs if p[0] not in gone]
        if len(pairs) > PAIRS_PER_SCAN:
            error = SIGMAS * 1.04 / math.sqrt(2 ** SKETCH_BITS)
            estimates = sketched_counts(table, [(i, a.column_name, b.column_name) for i, a, b in pairs])
            pairs = [p for p in pairs if estimates[p[0]] >= V.KEY_UNIQUENESS * rows * (1 - error)]
    size = len(pairs) if rows <= SAMPLE_ROWS else PAIRS_PER_SCAN
    for start in range(0, len(pairs), size or 1):
        best = pair_results(tables, table, pairs[start:start + size])
        if start + size >= len(pairs):
            return best
        if found := best.collect():                 # one row at most
            return local_frame(tables.spark, [tuple(r) for r in found], KEY_SCHEMA)
    return None


def composite_keys(tables: TableSet, profiles: DataFrame, singles: DataFrame | None = None) -> DataFrame:
    """First pair of columns that identifies rows, for tables without a single-column key.

    The candidate list is metadata, so it is read to the driver to build the scans. All candidate columns take part: pairs
    of the first columns come first. A pair whose distinct counts multiply to fewer than the rows needed cannot qualify.
    """
    singles = single_keys(profiles) if singles is None else singles
    uniq, nulls = F.col("distinct_count") / F.col("row_count"), F.col("nulls") / F.col("row_count")
    wanted = (profiles.filter("row_count > 1 AND n > 0")
              .filter((uniq >= V.COMPOSITE_UNIQUENESS) & (nulls <= V.COMPOSITE_NULL_RATE))
              .join(singles.select("table_id").distinct(), "table_id", "left_anti")
              .select("table_id", "position", "column_id", "column_name", "distinct_count", "row_count").collect())
    parts = []
    for table in tables.tables:
        columns = sorted((r for r in wanted if r.table_id == table.table_id), key=lambda r: r.position)
        found = first_pair(tables, table, columns) if len(columns) > 1 else None
        if found is not None:
            parts.append(found)
    return reduce(DataFrame.unionByName, parts) if parts else local_frame(tables.spark, [], KEY_SCHEMA)


def declared_keys(tables: TableSet, declared: dict[str, list[str]]) -> DataFrame:
    """{table: [columns]} -> confirmed keys without measurements."""
    columns = tables.columns()
    wanted = local_frame(tables.spark, [(tables.table(t).table_id, c, i) for t, names in declared.items()
                                        for i, c in enumerate(names)], "table_id string, column_name string, at int")
    missing = {c for t, names in declared.items() for c in names} - {f.name for t in tables.tables for f in t.fields}
    if missing:
        raise ValueError("declared key columns not found: " + ", ".join(sorted(missing)))
    listed = wanted.join(columns, ["table_id", "column_name"]).groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "column_id", "column_name"))).alias("c"))
    return listed.select(
        F.substring(F.sha1(F.concat_ws("|", "table_id", F.col("c.column_id"))), 1, 20).alias("key_id"), "table_id",
        F.col("c.column_id").alias("columns"), F.col("c.column_name").alias("column_names"),
        F.lit(None).cast("double").alias("uniqueness"), F.lit(None).cast("double").alias("null_rate"),
        F.lit("confirmed").alias("status"), F.lit("declared").alias("method"), F.lit(1.0).alias("score"))


def with_confirmed(inferred: DataFrame, confirmed: DataFrame, id_column: str, measured: list[str]) -> DataFrame:
    """Confirmed rows win over inferred ones with the same id but keep what was measured."""
    old = inferred.select(id_column, *[F.col(m).alias(f"old_{m}") for m in measured])
    kept = confirmed.join(old, id_column, "left")
    for m in measured:
        kept = kept.withColumn(m, F.coalesce(m, f"old_{m}")).drop(f"old_{m}")
    return inferred.join(confirmed.select(id_column), id_column, "left_anti").unionByName(kept)


def keys(tables: TableSet, profiles: DataFrame | None = None, declared: dict[str, list[str]] | None = None) -> DataFrame:
    profiles = profile(tables) if profiles is None else profiles
    singles = single_keys(profiles)
    found = singles.unionByName(composite_keys(tables, profiles, singles))
    if declared:
        found = with_confirmed(found, declared_keys(tables, declared), "key_id", ["uniqueness", "null_rate"])
    return found
