"""Relationships between tables: key columns whose values another column draws on."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import fixed_values as V
from ..functions.names import compact_name, source_alias, stable_id, type_family
from ..session import local_frame, materialize
from ..tables import TableSet
from .frequencies import value_frequencies
from .keys import keys as find_keys, with_confirmed
from .profile import profile


#: Values of a child column that are looked up first, and the standard deviations by which they must miss to refute a pair.
SKETCH, SIGMAS = 256, 6
#: Values of all candidate pairs from which it pays to look up sketches first; the result is the same either way.
SKETCH_FROM = 5_000_000


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two names."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


# a filter on the score must not be pushed below the call, or every pair would be compared twice
name_ratio = name_ratio.asNondeterministic()


def similar_names(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child_name, parent_name, name_score) with a score of at least 0.82, without comparing every pair.

    With T characters in both names, a ratio of 0.82 needs M >= 0.41 T matched ones, in at most T - 2M + 1 blocks, so
    the names share at least 0.23 T - 1 letter pairs (repeats numbered). Each name is therefore looked up by its rarest
    letter pairs only, enough of them that two similar names must meet in one. Names of one or two letters must be equal.
    """
    names = children.union(parents).distinct().toDF("name")
    pairs_at = F.when(F.length("name") >= 2, F.sequence(F.lit(1), F.length("name") - 1)).otherwise(F.array().cast("array<int>"))
    grams = names.select("name", F.transform(pairs_at, lambda i: F.substr("name", i, F.lit(2))).alias("g"))
    numbered = F.transform(F.col("g"), lambda x, i: F.concat(x, F.lit("#"), F.size(
        F.filter(F.slice("g", 1, i + 1), lambda y: y == x)).cast("string")))
    tokens = grams.select("name", F.explode(numbered).alias("token"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("names"))
    ranked = tokens.join(rarity, "token").groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("names", "token"))).alias("t"))
    needed = F.greatest(F.lit(1), F.ceil(0.23 * 1.69 * F.length("name") - 1).cast("int"))
    kept = ranked.select("name", F.explode(F.slice(F.col("t.token"), 1, F.greatest(F.lit(1), F.size("t") - needed + 1))).alias("token"))
    c = kept.join(children.toDF("name").distinct(), "name").select(F.col("name").alias("child_name"), "token")
    p = kept.join(parents.toDF("name").distinct(), "name").select(F.col("name").alias("parent_name"), "token")
    lengths = F.length("child_name") + F.length("parent_name")
    met = c.join(p, "token").filter("child_name <> parent_name").filter(
        2 * F.least(F.length("child_name"), F.length("parent_name")) >= V.NAME_SIMILARITY * lengths)
    unequal = met.select("child_name", "parent_name").distinct().withColumn("name_score", name_ratio("child_name", "parent_name"))
    same = children.toDF("child_name").distinct().join(parents.toDF("parent_name").distinct(),
                                                       F.col("child_name") == F.col("parent_name"))
    same = same.filter("child_name <> ''").withColumn("name_score", F.lit(1.0))
    return same.unionByName(unequal.filter(F.col("name_score") >= V.NAME_SIMILARITY))


def candidate_pairs(tables: TableSet, profiles: DataFrame, keys: DataFrame) -> DataFrame:
    """Column pairs worth measuring: trusted key parent, same type family, similar name, enough child values."""
    described = profiles.select("column_no", "column_id", "table_id", "table_name", "column_name", "distinct_count",
                                "row_count", compact_name(F.col("column_name")).alias("name"),
                                type_family(F.col("kind")).alias("family"))
    trusted = keys.filter((F.size("columns") == 1) & ((F.col("status") == "confirmed") |
                                                      (F.col("uniqueness") >= V.KEY_UNIQUENESS)))
    trust = trusted.select(F.col("columns")[0].alias("column_id"),
                           F.when(F.col("status") == "confirmed", F.lit(1.0)).otherwise(F.col("uniqueness")).alias("trust"))
    parents = described.join(trust, "column_id")
    domain = F.when(F.col("row_count") < 50, 3).otherwise(5)
    children = described.filter(F.col("distinct_count") >= domain)
    names = similar_names(children.select("name"), parents.select("name"))
    c = children.select(*[F.col(x).alias(f"child_{x}") for x in
                          ("column_no", "column_id", "table_id", "table_name", "column_name", "name", "family", "distinct_count")])
    p = parents.select(*[F.col(x).alias(f"parent_{x}") for x in
                         ("column_no", "column_id", "table_id", "table_name", "column_name", "name", "family")], "trust")
    return (c.join(names, "child_name").join(p, "parent_name")
            .filter("child_family = parent_family AND child_table_id <> parent_table_id"))


def value_hashes() -> list[Column]:
    """128 bits of a frequency value, in two longs. Whole numbers and doubles compare as numbers."""
    number = F.coalesce(F.when(F.abs(F.col("value_i")) < V.MAX_EXACT_INTEGER, F.col("value_i").cast("double")), F.col("value_d")) + F.lit(0.0)
    kind = F.when(number.isNotNull(), 0).when(F.col("value_i").isNotNull(), 1).when(F.col("value_s").isNotNull(), 2).otherwise(3)
    parts = [kind, number, F.when(number.isNull(), F.col("value_i")), F.col("value_s"), F.col("digest")]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *parts).alias("h2")]


def hashed_values(frequencies: DataFrame, columns: list[int]) -> DataFrame:
    """(column_no, h1, h2) of some columns. The literal list reaches the scan, which skips the pages of other columns."""
    return frequencies.filter(F.col("column_no").isin(columns)).select("column_no", *value_hashes())


def not_refuted(pairs: DataFrame, frequencies: DataFrame, columns: list[tuple[int, int]]) -> DataFrame:
    """The pairs whose child may lie in its parent: of the SKETCH values of a child with the smallest hashes, a uniform draw of its
    distinct values, as many are found in the parent as CONTAINMENT leaves room for, less SIGMAS standard deviations.

    Sketches are small and meet the parents' values where these are read; no full column is shuffled for a pair that fails.
    """
    order = Window.partitionBy("column_no").orderBy("h1", "h2")
    drawn = hashed_values(frequencies, sorted({c for c, _ in columns})).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SKETCH).drop("rank")
    asked = drawn.withColumnRenamed("column_no", "child_column_no").join(pairs.select("child_column_no", "parent_column_no"), "child_column_no")
    parents = hashed_values(frequencies, sorted({p for _, p in columns})).withColumnRenamed("column_no", "parent_column_no")
    found = asked.join(parents.withColumn("hit", F.lit(1)), ["parent_column_no", "h1", "h2"], "left")
    counts = found.groupBy("child_column_no", "parent_column_no").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("hits"))
    least = V.CONTAINMENT * F.col("asked") - SIGMAS * F.sqrt(F.col("asked") * V.CONTAINMENT * (1 - V.CONTAINMENT))
    return pairs.join(counts.filter(F.col("hits") >= least).select("child_column_no", "parent_column_no"), ["child_column_no", "parent_column_no"], "left_semi")


def containment(pairs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(child_column_no, parent_column_no, matched): child values also found in the parent, over all values.

    Values are distinct per column, so no key is hot; they meet as 128-bit hashes. Many pairs are first cut by sketches.
    """
    found = pairs.select("child_column_no", "parent_column_no", "child_distinct_count").collect()           # candidate columns: metadata
    columns = [(c, p) for c, p, _ in found]
    if not columns:
        return pairs.sparkSession.createDataFrame([], "child_column_no int, parent_column_no int, matched long")
    if sum(n for *_, n in found) > SKETCH_FROM:             # sketches cost two jobs, and save a shuffle of the values
        pairs = materialize(not_refuted(pairs, frequencies, columns), "likely-pairs")
        columns = [tuple(r) for r in pairs.select("child_column_no", "parent_column_no").collect()] or [(-1, -1)]
    wanted = pairs.select("child_column_no", "parent_column_no")
    child = hashed_values(frequencies, sorted({c for c, _ in columns})).withColumnRenamed("column_no", "child_column_no").join(wanted, "child_column_no")
    parent = hashed_values(frequencies, sorted({p for _, p in columns})).withColumnRenamed("column_no", "parent_column_no")
    return (child.join(parent, ["parent_column_no", "h1", "h2"], "left_semi")
            .groupBy("child_column_no", "parent_column_no").agg(F.count(F.lit(1)).alias("matched")))


def relationships(tables: TableSet, profiles: DataFrame | None = None, frequencies: DataFrame | None = None,
                  keys: DataFrame | None = None, declared: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Inferred relationships (score = 0.65 containment + 0.25 name + 0.10 parent trust) and declared ones."""
    frequencies = value_frequencies(tables) if frequencies is None else frequencies
    profiles = profile(tables, frequencies) if profiles is None else profiles
    keys = find_keys(tables, profiles) if keys is None else keys
    # a few rows per column: written once, so that its size is known where it meets the frequencies
    pairs = materialize(candidate_pairs(tables, profiles, keys), "column-pairs")
    found = pairs.join(containment(pairs, frequencies), ["child_column_no", "parent_column_no"])
    found = found.withColumn("containment", F.col("matched") / F.col("child_distinct_count")).filter(
        F.col("containment") >= V.CONTAINMENT)
    score = 0.65 * F.col("containment") + 0.25 * F.col("name_score") + 0.10 * F.col("trust")
    inferred = found.select(
        stable_id(F.col("child_column_id"), F.col("parent_column_id")).alias("relationship_id"),
        F.col("child_column_id").alias("from_column"), F.col("parent_column_id").alias("to_column"),
        F.lit("inclusion").alias("relation_kind"), "containment", F.lit("inferred").alias("status"),
        F.lit("key_name_containment").alias("method"), F.least(F.lit(1.0), score).alias("score"),
        F.col("child_distinct_count").alias("compared"), "matched", F.round("name_score", 4).alias("name_score"))
    if declared:
        inferred = with_confirmed(inferred, declared_relationships(tables, declared), "relationship_id", ["containment"])
    return inferred


def declared_relationships(tables: TableSet, declared: list[tuple[str, str, str, str]]) -> DataFrame:
    """(from_table, from_column, to_table, to_column) stated by the user."""
    from ..functions.names import column_identity
    rows = [(column_identity(tables.table(ft).table_id, fc), column_identity(tables.table(tt).table_id, tc))
            for ft, fc, tt, tc in declared]
    given = local_frame(tables.spark, rows, "from_column string, to_column string")
    return given.select(stable_id(F.col("from_column"), F.col("to_column")).alias("relationship_id"), "from_column",
                        "to_column", F.lit("reference").alias("relation_kind"), F.lit(None).cast("double").alias("containment"),
                        F.lit("confirmed").alias("status"), F.lit("declared").alias("method"), F.lit(1.0).alias("score"),
                        F.lit(None).cast("long").alias("compared"), F.lit(None).cast("long").alias("matched"),
                        F.lit(None).cast("double").alias("name_score"))


def named_relationships(tables: TableSet, relations: DataFrame) -> DataFrame:
    cols = tables.columns()
    child = cols.select(F.col("column_id").alias("from_column"), F.col("source_id").alias("from_source"),
                        F.col("table_name").alias("from_table"), F.col("column_name").alias("from_name"))
    parent = cols.select(F.col("column_id").alias("to_column"), F.col("source_id").alias("to_source"),
                         F.col("table_name").alias("to_table"), F.col("column_name").alias("to_name"))
    return relations.join(child, "from_column").join(parent, "to_column")


def join_recipes(tables: TableSet, relations: DataFrame) -> DataFrame:
    """One ready-made join clause per relationship; names carry their source only when it differs."""
    named = named_relationships(tables, relations)

    def view(source: str, table: str):
        plain = F.concat(F.lit("`"), F.col(table), F.lit("`"))
        other = F.concat(F.lit("`"), source_alias(F.col(source)), F.lit("__"), F.col(table), F.lit("`"))
        return F.when(F.col("from_source") == F.col("to_source"), plain).otherwise(other)

    known = F.coalesce(F.concat(F.round(F.col("containment") * 100).cast("int").cast("string"), F.lit("% of values found")),
                       F.lit("declared"))
    clause = F.concat(F.lit("FROM "), view("from_source", "from_table"), F.lit(" a JOIN "), view("to_source", "to_table"),
                      F.lit(" b ON a.`"), "from_name", F.lit("` = b.`"), "to_name", F.lit("`"))
    return named.select("from_table", "from_name", "to_table", "to_name", "status", "score", known.alias("confidence"),
                        clause.alias("join_sql"))


