"""Column profiles: counts, range, mean, distinct values, most frequent values and a reproducible sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.numbers import printable
from ..session import local_frame
from ..tables import Table, TableSet
from .frequencies import value_frequencies, value_number, value_text

STATS = "column_no int, n long, min_num double, max_num double, mean double, min_text string, max_text string"


def table_stats(tables: TableSet, table: Table, columns: set[str] | None = None) -> DataFrame:
    """One scan and one result row per table, turned to one row per column. Nothing but partial results is shuffled."""
    structs = []
    for f in table.fields:
        if columns is not None and f.name not in columns:
            continue
        c, kind = F.col(f"`{f.name}`"), table.kind(f)
        number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
        if kind == "mixed" and isinstance(f.dataType, T.StructType):
            number, text = F.when(c["txt"].isNull(), c["num"]), c["txt"]
        elif kind in ("int", "real", "bool") and not isinstance(f.dataType, T.StringType):
            number = c.cast("long" if kind == "bool" else "double").cast("double")
        elif kind == "nested":
            text = F.to_json(c)
        else:
            text = c.cast("string")
        mean = F.avg(number) if kind in ("int", "real") else F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(tables.number(table, f.name)).alias("column_no"), F.count(c).alias("n"), F.min(number).alias("min_num"),
            F.max(number).alias("max_num"), mean.alias("mean"), F.min(text).alias("min_text"),
            F.max(text).alias("max_text")))
    one_row = table.df.agg(F.count(F.lit(1)).alias("row_count"), *[s.alias(f"c{i}") for i, s in enumerate(structs)])
    packed = F.array(*[F.struct(*[F.col(f"c{i}.{p.split()[0]}").alias(p.split()[0]) for p in STATS.split(", ")])
                       for i in range(len(structs))])
    return one_row.select(F.lit(table.table_id).alias("table_id"), "row_count", F.explode(packed).alias("s")).select(
        "table_id", "row_count", "s.*")


def column_stats(tables: TableSet) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_stats(tables, t) for t in tables.tables])


def counted_as(table: Table, f: T.StructField) -> str:
    """How the frequencies hold a column, for its range: number, mixed, day, instant, clock, text, or `scan` if they cannot tell."""
    kind = table.kind(f)
    if kind in ("int", "real", "bool") and isinstance(f.dataType, (T.IntegralType, T.FractionalType, T.DecimalType, T.BooleanType)):
        return "number"
    if kind == "mixed" and isinstance(f.dataType, T.StructType):
        return "mixed"
    times = {T.DateType: "day", T.TimestampType: "instant", T.TimestampNTZType: "clock"}
    if type(f.dataType) in times:
        return times[type(f.dataType)] if kind in ("date", "datetime") else "scan"
    plain = kind != "nested" if isinstance(f.dataType, T.StringType) else kind == "nested"
    return "text" if plain else "scan"


def frequency_stats(tables: TableSet, frequencies: DataFrame) -> DataFrame:
    """n, range per channel, mean, distinct_count and digests of every column with values, from the frequencies alone."""
    how = local_frame(tables.spark, [(tables.number(t, f.name), counted_as(t, f), t.kind(f)) for t in tables.tables for f in t.fields],
                      "column_no int, how string, kind string")
    number = F.coalesce("value_d", F.col("value_i").cast("double"))
    per_column = frequencies.groupBy("column_no").agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("distinct_count"), F.count("digest").alias("digests"), F.min(number).alias("min_num"), F.max(number).alias("max_num"),
        F.sum(number * F.col("cnt")).alias("total"), F.min("value_i").alias("min_i"), F.max("value_i").alias("max_i"), F.min("value_s").alias("min_s"), F.max("value_s").alias("max_s"))

    def shown(whole: str, text: str) -> Column:
        day = F.date_from_unix_date(F.col(whole).cast("int")).cast("string")
        clock = F.expr(f"timestampadd(MICROSECOND, {whole}, timestamp_ntz'1970-01-01 00:00:00')").cast("string")
        return (F.when(F.col("how") == "day", day).when(F.col("how") == "instant", F.timestamp_micros(F.col(whole)).cast("string")).when(F.col("how") == "clock", clock)
                .when(F.col("how").isin("text", "mixed"), F.col(text)))

    numeric = F.col("how").isin("number", "mixed")
    return per_column.join(how, "column_no").select(
        "column_no", "n", F.when(numeric, F.col("min_num")).alias("min_num"), F.when(numeric, F.col("max_num")).alias("max_num"),
        F.when((F.col("how") == "number") & F.col("kind").isin("int", "real"), F.col("total") / F.col("n")).alias("mean"),
        shown("min_i", "min_s").alias("min_text"), shown("max_i", "max_s").alias("max_text"), "distinct_count", "digests", "how")


def profile(tables: TableSet, frequencies: DataFrame | None = None) -> DataFrame:
    """One row per column: row_count, n, nulls, distinct_count, range per channel, mean.

    All comes from the frequencies, so tables are only counted; but of a column with texts too long for the frequencies the
    range needs the texts, and those columns are scanned. What reaches the driver is one row per column or table.
    """
    frequencies = value_frequencies(tables) if frequencies is None else frequencies
    found = {r["column_no"]: r for r in frequency_stats(tables, frequencies).collect()}
    sizes = reduce(DataFrame.unionByName, [t.df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_id", F.lit(t.table_id)) for t in tables.tables])
    counts = {r["table_id"]: r["row_count"] for r in sizes.collect()}
    ranges, scans = {}, []
    for t in tables.tables:
        again = {f.name for f in t.fields if (r := found.get(tables.number(t, f.name))) and (r["digests"] or r["how"] == "scan")}
        if again:
            scans.append(table_stats(tables, t, again))
    if scans:
        ranges = {r["column_no"]: r for r in reduce(DataFrame.unionByName, scans).collect()}
    rows = []
    for t in tables.tables:
        for f in t.fields:
            number = tables.number(t, f.name)
            r = found.get(number)
            span = ranges.get(number, r)
            rows.append((number, counts[t.table_id], r["n"] if r else 0, *([span[c] for c in ("min_num", "max_num", "mean", "min_text", "max_text")] if r else [None] * 5),
                         r["distinct_count"] if r else 0))
    stats = local_frame(tables.spark, rows, "column_no int, row_count long, n long, min_num double, max_num double, mean double, min_text string, max_text string, distinct_count long")
    return (tables.columns().join(stats, "column_no")
            .withColumn("nulls", F.col("row_count") - F.col("n"))
            .withColumn("min_value", F.coalesce("min_text", printable(F.col("min_num"))))
            .withColumn("max_value", F.coalesce("max_text", printable(F.col("max_num")))))


def approximate_profile(tables: TableSet, relative_error: float = 0.02) -> DataFrame:
    """Profile-only variant without the frequency shuffle: distinct counts come from a sketch."""
    parts = []
    for t in tables.tables:
        sketches = [F.approx_count_distinct(F.to_json(F.col(f"`{f.name}`")) if t.kind(f) == "nested"
                                            else F.col(f"`{f.name}`"), relative_error).alias(f"c{i}")
                    for i, f in enumerate(t.fields)]
        one = t.df.agg(*sketches)
        args = [F.lit(len(t.fields))]
        for i, f in enumerate(t.fields):
            args += [F.lit(tables.number(t, f.name)), F.col(f"c{i}")]
        parts.append(one.select(F.stack(*args).alias("column_no", "distinct_count")))
    distinct = reduce(DataFrame.unionByName, parts)
    return (tables.columns().join(column_stats(tables).drop("table_id"), "column_no").join(distinct, "column_no")
            .withColumn("nulls", F.col("row_count") - F.col("n")))


def top_values(tables: TableSet, k: int = 5, frequencies: DataFrame | None = None) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller value (numbers before text).

    The rank filter becomes a group limit before the shuffle, so each task sends at most k rows per column.
    """
    frequencies = value_frequencies(tables) if frequencies is None else frequencies
    order = Window.partitionBy("column_no").orderBy(F.desc("cnt"), F.asc_nulls_last("value_i"),
                                                    F.asc_nulls_last("value_d"), F.asc_nulls_last("value_s"), "digest")
    top = frequencies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = tables.columns().select("column_no", "column_id", "table_id", "table_name", "column_name", "position", "kind")
    top = top.join(named, "column_no")
    return top.select("table_id", "table_name", "column_id", "column_name", "position", "kind", "rank",
                      value_number(F.col("kind")).alias("value_num"), value_text(F.col("kind")).alias("value_text"),
                      F.col("digest").isNotNull().alias("is_digest"), "cnt", "first_row")


def sample_values(tables: TableSet, size: int = 5, frequencies: DataFrame | None = None) -> DataFrame:
    """A reproducible sample of distinct values: those with the smallest hashes."""
    frequencies = value_frequencies(tables) if frequencies is None else frequencies
    named = tables.columns().select("column_no", "column_id", "table_id", "kind")
    hashed = frequencies.withColumn("h", F.xxhash64("value_i", "value_d", "value_s", "digest"))
    order = Window.partitionBy("column_no").orderBy("h", "first_row")
    kept = hashed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    return kept.join(named, "column_no").select("table_id", "column_id", "rank", value_text(F.col("kind")).alias("value"))


def profile_with_examples(tables: TableSet, k: int = 5, sample: int = 5, frequencies: DataFrame | None = None) -> DataFrame:
    """Profile rows with `top_k` (array of value/count) and `sample` (array of values); both are bounded by k."""
    frequencies = value_frequencies(tables) if frequencies is None else frequencies
    top = top_values(tables, k, frequencies).groupBy("column_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.col("value_text").alias("value"), "cnt"))),
        lambda x: F.struct(x["value"].alias("value"), x["cnt"].alias("cnt"))).alias("top_k"))
    drawn = sample_values(tables, sample, frequencies).groupBy("column_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("sample"))
    return profile(tables, frequencies).join(top, "column_id", "left").join(drawn, "column_id", "left")


def resolve_long_values(table: Table, column: str, found: DataFrame) -> DataFrame:
    """Full texts for frequency rows that carry a digest: look their first row up again (found: first_row, digest)."""
    source = table.df.select(table.row_column.alias("first_row"), F.col(f"`{column}`").alias("full_text"))
    return found.join(source, "first_row", "left")

