"""What tables and columns mean: table kind, column roles, grain, time coverage, draft definitions, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.names import has_word, name_currency, name_unit, stable_id
from ..session import local_frame
from ..tables import TableSet
from .frequencies import value_frequencies, value_text
from .profile import profile
from .rows import all_row_hash_counts, overlap_ratios


def _verdict(label: str, confidence: float, *reasons: Column | str) -> Column:
    texts = [F.lit(r) if isinstance(r, str) else r for r in reasons]
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.array(*texts).alias("reasons"))


def column_roles(tables: TableSet, profiles: DataFrame | None = None, frequencies: DataFrame | None = None,
                 declared: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """One role per column by fixed priority; roles declared by the user are `confirmed` and win."""
    frequencies = value_frequencies(tables) if frequencies is None else frequencies
    profiles = profile(tables, frequencies) if profiles is None else profiles
    kinds = tables.columns().select("column_no", "kind")
    truthy = F.lower(F.trim(value_text(F.col("kind")))).isin(V.BOOLEAN_TOKENS)
    boolean = frequencies.join(kinds, "column_no").groupBy("column_no").agg(F.bool_and(truthy).alias("boolean_like"))
    rows = profiles.join(boolean, "column_no", "left").fillna(False, ["boolean_like"])

    name, kind, sql_type = F.col("column_name"), F.col("kind"), F.col("sql_type")
    filled = F.greatest(F.lit(1), F.col("n"))
    uniq = F.col("distinct_count") / filled
    share = F.concat(F.round(uniq * 100).cast("int").cast("string"), F.lit("% unique"))
    many = filled > 1
    numeric, textual = sql_type.isin("INTEGER", "REAL"), sql_type.isin("TEXT", "BLOB")
    names_id = has_word(name, V.IDENTIFIER_WORDS)
    distinct_text = F.concat(F.col("distinct_count").cast("string"), F.lit(" distinct value(s) over "),
                             filled.cast("string"), F.lit(" row(s)"))
    two_booleans = (F.col("distinct_count") > 0) & (F.col("distinct_count") <= 2) & F.col("boolean_like")
    verdict = (
        F.when(kind.isin("date", "datetime", "time"), _verdict("date", 0.95, F.concat(F.lit("typed "), kind)))
        .when((kind == "bool") | two_booleans, _verdict("boolean", 0.8, "at most two values, all boolean-like"))
        .when((uniq >= 0.9) & many & names_id, _verdict("identifier", 0.9, share, "name suggests an identifier"))
        .when(numeric & names_id, _verdict("code", 0.6, "number whose name suggests a reference"))
        .when(numeric & has_word(name, V.MONEY_WORDS), _verdict("money", 0.75, "name suggests an amount of money"))
        .when(numeric & has_word(name, V.PERCENT_WORDS), _verdict("percentage", 0.7, "name suggests a rate"))
        .when(numeric & has_word(name, V.QUANTITY_WORDS), _verdict("quantity", 0.65, "name suggests a count"))
        .when(numeric & (uniq >= 0.98) & many, _verdict("identifier", 0.5, share, "no telling name"))
        .when(numeric, _verdict("quantity", 0.3, "number without a telling name"))
        .when(textual & has_word(name, V.CONTACT_WORDS), _verdict("contact", 0.7, "name suggests contact data"))
        .when(textual & has_word(name, V.GEO_WORDS), _verdict("geo", 0.7, "name suggests a place"))
        .when(textual & names_id, _verdict("code", 0.55, "text whose name suggests a code"))
        .when(textual & (uniq <= 0.5) & (F.col("distinct_count") <= 50), _verdict("category", 0.6, distinct_text))
        .when(textual & (uniq >= 0.98) & many, _verdict("identifier", 0.4, share, "no telling name"))
        .when(textual & (uniq >= 0.7), _verdict("free_text", 0.5, share))
        .otherwise(_verdict("unknown", 0.0, "no rule matched")))
    rows = rows.withColumn("v", verdict)
    pairs = [(tables.table(t).table_id, c, role) for (t, c), role in (declared or {}).items()]
    given = local_frame(tables.spark, pairs, "table_id string, column_name string, declared_role string")
    rows = rows.join(given, ["table_id", "column_name"], "left")
    confirmed = F.col("declared_role").isNotNull()
    return rows.select(
        "column_no", "column_id", "table_id", "table_name", "column_name", "position", "kind", "sql_type", "n",
        "distinct_count", F.coalesce("declared_role", "v.label").alias("role"),
        F.when(confirmed, F.lit(1.0)).otherwise(F.col("v.confidence")).alias("confidence"),
        F.when(confirmed, "declared").otherwise("heuristic").alias("method"),
        F.when(confirmed, F.array(F.lit("declared"))).otherwise(F.col("v.reasons")).alias("reasons"),
        F.when(confirmed, "confirmed").otherwise("inferred").alias("status"),
        name_unit(name).alias("unit"), name_currency(name).alias("currency"))


def table_kinds(tables: TableSet, profiles: DataFrame, flags: DataFrame) -> DataFrame:
    """empty, notes, dashboard, report or data, each with a confidence and its reason."""
    counts = profiles.groupBy("table_id").agg(F.max("row_count").alias("row_count"))
    totals = flags.select("table_id").distinct().withColumn("has_totals", F.lit(True))
    rows = (tables.catalog().join(counts, "table_id", "left").join(totals, "table_id", "left")
            .fillna(False, ["has_totals"]).fillna(0, ["row_count"]))
    cells = F.col("row_count") * F.col("column_count")
    formulas = F.coalesce(F.try_divide(F.col("formula_cells").cast("double"), cells), F.lit(0.0))
    no_header = F.col("header_row").isNull()
    verdict = (
        F.when(F.col("row_count") == 0, _verdict("empty", 1.0, "no data rows"))
        .when(no_header & (F.col("row_count") <= 20) & (F.col("column_count") <= 4),
              _verdict("notes", 0.6, "small and without a header"))
        .when(F.col("pivot_tables") > 0, _verdict("dashboard", 0.6, "pivot tables on this sheet"))
        .when(formulas >= 0.3, _verdict("report", 0.5, "many cells are formulas"))
        .when(F.col("has_totals") & (F.col("row_count") <= 50), _verdict("report", 0.4, "small, with a total row"))
        .when(no_header, _verdict("data", 0.4, "data rows without a detected header"))
        .otherwise(_verdict("data", 0.7, "data rows below a header, few formulas")))
    return rows.withColumn("v", verdict).select(
        "table_id", "table_name", "row_count", F.col("v.label").alias("table_kind"),
        F.col("v.confidence").alias("confidence"), F.lit("heuristic").alias("method"), F.col("v.reasons").alias("reasons"),
        F.lit("inferred").alias("status"))


def table_grain(tables: TableSet, keys: DataFrame) -> DataFrame:
    """What one row stands for: the best key of each table, or `unknown` stated plainly."""
    first = tables.columns().select(F.col("column_id").alias("first_column"), "position")
    ranked = keys.withColumn("first_column", F.col("columns")[0]).join(first, "first_column")
    order = F.struct((F.col("status") != "confirmed").cast("int"), -F.col("score"), "position", "key_id")
    best = ranked.groupBy("table_id").agg(F.min_by(F.struct("columns", "column_names", "uniqueness", "status", "method"),
                                                   order).alias("k"))
    rows = tables.catalog().select("table_id", "table_name").join(best, "table_id", "left")
    known = F.coalesce(F.col("k.uniqueness"), F.lit(0.0)) >= V.GRAIN_UNIQUENESS
    label = F.array_join("k.column_names", " + ")
    percent = F.concat(F.round(F.col("k.uniqueness") * 100).cast("int").cast("string"), F.lit("% unique"))
    return rows.select(
        "table_id", "table_name", F.when(known, label).alias("columns"),
        F.when(known, F.concat(F.lit("one row per "), "table_name", F.lit(", identified by "), label, F.lit(" ("),
                               F.col("k.status"), F.lit(", "), percent, F.lit(")")))
        .otherwise(F.concat(F.lit("grain of '"), "table_name", F.lit("' not confirmed: no column or pair identifies a row")))
        .alias("description"),
        F.when(known, F.col("k.status")).otherwise("unknown").alias("status"),
        F.when(known, F.col("k.uniqueness")).otherwise(0.0).alias("confidence"),
        F.when(known, F.col("k.method")).otherwise("none").alias("method"))


def time_coverage(profiles: DataFrame) -> DataFrame:
    return profiles.filter("kind IN ('date', 'datetime', 'time') AND min_value IS NOT NULL").select(
        "table_id", "table_name", "column_id", "column_name", "min_value", "max_value")


def definitions(tables: TableSet, profiles: DataFrame, roles: DataFrame, grain: DataFrame) -> DataFrame:
    """Draft dictionary entries for tables and for columns whose name carries a unit."""
    spans = time_coverage(profiles).groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("min_value", F.lit(" to "), "max_value"))), "; ").alias("spans"))
    counts = profiles.groupBy("table_id").agg(F.max("row_count").alias("row_count"))
    of_tables = (grain.join(tables.catalog().select("table_id", "source_id"), "table_id").join(counts, "table_id", "left")
                 .join(spans, "table_id", "left"))
    text = F.concat_ws(". ", F.format_string("'%s' (%s): %d row(s)", "table_name", "source_id", "row_count"), "description",
                       F.concat(F.lit("time coverage: "), "spans"))
    drafted = of_tables.select(F.col("table_name").alias("term"), F.concat(text, F.lit(".")).alias("meaning"),
                               F.lit(None).cast("string").alias("unit"), F.col("table_id").alias("applies_to"))
    units = roles.filter(F.col("role").isin("money", "quantity", "percentage") & F.col("unit").isNotNull())
    in_currency = F.when(F.col("currency").isNotNull(), F.concat(F.lit(" in "), "currency")).otherwise("")
    of_columns = units.select(F.col("column_name").alias("term"), F.concat("role", F.lit(" column"), in_currency).alias("meaning"),
                              F.coalesce("currency", "unit").alias("unit"), F.col("column_id").alias("applies_to"))
    return drafted.unionByName(of_columns).select("*", F.lit("inferred").alias("status"), F.lit("auto").alias("origin"))


def duplicate_tables(tables: TableSet, hash_counts: DataFrame | None = None) -> DataFrame:
    """Tables of different sources with the same schema, scored by the rows they share."""
    hash_counts = all_row_hash_counts(tables) if hash_counts is None else hash_counts
    one = tables.catalog().select("schema_fingerprint", "table_id", "source_id")
    a = one.select("schema_fingerprint", *[F.col(c).alias(f"{c}_a") for c in ("table_id", "source_id")])
    b = one.select("schema_fingerprint", *[F.col(c).alias(f"{c}_b") for c in ("table_id", "source_id")])
    pairs = a.join(b, "schema_fingerprint").filter("source_id_a <> source_id_b AND table_id_a < table_id_b")
    pairs = pairs.select("table_id_a", "table_id_b", "schema_fingerprint")
    scored = overlap_ratios(pairs.select("table_id_a", "table_id_b"), hash_counts)
    return pairs.join(scored, ["table_id_a", "table_id_b"]).select(
        stable_id(F.col("table_id_a"), F.col("table_id_b"), F.lit("schema_fingerprint")).alias("duplicate_id"),
        "table_id_a", "table_id_b", F.lit("schema_fingerprint").alias("method"), (0.5 + 0.5 * F.col("overlap")).alias("score"),
        "overlap", F.lit("inferred").alias("status"))
