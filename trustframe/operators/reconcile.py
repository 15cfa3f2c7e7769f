"""Do summary reports agree with the records they summarise? Checked by matching numbers, not formulas."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.numbers import close_to
from ..functions.text import fold
from ..session import local_frame, materialize
from ..tables import Table, TableSet, kind_of
from .frequencies import LONG_TEXT, value_text
from .quality import text_columns, without_flagged

ALL = "__all__"


def report_rows(table: Table, labels: list[str], boxes: list | None = None) -> DataFrame:
    """(report_id, region_no, row_id, label_column, label_at, label, numbers): the rows of one report once for each of its
    label columns that matter, beside all their numbers. `boxes` are the regions of its sheet."""
    texts = dict(text_columns(table))
    at = {f.name: i for i, f in enumerate(table.fields)}
    label_structs = F.array(*[F.struct(F.lit(n).alias("label_column"), F.lit(at[n]).alias("label_at"), texts[n].alias("label")) for n in labels])
    numbers = [F.struct(F.lit(f.name).alias("number_column"), (F.col(f"`{f.name}`")["num"] if kind_of(f.dataType) == "mixed" else F.col(f"`{f.name}`")).cast("double").alias("value"))
               for f in table.fields if kind_of(f.dataType) in ("int", "real", "mixed")]
    number = F.lit(0)
    if boxes:
        number = F.lit(None).cast("int")
        for box in boxes:
            header = -1 if box.header_row is None else box.header_row
            hit = table.row_column.between(box.first_row, box.last_row) & (table.row_column != header)
            number = F.when(hit, box.region_no).otherwise(number)
    filled = F.filter(F.array(*numbers), lambda n: n["value"].isNotNull() & ~F.isnan(n["value"]))
    rows = table.df.select(F.lit(table.table_id).alias("report_id"), number.alias("region_no"), table.row_column.alias("row_id"),
                           F.explode(label_structs).alias("l"), filled.alias("numbers"))
    return rows.filter("region_no IS NOT NULL").select("report_id", "region_no", "row_id", "l.*", "numbers").filter("trim(label) <> ''")


def folded_hash(text: Column) -> Column:
    return F.xxhash64(fold(text))


def long_hashes(tables: TableSet, columns: list[tuple[str, int, str]]) -> DataFrame | None:
    """(column_no, h) of the long texts of some (table_id, column_no, name), whose frequencies hold a digest instead."""
    parts = []
    for table_id, number, name in columns:
        t = tables.table(table_id)
        c = dict(text_columns(t)).get(name, F.col(f"`{name}`").cast("string"))
        parts.append(t.df.filter(F.length(c) > LONG_TEXT).select(F.lit(number).alias("column_no"), folded_hash(c).alias("h")))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def label_matches(tables: TableSet, counts: dict[str, int], frequencies: DataFrame, roles: DataFrame, sources: list[str],
                  parted: set[str]) -> DataFrame:
    """(column_no, dim_no, hits, labels): text columns of possible reports beside dimensions of longer sources that hold two of
    their labels at least and LABEL_OVERLAP of them; of `parted` tables, whose regions are looked at one by one, two will do.

    Both sides come from the value frequencies, as hashes of folded texts, so no table is read here; but texts too long for
    the frequencies, which are read for the columns that could still match by them.
    """
    spark = tables.spark
    longest = max((counts.get(t, 0) for t in sources), default=0)
    reports = [t for t in tables.tables if V.MIN_REPORT_ROWS <= counts.get(t.table_id, 0) < longest
               and any(kind_of(f.dataType) in ("int", "real", "mixed") for f in t.fields)]
    columns = local_frame(spark, [(tables.number(t, n), t.table_id, n, counts[t.table_id], t.table_id in parted) for t in reports for n, _ in text_columns(t)],
                          "column_no int, report_id string, name string, report_rows long, parted boolean")
    dims = (roles.filter(~F.col("role").isin("money", "quantity", "percentage", "date", "free_text"))
            .filter((F.col("distinct_count") >= V.MIN_REPORT_DIM_DISTINCT) & F.col("table_id").isin(sources))
            .select("column_no", F.col("table_id").alias("source_id"), F.col("column_name").alias("dim"), "kind")
            .join(local_frame(spark, [(t, n) for t, n in counts.items()], "source_id string, source_rows long"), "source_id"))
    totals = F.array(*[fold(F.lit(w)) for w in V.REPORT_TOTAL_WORDS])
    short = frequencies.filter("digest IS NULL")
    labels = short.join(columns.select("column_no"), "column_no").filter("trim(value_s) <> ''").withColumn("folded", fold(F.col("value_s")))
    labels = labels.filter(~F.array_contains(totals, F.col("folded"))).select("column_no", F.xxhash64("folded").alias("h")).distinct()
    values = short.join(dims.select("column_no", "kind"), "column_no").select(F.col("column_no").alias("dim_no"), folded_hash(value_text(F.col("kind"))).alias("h")).distinct()

    def scored(labels: DataFrame, values: DataFrame) -> DataFrame:
        sizes = labels.groupBy("column_no").agg(F.count(F.lit(1)).alias("labels"))
        hits = labels.join(values, "h").groupBy("column_no", "dim_no").agg(F.count(F.lit(1)).alias("hits"))
        both = hits.join(columns, "column_no").join(dims.withColumnRenamed("column_no", "dim_no"), "dim_no")
        return both.filter("report_id <> source_id AND report_rows < source_rows").join(sizes, "column_no")

    def kept(frame: DataFrame, more_hits: Column, more_labels: Column) -> DataFrame:
        hits = F.col("hits") + more_hits
        return frame.filter((hits >= 2) & (F.col("parted") | (hits >= V.LABEL_OVERLAP * (F.col("labels") + more_labels))))

    long = frequencies.filter("digest IS NOT NULL").groupBy("column_no").agg(F.count(F.lit(1)).alias("n"))
    long_columns = {r["column_no"]: r for r in long.join(columns, "column_no").collect()}                       # a row per column with long texts
    long_dims = {r["column_no"]: r for r in long.join(dims, "column_no").collect()}
    if not long_columns:
        return kept(scored(labels, values), F.lit(0), F.lit(0))
    # optimistic: all long texts that both sides hold meet, and those of a report are one label
    known = local_frame(spark, [(c, r["n"]) for c, r in long_columns.items()], "column_no int, more_labels long")
    met = local_frame(spark, [(d, r["n"]) for d, r in long_dims.items()], "dim_no int, more_values long")
    open_ = scored(labels, values).join(known, "column_no", "left").join(met, "dim_no", "left")
    few = F.coalesce(F.least("more_labels", "more_values"), F.lit(0))
    maybe = kept(open_, F.when(F.col("more_values").isNull(), 0).otherwise(few), F.when(F.col("more_labels").isNull(), 0).otherwise(1))
    by_texts = [(c, d) for c, lab in long_columns.items() for d, dim in long_dims.items()
                if lab["report_id"] != dim["source_id"] and lab["report_rows"] < dim["source_rows"] and min(lab["n"], dim["n"]) > 0]
    left = {(r["column_no"], r["dim_no"]) for r in maybe.select("column_no", "dim_no").collect()} | set(by_texts)
    wanted = sorted({(long_columns[c]["report_id"], c, long_columns[c]["name"]) for c, _ in left if c in long_columns}
                    | {(long_dims[d]["source_id"], d, long_dims[d]["dim"]) for c, d in left if c in long_columns and d in long_dims})
    texts = long_hashes(tables, wanted)
    if texts is not None:
        total_hashes = F.array(*[folded_hash(F.lit(w)) for w in V.REPORT_TOTAL_WORDS])
        labels = labels.unionByName(texts.join(columns.select("column_no"), "column_no").filter(~F.array_contains(total_hashes, F.col("h")))).distinct()
        values = values.unionByName(texts.join(dims.select("column_no"), "column_no").withColumnRenamed("column_no", "dim_no")).distinct()
    pairs = local_frame(spark, sorted(left), "column_no int, dim_no int")
    return kept(scored(labels, values).join(pairs, ["column_no", "dim_no"], "left_semi"), F.lit(0), F.lit(0))


def source_series(table: Table, dims: list[tuple[int, str]], measures: list[str], flags: DataFrame) -> DataFrame:
    """(source_id, dim, dim_at, label, series): sums and counts (agg_at, agg, measure, expected) by folded label, plus the whole."""
    rows = without_flagged(table, flags)
    keys = [fold(F.col(f"`{d}`").cast("string")).alias(f"k{i}") for i, (_, d) in enumerate(dims)]
    base = rows.select(*keys, *[F.col(f"`{m}`").cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    aggs = [F.coalesce(F.sum(f"m{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(measures))] + [
        F.count(F.lit(1)).cast("double").alias("c")]
    columns = [F.col(f"k{i}") for i in range(len(dims))]
    grouped = base.groupingSets([[], *[[c] for c in columns]], *columns).agg(F.grouping_id().alias("gid"), *aggs)
    full = (1 << len(dims)) - 1
    series = [F.struct(F.lit(i).alias("agg_at"), F.lit("SUM").alias("agg"), F.lit(m).alias("measure"), F.col(f"s{i}").alias("expected"))
              for i, m in enumerate(measures)]
    series.append(F.struct(F.lit(len(measures)).alias("agg_at"), F.lit("COUNT").alias("agg"), F.lit("*").alias("measure"),
                           F.col("c").alias("expected")))
    spots = []
    for i, (at, d) in enumerate(dims):
        mine = F.col("gid") == (full & ~(1 << (len(dims) - 1 - i)))
        label = F.when(mine, F.col(f"k{i}")).when(F.col("gid") == full, F.lit(ALL))
        spots.append(F.when(label.isNotNull(), F.struct(F.lit(d).alias("dim"), F.lit(at).alias("dim_at"), label.alias("label"))))
    exploded = grouped.select(F.explode(F.array_compact(F.array(*spots))).alias("d"), F.array(*series).alias("series"))
    return exploded.select(F.lit(table.table_id).alias("source_id"), "d.*", "series")


def reconcile(tables: TableSet, profiles: DataFrame, frequencies: DataFrame, roles: DataFrame, sources: list[str],
              flags: DataFrame, lineage: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Best explanation per report column: which sum or count of which source it repeats, and where it differs.

    Labels meet dimensions in the value frequencies, so only reports with a match are read, and only their matching
    label columns; only dimensions that hold them are aggregated. `sources` are the table ids with computed key numbers;
    `lineage` (table_id, target_table_id) narrows them.
    """
    spark = tables.spark
    counts = {r.table_id: r.row_count for r in profiles.groupBy("table_id").agg(F.max("row_count").alias("row_count")).collect()}
    boxes: dict[str, list] = {}
    if regions is not None:                                 # a handful of boxes per sheet
        for r in regions.filter(F.col("kind") == "table").select("table_id", "region_no", "first_row", "last_row", "header_row").collect():
            boxes.setdefault(r.table_id, []).append(r)
    parted = {t for t, found in boxes.items() if len(found) >= 2}
    likely = label_matches(tables, counts, frequencies, roles, sources, parted).collect()       # pairs of columns: metadata
    if lineage is not None and likely:
        linked = {(r.table_id, r.target_table_id) for r in lineage.filter("target_table_id IS NOT NULL").select("table_id", "target_table_id").distinct().join(
            local_frame(spark, sorted({(r.report_id,) for r in likely}), "table_id string"), "table_id", "left_semi").collect()}
        narrowed = {r.report_id for r in likely if (r.report_id, r.source_id) in linked}
        likely = [r for r in likely if r.report_id not in narrowed or (r.report_id, r.source_id) in linked]
    if not likely:
        return _empty(tables)
    place = {(t.table_id, f.name): i for t in tables.tables for i, f in enumerate(t.fields)}
    matches = sorted({(r.report_id, r.name, place[r.report_id, r.name], r.source_id, r.dim, place[r.source_id, r.dim]) for r in likely})
    parts = []
    for report_id, group in groupby(matches, key=lambda m: m[0]):
        names = sorted({m[1] for m in group}, key=lambda n: place[report_id, n])
        parts.append(report_rows(tables.table(report_id), names, boxes.get(report_id) if report_id in parted else None))
    totals = F.array(*[fold(F.lit(w)) for w in V.REPORT_TOTAL_WORDS])
    report = reduce(DataFrame.unionByName, parts).withColumn("folded", fold(F.col("label")))
    report = report.withColumn("is_total", F.array_contains(totals, F.col("folded")))
    columns = ["report_id", "region_no", "label_column", "label_at"]
    match = local_frame(spark, matches, "report_id string, label_column string, label_at int, source_id string, dim string, dim_at int")
    measures = roles.filter(F.col("role").isin("money", "quantity") & F.col("sql_type").isin("INTEGER", "REAL")).select(
        "table_id", "position", "column_name").collect()
    wanted = sorted({(source_id, dim_at, dim) for *_, source_id, dim, dim_at in matches})
    series_parts = []
    for source_id, group in groupby(wanted, key=lambda x: x[0]):
        mine = [m.column_name for m in sorted(measures, key=lambda m: m.position) if m.table_id == source_id]
        series_parts.append(source_series(tables.table(source_id), [(at, d) for _, at, d in group], mine, flags))
    series = reduce(DataFrame.unionByName, series_parts)
    if parted & {m[0] for m in matches}:                    # within each region the same rule as for whole tables
        series = materialize(series, "series")
        texts = report.filter("NOT is_total").select(*columns, "folded").distinct()
        hits = texts.join(match, columns[:1] + columns[2:]).join(series.select("source_id", "dim", "dim_at", F.col("label").alias("folded")), ["source_id", "dim", "dim_at", "folded"])
        hits = hits.groupBy(*columns, "source_id", "dim", "dim_at").agg(F.count(F.lit(1)).alias("hits"))
        held = hits.join(texts.groupBy(*columns).agg(F.count(F.lit(1)).alias("labels")), columns).filter((F.col("hits") >= 2) & (F.col("hits") >= V.LABEL_OVERLAP * F.col("labels")))
        match = held.select(*columns, "source_id", "dim", "dim_at")
    wanted_label = F.when(F.col("is_total"), F.lit(ALL)).otherwise(F.col("folded"))
    met = materialize(report.join(match, [c for c in columns if c in match.columns]).withColumn("wanted", wanted_label)
                      .join(series.withColumnRenamed("label", "wanted"), ["source_id", "dim", "dim_at", "wanted"])
                      .select(*columns, "source_id", "dim", "dim_at", "row_id", "label", "numbers", "series"), "compared")
    each = met.withColumn("n", F.explode("numbers")).withColumn("s", F.explode("series")).select(
        *columns, "source_id", "dim", "dim_at", "row_id", "label", "n.*", "s.*")
    compared = each.withColumn("ok", close_to(F.col("value"), F.col("expected")))
    best_keys = ["report_id", "region_no", "number_column"]
    option = [*columns, "number_column", "source_id", "dim", "dim_at", "agg_at", "agg", "measure"]
    miss = F.struct("row_id", "label", F.col("value").alias("report"), F.round("expected", 6).alias("data"))
    scored = compared.groupBy(*option).agg(F.count(F.lit(1)).alias("compared"), F.count_if("ok").alias("matched"))
    good = scored.filter((F.col("compared") >= 2) & (F.col("matched") >= V.MATCH_SHARE * F.col("compared")))
    order = F.struct((-F.col("matched")).alias("a"), "source_id", "dim_at", "label_at", "agg_at")
    chosen_by = ["label_column", "label_at", "source_id", "dim", "dim_at", "agg_at", "agg", "measure"]
    best = good.groupBy(*best_keys).agg(F.min_by(F.struct(*chosen_by, "compared", "matched"), order).alias("b")).select(*best_keys, "b.*")
    # of a report of any length the first ten differences, cut per task before they meet
    missed = compared.filter("NOT ok").join(best.select(*best_keys, *chosen_by), [*best_keys, *chosen_by], "left_semi").select(*best_keys, miss.alias("m"))
    first = missed.withColumn("_n", F.row_number().over(Window.partitionBy(*best_keys).orderBy("m"))).filter("_n <= 10")
    shown = first.groupBy(*best_keys).agg(F.array_sort(F.collect_list("m")).alias("mismatches"))
    best = best.join(shown, best_keys, "left").withColumn("mismatches", F.coalesce("mismatches", F.array().cast(shown.schema["mismatches"].dataType)))
    best = best.select(*best_keys, "label_column", "source_id", "dim", "agg", "measure", "compared", "matched", "mismatches")
    return best.withColumn("status", F.when(F.col("matched") == F.col("compared"), "reconciled").otherwise("partial"))


def _empty(tables: TableSet) -> DataFrame:
    return tables.spark.createDataFrame([], "report_id string, region_no int, number_column string, label_column string, "
                                            "source_id string, dim string, agg string, measure string, compared long, matched long, "
                                            "mismatches array<struct<row_id: long, label: string, report: double, data: double>>, "
                                            "status string")
