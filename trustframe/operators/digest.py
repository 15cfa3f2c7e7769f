"""Key numbers of every data table: totals, biggest groups and the monthly trend, each with the SQL that repeats it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.dates import month_key
from ..functions.names import is_additive
from ..session import local_frame
from ..tables import Table, TableSet
from .quality import without_flagged

DIGEST = ("table_id string, section string, measure string, dim string, key string, value double, rows long, share double, "
          "rank int, sql string")
DIM_ORDER = {"category": 0, "geo": 1, "code": 2, "boolean": 3}


@dataclass(frozen=True)
class Limits:
    """How much of a table is summarised; None: all of it. A dimension has between `groups` distinct values."""

    measures: int | None = V.MAX_MEASURES
    dimensions: int | None = V.MAX_DIMENSIONS
    groups: tuple[int, int | None] = (2, 50)


@dataclass(frozen=True)
class Choice:
    """What is summarised for one table, or why nothing is, and which columns its limits leave out."""

    table: Table
    measures: list[tuple[str, bool, str | None]]      # name, additive, unit
    dims: list[str]
    date: str | None
    skipped: str | None
    left_out: tuple[str, ...] = ()

    @property
    def primary(self) -> str | None:
        return next((name for name, additive, _ in self.measures if additive), None)


def ranked_columns(roles: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(table_id, use, place, column_name, additive, unit, why): measures, dimensions and dates in order of use; `why` says which
    limit leaves a column out."""
    name, role = F.col("column_name"), F.col("role")
    numeric = F.col("sql_type").isin("INTEGER", "REAL")
    measure = numeric & role.isin("money", "quantity")
    least, most = limits.groups
    dim = ~measure & role.isin(*DIM_ORDER) & (F.col("distinct_count") >= least) & (F.col("n") > 0)
    many = dim & (F.col("distinct_count") > most) if most else F.lit(False)
    date = (role == "date") & F.col("kind").isin("date", "datetime")
    rank = F.when(role == "money", 0).when(F.col("confidence") >= 0.6, 1).otherwise(2) + F.when(is_additive(name), 0).otherwise(3)
    dim_rank = F.lit(9)
    for label, at in DIM_ORDER.items():
        dim_rank = F.when(role == label, at).otherwise(dim_rank)
    use = F.when(measure, "measure").when(dim, "dim").when(date, "date")
    order = F.struct(F.when(measure, rank).when(dim, dim_rank).otherwise(0).alias("a"),
                     F.when(measure, F.col("position").cast("long")).otherwise(-F.col("n")).alias("b"), name.alias("c"))
    used = roles.withColumn("use", use).withColumn("many", many).filter("use IS NOT NULL").withColumn("place", F.row_number().over(
        Window.partitionBy("table_id", "use", "many").orderBy(order)))
    keep = F.when(F.col("use") == "measure", limits.measures).when(F.col("use") == "dim", limits.dimensions).otherwise(1)
    why = (F.when(F.col("many"), F.concat(F.lit("dimension of "), F.col("distinct_count").cast("string"), F.lit(" groups")))
           .when(F.col("place") > keep, F.concat("use", F.lit(" number "), F.col("place").cast("string"))))
    return used.select("table_id", "use", "place", "column_name", is_additive(name).alias("additive"), F.coalesce("currency", "unit").alias("unit"), why.alias("why"))


def choose(tables: TableSet, roles: DataFrame, kinds: DataFrame, regions: dict[str, int] | None = None, limits: Limits = Limits()) -> list[Choice]:
    """Column choices per table. They name a few columns each: metadata, read to the driver to build the plans."""
    ranked = ranked_columns(roles, limits).collect()
    picked = [r for r in ranked if r.why is None]
    kind = {r.table_id: r for r in kinds.select("table_id", "table_kind", "row_count").collect()}
    out = []
    for t in tables.tables:
        mine = sorted((r for r in picked if r.table_id == t.table_id), key=lambda r: r.place)
        measures = [(r.column_name, r.additive, r.unit) for r in mine if r.use == "measure"]
        dims = [r.column_name for r in mine if r.use == "dim"]
        date = next((r.column_name for r in mine if r.use == "date"), None)
        k = kind.get(t.table_id)
        if k is None or not k.row_count:
            why = "no data rows"
        elif k.table_kind != "data":
            why = f"looks like a {k.table_kind}, not one table of records; totals would mislead"
        elif (regions or {}).get(t.table_id, 0) > 1:
            why = "holds several tables; summarise each region instead"
        elif not (measures or dims or date):
            why = "no amount, category or date column recognised"
        else:
            why = None
        out.append(Choice(t, measures, dims, date, why, tuple(sorted(f"{r.column_name}: {r.why}" for r in ranked if r.why and r.table_id == t.table_id))))
    return out


def choices_frame(tables: TableSet, choices: list[Choice]) -> DataFrame:
    rows = [(c.table.table_id, c.table.name, "skipped" if c.skipped else "computed", c.skipped, [m for m, _, _ in c.measures],
             c.dims, c.date, list(c.left_out)) for c in choices]
    return local_frame(tables.spark, rows, "table_id string, table_name string, status string, reason string, "
                                           "measures array<string>, dims array<string>, date_column string, left_out array<string>")


def sum_rows(choice: Choice, flags: DataFrame) -> DataFrame:
    """Rows whose amount equals the sum of all other rows: grand totals, whatever their label says.

    All measures are tested in one aggregate. A hit hides its row and the remaining measures are tested again, so there
    are at most as many passes as measures (four) and one pass when nothing is found.
    """
    t = choice.table
    names = [f.name for f in t.fields]
    empties = reduce(lambda a, b: a + b, [F.col(f"`{n}`").isNull().cast("int") for n in names])
    wanted = [m for m, additive, _ in choice.measures if additive]
    found: list[tuple[int, str]] = []
    while wanted:
        rows = without_flagged(t, flags).withColumn("_row", t.row_column).withColumn("_empty", empties)
        if found:
            rows = rows.filter(~F.col("_row").isin([r for r, _ in found]))
        aggs = []
        for i, m in enumerate(wanted):
            c = F.col(f"`{m}`").cast("double")
            at = F.when(c.isNotNull(), F.struct(c.alias("v"), (-F.col("_row")).alias("r")))
            aggs += [F.max_by(F.struct("_row", "_empty"), at).alias(f"top{i}"), F.max(c).alias(f"max{i}"),
                     F.sum(c).alias(f"sum{i}"), F.count(c).alias(f"n{i}")]
        one = rows.agg(*aggs).first()
        hit = None
        for i, m in enumerate(wanted):
            top, most, total, n = one[f"top{i}"], one[f"max{i}"], one[f"sum{i}"], one[f"n{i}"]
            if most and most > 0 and n >= 3 and abs(most - (total - most)) <= 0.005 * abs(most) \
                    and top["_empty"] * 2 >= max(1, len(names)):
                hit = i
                found.append((top["_row"], f"{m} equals the sum of all other rows"))
                break
        wanted = [] if hit is None else wanted[hit + 1:]
    rows = [(t.table_id, r, "totals_candidate", why) for r, why in found]
    return local_frame(t.df.sparkSession, rows, "table_id string, row_id long, flag string, detail string")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("(blank)"))


def table_digest(choice: Choice, flags: DataFrame, months: int | None = V.MAX_MONTHS) -> DataFrame:
    """All numbers of one table from one pass: GROUPING SETS over nothing, each dimension and the month.

    Every set has few groups (a dimension has at most fifty values), so partial aggregation leaves almost nothing to
    shuffle and the ranking windows see a few hundred rows. `months` newest months are shown, all if None.
    """
    t, primary = choice.table, choice.primary
    rows = without_flagged(t, flags)
    month = month_key(F.col(f"`{choice.date}`")) if choice.date else F.lit(None).cast("string")
    columns = [_text(F.col(f"`{d}`")).alias(f"d{i}") for i, d in enumerate(choice.dims)]
    base = rows.select(*columns, month.alias("month"),
                       *[F.col(f"`{m}`").cast("double").alias(f"m{i}") for i, (m, _, _) in enumerate(choice.measures)])
    at = next((i for i, (m, _, _) in enumerate(choice.measures) if m == primary), None)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(choice.measures)):
        c = F.col(f"m{i}")
        aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"sum{i}"), F.avg(c).alias(f"avg{i}"), F.min(c).alias(f"min{i}"),
                 F.max(c).alias(f"max{i}"), F.count(c).alias(f"n{i}")]
    sets = [[], *[[F.col(f"d{i}")] for i in range(len(choice.dims))]]
    keys = [F.col(f"d{i}") for i in range(len(choice.dims))]
    if choice.date:
        sets.append([F.col("month")])
        keys.append(F.col("month"))
    if keys:
        grouped = base.groupingSets(sets, *keys).agg(F.grouping_id().alias("gid"), *aggs)
        full = (1 << len(keys)) - 1
    else:
        grouped, full = base.agg(*aggs).withColumn("gid", F.lit(0)), 0

    view = f"`{t.name}`"
    entries = [F.struct(F.lit("*").alias("measure"), F.lit("rows").alias("key"), F.col("rows").cast("double").alias("value"),
                        F.col("rows"), F.lit(f"SELECT count(*) FROM {view}").alias("sql"))]
    for i, (m, additive, _) in enumerate(choice.measures):
        for fn in (["sum"] if additive else []) + ["avg", "min", "max"]:
            entries.append(F.struct(F.lit(m).alias("measure"), F.lit(fn).alias("key"), F.col(f"{fn}{i}").alias("value"),
                                    F.col(f"n{i}").alias("rows"), F.lit(f"SELECT {fn}(`{m}`) FROM {view}").alias("sql")))
    totals = grouped.filter(F.col("gid") == full).select(F.explode(F.array(*entries)).alias("e")).select(
        F.lit("total").alias("section"), "e.measure", F.lit(None).cast("string").alias("dim"), "e.key", "e.value", "e.rows",
        F.lit(None).cast("double").alias("share"), F.lit(None).cast("int").alias("rank"), "e.sql")

    value = F.col(f"sum{at}") if at is not None else F.col("rows").cast("double")
    agg_sql = f"sum(`{primary}`)" if primary else "count(*)"
    which, label, sql = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(choice.dims):
        mine = F.col("gid") == (full & ~(1 << (len(keys) - 1 - i)))
        which, label = F.when(mine, d).otherwise(which), F.when(mine, F.col(f"d{i}")).otherwise(label)
        sql = F.when(mine, f"SELECT `{d}`, {agg_sql} AS v, count(*) FROM {view} GROUP BY `{d}` ORDER BY v DESC, `{d}`").otherwise(sql)
    groups = grouped.select(F.lit("by_group").alias("section"), F.lit(primary or "*").alias("measure"), which.alias("dim"),
                            label.alias("key"), value.alias("value"), "rows", sql.alias("sql"), "gid")
    whole = Window.partitionBy("section")
    groups = groups.withColumn("base", F.max(F.when(F.col("gid") == full, F.col("value"))).over(whole)).filter("dim IS NOT NULL")
    blank_first = (F.col("key") != "(blank)").cast("int")
    per_dim = Window.partitionBy("dim")
    ranked = (groups.withColumn("rank", F.row_number().over(per_dim.orderBy(F.desc("value"), blank_first, "key")))
              .withColumn("groups", F.count(F.lit(1)).over(per_dim)))
    share = F.try_divide(F.col("value"), F.col("base"))
    top = ranked.filter(F.col("rank") <= V.TOP_GROUPS).select("section", "measure", "dim", "key", "value", "rows",
                                                              share.alias("share"), "rank", "sql")
    rest = ranked.filter(F.col("groups") > V.TOP_GROUPS).groupBy("section", "measure", "dim", "sql").agg(
        F.max("groups").alias("groups"), F.max("base").alias("base"),
        F.sum(F.when(F.col("rank") <= V.TOP_GROUPS, F.col("value"))).alias("shown"))
    rest_value = F.coalesce("base", F.lit(0.0)) - F.col("shown")
    rest = rest.select("section", "measure", "dim",
                       F.format_string("(other %d groups)", F.col("groups") - V.TOP_GROUPS).alias("key"),
                       rest_value.alias("value"), F.lit(None).cast("long").alias("rows"),
                       F.try_divide(rest_value, F.col("base")).alias("share"), F.lit(V.TOP_GROUPS + 1).alias("rank"), "sql")

    out = totals.unionByName(top).unionByName(rest)
    if choice.date:
        monthly = grouped.filter((F.col("gid") == (full & ~1)) & F.col("month").isNotNull())
        series = monthly.select(F.lit("by_month").alias("section"), F.lit(primary or "*").alias("measure"),
                                F.lit(choice.date).alias("dim"), F.col("month").alias("key"), value.alias("value"), "rows")
        newest = Window.partitionBy("section").orderBy(F.desc("key"))
        oldest = Window.partitionBy("section").orderBy("key")
        if months is not None:
            series = series.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= months)
        month_sql = f"SELECT date_format(`{choice.date}`, 'yyyy-MM') AS month, {agg_sql}, count(*) FROM {view} GROUP BY month ORDER BY month"
        out = out.unionByName(series.withColumn("rank", F.row_number().over(oldest)).select(
            "section", "measure", "dim", "key", "value", "rows", F.lit(None).cast("double").alias("share"), "rank",
            F.lit(month_sql).alias("sql")))
    return out.select(F.lit(t.table_id).alias("table_id"), "*")


def digest(choices: list[Choice], flags: DataFrame, months: int | None = V.MAX_MONTHS) -> DataFrame:
    parts = [table_digest(c, flags, months) for c in choices if not c.skipped]
    if not parts:
        return flags.sparkSession.createDataFrame([], DIGEST)
    return reduce(DataFrame.unionByName, parts)


def aggregate(table: Table, column: str, op: str = "count", group_by: str | None = None) -> DataFrame:
    """One aggregate of one column, optionally by another column, largest first. All stored rows take part."""
    functions = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    names = {f.name for f in table.fields}
    if op.lower() not in functions:
        raise ValueError(f"aggregate not allowed: {op}")
    if column == "*" and op.lower() != "count":
        raise ValueError(f"op '{op}' needs a column, not '*'")
    for c in (column, group_by):
        if c not in names | {"*", None}:
            raise ValueError(f"column not found: {c}")
    value = (F.count(F.lit(1)) if column == "*" else functions[op.lower()](F.col(f"`{column}`"))).alias("value")
    if group_by is None:
        return table.df.agg(value)
    return table.df.groupBy(F.col(f"`{group_by}`")).agg(value).orderBy(F.desc_nulls_last("value"), F.asc_nulls_first(group_by))


