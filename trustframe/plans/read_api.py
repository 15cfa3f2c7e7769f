"""Bounded reads for people and programs: small results, each with what was cut and where it came from."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import digest as D, find as W, repair
from ..operators.admission import SqlRefused
from ..operators.profile import profile_with_examples
from ..operators.quality import severity_rank
from ..session import local_frame
from ..sources.views import Views
from .facts import Facts

MAX_ROWS = 50
MAX_BYTES = 8192


@dataclass
class Result:
    tool: str
    columns: list[str]
    rows: list[list]
    truncated: bool
    total: int | None
    bytes: int
    elapsed_ms: float
    hint: str = ""
    evidence: dict = field(default_factory=dict)


def sized_rows(df: DataFrame, rows: int = MAX_ROWS) -> DataFrame:
    """The first rows + 1 rows with their number `_no` and the JSON bytes `_bytes` up to and including each."""
    head = df.limit(rows + 1).withColumn("_at", F.monotonically_increasing_id())
    order = Window.partitionBy(F.lit(0)).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    length = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})) + 2
    return head.withColumn("_bytes", F.sum(length).over(order)).withColumn("_no", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy("_at"))).drop("_at")


def capped(df: DataFrame, rows: int = MAX_ROWS, size: int = MAX_BYTES) -> DataFrame:
    """What a bounded read shows: it stops at the first row that would exceed the rows or the bytes."""
    return sized_rows(df, rows).filter((F.col("_no") <= rows) & (F.col("_bytes") <= size)).select(*df.columns)


class TimedOut(RuntimeError):
    """A bounded read took longer than it may."""


def _within(spark: SparkSession, seconds: float | None, read):
    """What `read` returns; its jobs are cancelled, and TimedOut raised, after `seconds`."""
    if seconds is None:
        return read()
    tag, late = f"bounded-read-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(tag, "bounded read", interruptOnCancel=True)
    timer.start()
    try:
        return read()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"stopped after {seconds:g} seconds") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(name, None)


def result(tool: str, df: DataFrame, rows: int = MAX_ROWS, size: int = MAX_BYTES, hint: str = "", total: bool = False, seconds: float | None = None,
           **evidence) -> Result:
    """The envelope of a bounded read. `total`: also count what was cut (a second run of the plan, only if rows were cut);
    `seconds`: how long it may take."""
    started = time.perf_counter()

    def read() -> tuple:
        got = sized_rows(df, rows).orderBy("_no").collect()
        return got, len(got) if len(got) <= rows else df.count() if total else None

    got, count = _within(df.sparkSession, seconds, read)
    kept = [r for r in got if r["_no"] <= rows and r["_bytes"] <= size]
    values = [[r[c] for c in df.columns] for r in kept]
    return Result(tool, df.columns, values, len(kept) < len(got), count, kept[-1]["_bytes"] if kept else 0,
                  round((time.perf_counter() - started) * 1000, 2), hint, evidence)


def envelopes(spark: SparkSession, results: list[Result]) -> DataFrame:
    """One row per result: tool, columns, rows as JSON, row_count, total_rows, truncated, bytes, hint and evidence."""
    return local_frame(spark, [(r.tool, r.columns, [json.dumps(v, ensure_ascii=False, default=str) for v in r.rows], len(r.rows), r.total, r.truncated,
                                r.bytes, r.hint, [(k, str(v)) for k, v in r.evidence.items()]) for r in results],
                       "tool string, columns array<string>, rows array<string>, row_count long, total_rows long, truncated boolean, bytes long, hint string, "
                       "evidence map<string,string>")


class Reader:
    """Read tools over the facts of one set of tables. `origins` (source_id, table_name, path, sheet) tells what file and sheet
    each table came from."""

    def __init__(self, facts: Facts, views: Views | None = None, extra: dict[str, DataFrame] | None = None, origins: DataFrame | None = None):
        self.facts, self.views, self.extra, self.origins = facts, views, extra or {}, origins

    def schema(self) -> DataFrame:
        cols = self.facts.tables.columns().groupBy("table_id").agg(
            F.array_sort(F.collect_list(F.struct("position", "column_name")))["column_name"].alias("columns"))
        counts = self.facts.profiles.groupBy("table_id").agg(F.max("row_count").alias("rows"))
        return (self.facts.tables.catalog().select("table_id", "source_id", "table_name").join(counts, "table_id", "left")
                .join(cols, "table_id").orderBy("table_id"))

    def describe(self, name: str) -> DataFrame:
        t = self.facts.tables.table(name)
        p = profile_with_examples(self.facts.tables, frequencies=self.facts.frequencies).filter(F.col("table_id") == t.table_id)
        return p.select("position", "column_name", "original_header", "sql_type", "kind", "n", "nulls", "distinct_count", "min_value",
                        "max_value", "mean", "top_k", "sample").orderBy("position")

    def sample(self, name: str, limit: int = MAX_ROWS) -> DataFrame:
        return self.facts.tables.table(name).df.limit(max(1, min(limit, MAX_ROWS)))

    def aggregate(self, name: str, column: str, op: str = "count", group_by: str | None = None) -> DataFrame:
        return D.aggregate(self.facts.tables.table(name), column, op, group_by)

    def trace(self, name: str, row: int) -> DataFrame:
        """One stored row with its source and table, and with its file and sheet where they are known."""
        t = self.facts.tables.table(name)
        found = t.df.filter(t.row_column == row).select("*", F.lit(t.source).alias("_source"), F.lit(t.table_id).alias("_table_id"))
        if self.origins is None:
            return found
        mine = self.origins.filter((F.col("source_id") == t.source) & (F.col("table_name") == t.name))
        return found.join(mine.select(F.col("source_id").alias("_of"), F.col("path").alias("_path"), F.col("sheet").alias("_sheet")), F.col("_source") == F.col("_of"), "left").drop("_of")

    def repaired(self, name: str) -> DataFrame:
        t = self.facts.tables.table(name)
        return repair.repaired_view(t, repair.repairs(self.facts.tables))

    def digest(self, name: str, section: str | None = None) -> DataFrame:
        rows = self.facts.digest.filter(F.col("table_id") == self.facts.tables.table(name).table_id)
        if section:
            rows = rows.filter(F.col("section") == section)
        place = F.when(F.col("section") == "total", 0).when(F.col("section") == "by_group", 1).otherwise(2)
        return rows.orderBy(place, "dim", "rank", "measure")

    def compare(self, changes: DataFrame, kind: str | None = None) -> DataFrame:
        rows = changes.filter(F.col("kind") == kind) if kind else changes
        return rows.orderBy("kind", "severity", "subject")

    def find(self, text: str, values: bool = False) -> DataFrame:
        p = profile_with_examples(self.facts.tables, frequencies=self.facts.frequencies)
        return W.find(self.facts.tables, text, p, self.facts.definitions, self.extra.get("header_groups"), values)

    def sql(self, statement: str) -> DataFrame:
        if self.views is None:
            self.views = Views(self.facts.tables, self.facts.flags)
        return self.views.sql(statement)

    def query(self, statement: str, rows: int = MAX_ROWS, size: int = MAX_BYTES, seconds: float | None = None) -> Result:
        """The envelope of one read-only statement, with the number of all its rows."""
        df = self.sql(statement)
        doubled = sorted(c for c, n in Counter(df.columns).items() if n > 1)
        if doubled:
            raise SqlRefused("columns need different names: " + ", ".join(doubled))
        return result("sql", df, rows, size, hint=self.views.hint(), total=True, seconds=seconds, statement=statement)

    def table(self, name: str) -> dict[str, DataFrame]:
        """Columns with roles, grain, key numbers and a sample of one table."""
        t = self.facts.tables.table(name)

        def mine(df: DataFrame) -> DataFrame:
            return df.filter(F.col("table_id") == t.table_id)

        return {"columns": mine(self.facts.roles).orderBy("position"), "grain": mine(self.facts.grain), "digest": self.digest(name),
                "findings": mine(self.facts.findings), "sample": self.sample(name, 5)}

    def meta(self, section: str) -> DataFrame:
        """One fact table in reading order."""
        f = self.facts
        known: dict[str, tuple] = {
            "relationships": (lambda: f.relationships, [F.desc("status"), F.desc("score")]),
            "definitions": (lambda: f.definitions, [F.col("term")]),
            "quality": (lambda: f.findings, [severity_rank(F.col("severity")), F.col("code")]),
            "keys": (lambda: f.keys, [F.desc("status"), F.desc("score")]), "table_kind": (lambda: f.kinds, [F.col("table_id")]),
            "row_flags": (lambda: f.all_flags, [F.col("table_id"), F.col("row_id")]),
            "column_roles": (lambda: f.roles, [F.col("table_id"), F.col("position")]), "grain": (lambda: f.grain, [F.col("table_id")]),
            "time_coverage": (lambda: f.time_coverage, [F.col("table_id"), F.col("column_id")]),
            "duplicates": (lambda: f.duplicates, [F.desc("score")]),
            "repairs": (lambda: repair.repairs(f.tables), [F.col("table_id"), F.col("row_id")]),
            "digest": (lambda: D.choices_frame(f.tables, f.choices), [F.col("table_id")])}
        if section in self.extra:
            return self.extra[section]
        if section not in known:
            raise ValueError(f"unknown section {section}; use one of " + ", ".join(sorted({*known, *self.extra})))
        make, order = known[section]
        return make().orderBy(*order)

