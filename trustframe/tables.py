"""Data tables under study and their catalog (one row per table, one row per column)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .functions.names import column_identity, table_identity
from .session import create_once, local_frame

MIXED = T.StructType([T.StructField("num", T.DoubleType()), T.StructField("txt", T.StringType())])

SQL_TYPES = {"int": "INTEGER", "real": "REAL", "bool": "INTEGER", "mixed": "BLOB"}

COLUMN_SCHEMA = ("column_no int, column_id string, table_id string, table_name string, source_id string, position int, "
                 "column_name string, original_header string, sql_type string, kind string, error_cells long")
TABLE_SCHEMA = ("table_id string, table_name string, source_id string, column_count int, header_row int, "
                "schema_fingerprint string, formula_cells long, pivot_tables long, merged_in_data long")


def kind_of(dtype: T.DataType) -> str:
    """int, real, text, bool, date, datetime, mixed (number and text in one column) or nested."""
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "real"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.StructType) and {"num", "txt"} <= set(dtype.names):
        return "mixed"
    return "text" if isinstance(dtype, T.StringType) else "nested"


@dataclass(frozen=True)
class Table:
    """One data table. `row_id` names a BIGINT column (or gives an expression) that identifies a stored row."""

    name: str
    df: DataFrame
    row_id: str | Column
    source: str = "local"
    headers: dict[str, str | None] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    errors: dict[str, int] = field(default_factory=dict)
    hide_row_id: bool = False
    header_row: int | None = 1
    formula_cells: int = 0
    pivot_tables: int = 0
    merged_in_data: int = 0

    @property
    def table_id(self) -> str:
        return table_identity(self.source, self.name)

    @property
    def row_column(self) -> Column:
        return (F.col(self.row_id) if isinstance(self.row_id, str) else self.row_id).cast("long")

    @property
    def fields(self) -> list[T.StructField]:
        skip = self.row_id if self.hide_row_id else None
        return [f for f in self.df.schema.fields if f.name != skip]

    def kind(self, f: T.StructField) -> str:
        return self.kinds.get(f.name) or kind_of(f.dataType)

    def schema_fingerprint(self) -> str:
        body = [[i, f.name, SQL_TYPES.get(self.kind(f), "TEXT"), self.kind(f), i]
                for i, f in enumerate(self.fields, 1)]
        return hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


class TableSet:
    """Tables studied together. Columns are numbered across the set, so long frames carry one INT, not a name."""

    def __init__(self, spark: SparkSession, tables: list[Table]):
        names = [(t.source, t.name.lower()) for t in tables]
        if len(names) != len(set(names)):
            raise ValueError("a table name occurs twice in one source")
        self.spark = spark
        self.tables = tables
        self._numbers = {}
        for t in tables:
            for f in t.fields:
                self._numbers[(t.table_id, f.name)] = len(self._numbers)

    def number(self, table: Table, column: str) -> int:
        return self._numbers[(table.table_id, column)]

    def table(self, name: str) -> Table:
        found = [t for t in self.tables if name in (t.name, t.table_id, f"{t.source}/{t.name}")]
        if len(found) != 1:
            raise ValueError(f"{len(found)} tables match {name!r}: " + ", ".join(f"{t.source}/{t.name}" for t in found))
        return found[0]

    def columns(self) -> DataFrame:
        rows = []
        for t in self.tables:
            for position, f in enumerate(t.fields, 1):
                kind = t.kind(f)
                rows.append((self.number(t, f.name), column_identity(t.table_id, f.name), t.table_id, t.name, t.source,
                             position, f.name, t.headers.get(f.name, f.name), SQL_TYPES.get(kind, "TEXT"), kind,
                             t.errors.get(f.name, 0)))
        return local_frame(self.spark, rows, COLUMN_SCHEMA)

    def catalog(self) -> DataFrame:
        rows = [(t.table_id, t.name, t.source, len(t.fields), t.header_row, t.schema_fingerprint(), t.formula_cells,
                 t.pivot_tables, t.merged_in_data) for t in self.tables]
        return local_frame(self.spark, rows, TABLE_SCHEMA)


def _plain_path(c: Column) -> Column:
    return F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")


def file_numbers(spark: SparkSession, files: list[str], registry: str) -> dict[str, int]:
    """A number for each file that it keeps for good: numbers are claimed in the folder `registry`, one small file each, which
    holds the path; files that arrive later get numbers of their own."""
    def known() -> dict[str, int]:
        try:
            rows = spark.read.option("wholetext", True).text(registry).select("value", F.col("_metadata.file_name").alias("n")).collect()
        except AnalysisException:
            return {}
        return {r["value"]: int(r["n"]) for r in sorted(rows, key=lambda r: -int(r["n"]))}      # the first claim of a path counts

    numbers = known()
    following = max(numbers.values(), default=-1) + 1
    for path in sorted(set(files) - set(numbers)):
        while not create_once(spark, f"{registry}/{following:09d}", path):
            following += 1
        following += 1
    numbers = known()
    return {f: numbers[f] for f in files}


def with_file_row_id(df: DataFrame, name: str = "_row_id", registry: str | None = None) -> DataFrame:
    """A BIGINT row id for file tables: the file's number above 40 bits of the row's position inside the file.

    With a `registry` folder files keep their numbers when others arrive, so what was stored about rows still finds them;
    without one they are numbered in the order of their paths, which holds while the files stay the same.
    """
    listed = sorted(df.inputFiles())
    numbers = {p: i for i, p in enumerate(listed)} if registry is None else file_numbers(df.sparkSession, listed, registry)
    files = local_frame(df.sparkSession, list(numbers.items()), "file string, no long")
    files = files.select(_plain_path(F.col("file")).alias("file"), "no")
    located = df.select("*", _plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("at"))
    number = F.coalesce("no", F.raise_error(F.concat(F.lit("file is not in the listing: "), "file")).cast("long"))
    return located.join(files, "file", "left").select(*[F.col(c) for c in df.columns],
                                                      (F.shiftleft(number, 40) + F.col("at")).alias(name))
