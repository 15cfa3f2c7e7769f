"""SQL views over the tables of many sources: clean by plain name, complete by qualified name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.text import register_sql_functions
from ..operators.quality import without_flagged
from ..operators.admission import SqlRefused, UnknownRelation, admit
from ..tables import TableSet


def alias_of(source: str) -> str:
    name = re.sub(r"\W+", "_", source).strip("_") or "src"
    return f"s_{name}" if name[0].isdigit() else name


class UnknownTable(SqlRefused):
    """A table no view has; the message lists those that exist."""


class Views:
    """`name` reads a table without its flagged total rows; `<source>__<name>` reads every stored row.

    A name that several sources share has no plain view: using it raises an error that lists the choices.
    """

    def __init__(self, tables: TableSet, flags: DataFrame | None = None):
        self.tables, self.spark = tables, tables.spark
        register_sql_functions(self.spark)
        names: dict[str, list] = {}
        for t in tables.tables:
            names.setdefault(t.name.lower(), []).append(t)
        self.ambiguous = {k: [f"{alias_of(t.source)}__{t.name}" for t in ts] for k, ts in names.items() if len(ts) > 1}
        self.plain = [ts[0].name for ts in names.values() if len(ts) == 1]
        self.flags, self.cleaned = flags, None
        self.resolved: dict[str, str] = {}
        for t in tables.tables:
            raw = f"{alias_of(t.source)}__{t.name}"
            t.df.createOrReplaceTempView(f"`{raw}`")
            self.resolved[f"{t.source}/{t.name}"] = raw
            if t.name.lower() not in self.ambiguous:
                (t.df if flags is None else without_flagged(t, flags)).createOrReplaceTempView(f"`{t.name}`")

    def hint(self) -> str:
        """How tables are named, and which plain names leave out total rows or need a source."""
        if self.cleaned is None:
            flagged = set() if self.flags is None else {r["table_id"] for r in self.flags.select("table_id").distinct().collect()}
            self.cleaned = sorted(t.name for t in self.tables.tables if t.table_id in flagged and t.name.lower() not in self.ambiguous)
        clean = f"; total rows are left out of: {', '.join(self.cleaned)}" if self.cleaned else ""
        shared = f"; qualify these (in several sources): {', '.join(sorted(self.ambiguous))}" if self.ambiguous else ""
        return "tables go by plain name or <source>__<table>" + clean + shared

    def sql(self, statement: str) -> DataFrame:
        """One read-only SELECT or WITH over all sources (see admission); joins, windows and set operations are Spark's own."""
        try:
            text = admit(statement, [*self.plain, *self.resolved.values()], self.spark).text
        except UnknownRelation as e:
            choices = self.ambiguous.get(e.name.lower())
            if choices:
                raise ValueError(f"{e.name} exists in several sources: write {' or '.join(choices)}") from e
            more = f" and {len(self.plain) - 30} more" if len(self.plain) > 30 else ""
            raise UnknownTable(f"table not found: {e.name}; tables to use: " + ", ".join(sorted(self.plain)[:30]) + more) from e
        return self.spark.sql(text)
