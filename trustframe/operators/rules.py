"""Rule packs: declared terms, keys, relations, rules and KPIs, checked with SQL over the tables' views."""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import local_frame
from ..tables import Table
from .admission import Admitted, PackError, admit, one_statement, single_aggregate

TABLE_TOKEN = re.compile(r"\{\{table:([^/{}]+)/([^{}]+)\}\}")

# fixed values: what a pack may contain
FIELDS = {"term": {"term", "meaning", "aliases", "unit", "applies_to", "status"}, "key": {"table", "columns"},
          "relation": {"from_table", "from_column", "to_table", "to_column", "kind"},
          "rule": {"id", "sql", "expect", "severity", "message"}, "kpi": {"id", "sql", "unit", "dims"}}
REQUIRED = {"term": ["term", "meaning"], "key": ["table"], "relation": ["from_table", "from_column", "to_table", "to_column"],
            "rule": ["id", "sql"], "kpi": ["id", "sql"]}
UNIQUE = {"term": "term", "rule": "id", "kpi": "id"}
SEVERITIES = {"info", "warn", "error"}
EXPECTATIONS = {"zero", "nonzero", "true", "not_null"}

RULE_SCHEMA = ("rule_id string, pack string, pack_version string, status string, expected string, actual string, severity string, "
               "message string, sql string")
KPI_SCHEMA = "kpi_id string, pack string, pack_version string, value string, unit string, dims map<string,string>, sql string"


def single_select(sql: str, relations: Collection[str] | None = None) -> str:
    """Exactly one SELECT or WITH statement, without its final semicolon, that only reads named relations (see admission)."""
    return admit(sql, relations).text


@dataclass
class Pack:
    name: str
    version: str
    term: list[dict] = field(default_factory=list)
    key: list[dict] = field(default_factory=list)
    relation: list[dict] = field(default_factory=list)
    rule: list[dict] = field(default_factory=list)
    kpi: list[dict] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: dict) -> Pack:
        """A checked pack from its parsed TOML; every problem names the section and the entry."""
        meta = raw.get("pack") or {}
        if set(meta) - {"name", "version"} or not str(meta.get("name", "")).strip() or not str(meta.get("version", "")).strip():
            raise PackError("[pack] needs a name and a version and nothing else")
        pack = cls(str(meta["name"]).strip(), str(meta["version"]).strip(), **{s: list(raw.get(s, [])) for s in FIELDS})
        for section in FIELDS:
            seen = set()
            for at, item in enumerate(getattr(pack, section), 1):
                where = f"[[{section}]] #{at}"
                extra = sorted(set(item) - FIELDS[section])
                if extra:
                    raise PackError(f"{where}: unknown field(s) {', '.join(extra)}")
                for name in REQUIRED[section]:
                    if not isinstance(item.get(name), str) or not item[name].strip():
                        raise PackError(f"{where}: needs a non-empty '{name}'")
                if section in UNIQUE:
                    if item[UNIQUE[section]].strip() in seen:
                        raise PackError(f"{where}: duplicate {UNIQUE[section]} '{item[UNIQUE[section]]}'")
                    seen.add(item[UNIQUE[section]].strip())
                if "sql" in item:
                    text = one_statement(TABLE_TOKEN.sub("declared_table", item["sql"]))
                    if SparkSession.getActiveSession():
                        single_select(text)
                    elif ";" in text:                       # without a session only the shape; run_packs admits by plan
                        raise PackError(f"{where}: SQL must be exactly one SELECT or WITH statement")
                if section == "rule":
                    expect = str(item.get("expect", "zero"))
                    if str(item.get("severity", "warn")) not in SEVERITIES:
                        raise PackError(f"{where}: severity must be info, warn or error")
                    if expect not in EXPECTATIONS and not expect.startswith("equals:"):
                        raise PackError(f"{where}: unknown expectation '{expect}'")
                if section == "key":
                    columns = item.get("columns")
                    if not isinstance(columns, list) or not columns or len(set(columns)) != len(columns):
                        raise PackError(f"{where}: columns must be a list of different names")
        return pack


def parse_packs(raws: list[dict]) -> list[Pack]:
    packs = [Pack.parse(r) for r in raws]
    if len({p.name for p in packs}) != len(packs):
        raise PackError("two packs share a name")
    return packs


def admit_over(sql: str, views: dict[str, str]) -> Admitted:
    """{{table:source/name}} -> the view that reads this table; the statement may read these views and no other relation."""
    def view(m: re.Match) -> str:
        key = f"{m.group(1)}/{m.group(2)}"
        if key not in views:
            raise PackError(f"unknown table in SQL: {key}")
        return f"`{views[key]}`"
    return admit(TABLE_TOKEN.sub(view, sql), {*views.values(), *(key.split("/", 1)[1] for key in views)})


def resolve_tables(sql: str, views: dict[str, str]) -> str:
    """The statement as it will be run."""
    return admit_over(sql, views).text


def met(value, expect: str) -> bool:
    if expect.startswith("equals:"):
        return str(value) == expect.split(":", 1)[1]
    if expect == "not_null":
        return value is not None
    if expect == "zero":
        return value is not None and value == 0
    return bool(value)                                     # nonzero and true


def scalar(spark: SparkSession, sql: str):
    row = spark.sql(sql).first()
    return None if row is None else row[0]


def shared_scans(spark: SparkSession, statements: dict[int, Admitted]) -> dict[int, object]:
    """Values of the statements that are single aggregates, from one job per relation however many they are.

    A statement that cannot be analysed, or a scan that fails (one rule's error would be every rule's), is left out and
    runs alone.
    """
    together: dict[tuple, dict[int, str]] = {}
    for number, statement in statements.items():
        one = single_aggregate(statement, spark)
        if one is not None:
            together.setdefault((one.relation, one.alias), {})[number] = one.sql
    values: dict[int, object] = {}
    for (relation, alias), calls in together.items():
        table = spark.table(f"`{relation}`").alias(alias or relation)
        usable = {}
        for number, call in calls.items():
            try:
                table.agg(F.expr(call))                 # analysis only
                usable[number] = call
            except Exception:                           # reported where the statement runs alone
                continue
        try:
            row = table.agg(*[F.expr(call).alias(f"v{number}") for number, call in usable.items()]).first() if usable else None
            values |= {number: row[f"v{number}"] for number in usable}
        except Exception:                               # one of them fails on the data: each runs alone
            continue
    return values


def run_packs(spark: SparkSession, packs: list[Pack], views: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rule results, KPI results). A statement that fails becomes a rule with status `error`, never a lost rule.

    Statements that are one aggregate of one table share a scan of it; others run by themselves.
    """
    entries = [(p, r, False) for p in packs for r in p.rule] + [(p, k, True) for p in packs for k in p.kpi]
    admitted, refused = {}, {}
    for number, (_, item, _) in enumerate(entries):
        try:
            admitted[number] = admit_over(item["sql"], views)
        except PackError as e:
            refused[number] = e
    values = shared_scans(spark, admitted)
    rules, kpis = [], []
    for number, (p, item, is_kpi) in enumerate(entries):
        sql, value, failure = admitted[number].text if number in admitted else None, None, refused.get(number)
        if failure is None:
            try:
                value = values[number] if number in values else scalar(spark, sql)
            except Exception as e:                          # any engine failure is this statement's result
                failure = e
        said = None if failure is None else f"{type(failure).__name__}: {failure}".splitlines()[0]
        if is_kpi and said is None:
            kpis.append((item["id"], p.name, p.version, None if value is None else str(value), str(item.get("unit", "")),
                         [(a, str(b)) for a, b in item.get("dims", {}).items()], sql))
        elif is_kpi:
            rules.append((f"kpi:{item['id']}", p.name, p.version, "error", "", said, "error", f"KPI '{item['id']}' could not be computed", None))
        else:
            expect = str(item.get("expect", "zero"))
            status = "error" if said is not None else "pass" if met(value, expect) else "fail"
            rules.append((item["id"], p.name, p.version, status, expect, said if said is not None else str(value), str(item.get("severity", "warn")), str(item.get("message", "")), sql))
    return local_frame(spark, rules, RULE_SCHEMA), local_frame(spark, kpis, KPI_SCHEMA)


def count_rules(table: Table, predicates: dict[str, str | Column]) -> DataFrame:
    """(rule_id, violations): many row rules of one table in one scan."""
    tests = [F.count_if(F.expr(p) if isinstance(p, str) else p).alias(f"c{i}") for i, p in enumerate(predicates.values())]
    args = [F.lit(len(tests))]
    for i, name in enumerate(predicates):
        args += [F.lit(name), F.col(f"c{i}")]
    return table.df.agg(*tests).select(F.stack(*args).alias("rule_id", "violations"))


def terms(spark: SparkSession, packs: list[Pack]) -> DataFrame:
    rows = [(t["term"].strip(), t["meaning"].strip(), [str(a) for a in t.get("aliases", [])], str(t.get("unit", "")),
             str(t.get("applies_to", "")), str(t.get("status", "confirmed")), "pack", p.name, p.version)
            for p in packs for t in p.term]
    return local_frame(spark, rows, "term string, meaning string, aliases array<string>, unit string, applies_to string, "
                                    "status string, origin string, pack string, pack_version string")


def promotion_blockers(rule_results: DataFrame, errors_block: bool = True) -> DataFrame:
    """Rules that keep a run from being published: statements that failed, and failed rules of severity `error`."""
    blocking = F.col("status") == "error"
    if errors_block:
        blocking = blocking | ((F.col("status") == "fail") & (F.col("severity") == "error"))
    return rule_results.filter(blocking)


