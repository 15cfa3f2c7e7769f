"""One run over a set of tables: compute every fact, compare with the last published run, audit, publish."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..operators import audit as U, changes as H, digest as D, readiness as Y, relations as R, repair as E, rows, rules as P
from ..operators.profile import profile_with_examples
from ..sources.publish import RunStore
from ..sources.views import Views
from ..tables import TableSet
from .facts import Facts


def snapshot(facts: Facts, kpis: DataFrame, sources: DataFrame | None = None) -> H.Snapshot:
    """What the next run is compared with. Without a source inventory a source is known by its tables' fingerprints."""
    counts = facts.profiles.groupBy("table_id").agg(F.max("row_count").alias("row_count"))
    catalog = (facts.tables.catalog().select("table_id", "source_id", "table_name", "schema_fingerprint").join(counts, "table_id")
               .join(rows.fingerprints(facts.hash_counts).select("table_id", "fingerprint"), "table_id", "left"))
    if sources is None:
        sources = catalog.groupBy("source_id").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("fingerprint"))), 256).alias("sha256"))
    columns = profile_with_examples(facts.tables, 5, 0, facts.frequencies).select("table_id", "column_name", "distinct_count", "top_k")
    return H.Snapshot(sources, catalog, facts.hash_counts, columns, kpis)


SNAPSHOT = ("sources", "tables", "hash_counts", "columns", "kpis")


def stored_snapshot(store: RunStore, run_id: str) -> H.Snapshot:
    return H.Snapshot(*[store.read(f"snapshot_{name}", run_id) for name in SNAPSHOT])


def refresh(tables: TableSet, store: RunStore, run_id: str, as_of: dt.date, packs: list[dict] = (), sources: DataFrame | None = None,
            lineage: DataFrame | None = None, regions: DataFrame | None = None, blind_spots: DataFrame | None = None,
            mismatches: DataFrame | None = None, with_repairs: bool = False) -> dict[str, DataFrame]:
    """Compute and store all facts of one run, then publish it; raises NotPublished when rules or the audit forbid it.

    Rules run before relationships, so confirmed keys can be parents. Every fact is written below the run and becomes
    visible only with the run.
    """
    spark = tables.spark
    parsed = P.parse_packs(list(packs))

    def plain(selector: str) -> str:
        return selector if selector in {t.name for t in tables.tables} else tables.table(selector).name

    keys = {plain(k["table"]): k["columns"] for p in parsed for k in p.key}
    links = [(plain(r["from_table"]), r["from_column"], plain(r["to_table"]), r["to_column"]) for p in parsed for r in p.relation]
    facts = Facts(tables, declared_keys=keys or None, declared_relations=links or None)
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        out[name] = store.write(run_id, name, df)
        return out[name]

    counts = facts.profiles.groupBy("table_id").agg(F.max("row_count").alias("row_count"))
    catalog = keep("tables", tables.catalog().join(counts, "table_id", "left"))
    keep("columns", tables.columns())
    keep("profiles", profile_with_examples(tables, frequencies=facts.frequencies))
    findings = keep("findings", facts.findings)
    keep("keys", facts.keys)
    keep("roles", facts.roles)
    keep("table_kinds", facts.kinds)
    grain = keep("grain", facts.grain)
    keep("time_coverage", facts.time_coverage)
    keep("definitions", facts.definitions.unionByName(P.terms(spark, parsed).select("term", "meaning", "unit", "applies_to", "status", "origin")))
    keep("duplicates", facts.duplicates)
    if with_repairs:
        keep("repairs", E.repairs(tables))
    rule_results, kpis = P.run_packs(spark, parsed, Views(tables, facts.flags).resolved)
    rule_results, kpis = keep("rules", rule_results), keep("kpis", kpis)
    keep("relationships", R.named_relationships(tables, facts.relationships))
    keep("digest_tables", D.choices_frame(tables, facts.choices))
    keep("digest", facts.digest)
    flags = keep("row_flags", facts.all_flags)
    anomalies = keep("anomalies", facts.anomalies(as_of))
    checks = keep("reconciliation", facts.reconciliation(lineage, regions))
    now = snapshot(facts, kpis.select("pack", "kpi_id", "value"), sources)
    for name in SNAPSHOT:
        keep(f"snapshot_{name}", getattr(now, name))
    last = store.current()
    keep("changes", H.baseline(spark, run_id) if last is None else H.changes(stored_snapshot(store, last), now))
    ready = keep("readiness", Y.readiness(tables.catalog(), findings, flags, grain, regions, blind_spots, mismatches, checks, lineage, anomalies))
    keep("gaps", Y.gaps(ready, rule_results))
    issues = keep("audit", U.audit(catalog, tables))
    store.finish(run_id, issues, P.promotion_blockers(rule_results))
    return out


def fresh_run_id(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now(dt.timezone.utc)).strftime("run-%Y%m%dT%H%M%S%f")


