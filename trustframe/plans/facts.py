"""Facts about a set of tables, each computed when first asked for and built on the ones before it.

The frequency table and the profiles feed almost every other fact, so both are written to the shared folder once and
read back; everything else stays a plan until it is used.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property, reduce

from pyspark.sql import DataFrame

from ..operators import (anomalies as A, digest as D, keys as K, profile as P, quality as Q, reconcile as C, relations as R, rows,
                         semantics as S)
from ..operators.frequencies import value_frequencies
from ..session import materialize
from ..tables import TableSet


class Facts:
    def __init__(self, tables: TableSet, declared_keys: dict[str, list[str]] | None = None,
                 declared_relations: list[tuple[str, str, str, str]] | None = None,
                 declared_roles: dict[tuple[str, str], str] | None = None, digest_limits: D.Limits = D.Limits()):
        self.tables = tables
        self.spark = tables.spark
        self.declared_keys = declared_keys
        self.declared_relations = declared_relations
        self.declared_roles = declared_roles
        self.digest_limits = digest_limits

    @cached_property
    def frequencies(self) -> DataFrame:
        """Written in the order of the columns, so that a read of some columns skips the pages of the others."""
        return materialize(value_frequencies(self.tables).sortWithinPartitions("column_no"), "frequencies")

    @cached_property
    def profiles(self) -> DataFrame:
        return materialize(P.profile(self.tables, self.frequencies), "profiles")

    @cached_property
    def hash_counts(self) -> DataFrame:
        return materialize(rows.all_row_hash_counts(self.tables), "row-hashes")

    @cached_property
    def fingerprints(self) -> DataFrame:
        return rows.fingerprints(self.hash_counts)

    @cached_property
    def flags(self) -> DataFrame:
        return materialize(Q.totals_rows(self.tables), "flags")

    @cached_property
    def findings(self) -> DataFrame:
        return Q.findings(self.tables, self.profiles, self.frequencies, self.flags)

    @cached_property
    def keys(self) -> DataFrame:
        return materialize(K.keys(self.tables, self.profiles, self.declared_keys), "keys")

    @cached_property
    def roles(self) -> DataFrame:
        return materialize(S.column_roles(self.tables, self.profiles, self.frequencies, self.declared_roles), "roles")

    @cached_property
    def kinds(self) -> DataFrame:
        return S.table_kinds(self.tables, self.profiles, self.flags)

    @cached_property
    def grain(self) -> DataFrame:
        return S.table_grain(self.tables, self.keys)

    @cached_property
    def time_coverage(self) -> DataFrame:
        return S.time_coverage(self.profiles)

    @cached_property
    def definitions(self) -> DataFrame:
        return S.definitions(self.tables, self.profiles, self.roles, self.grain)

    @cached_property
    def duplicates(self) -> DataFrame:
        return S.duplicate_tables(self.tables, self.hash_counts)

    @cached_property
    def relationships(self) -> DataFrame:
        return R.relationships(self.tables, self.profiles, self.frequencies, self.keys, self.declared_relations)

    # ---- key numbers ----------------------------------------------------------------------------------------
    @cached_property
    def choices(self) -> list[D.Choice]:
        return D.choose(self.tables, self.roles, self.kinds, limits=self.digest_limits)

    @cached_property
    def all_flags(self) -> DataFrame:
        """Rows labelled as totals, and rows that equal the sum of all others."""
        by_value = [D.sum_rows(c, self.flags) for c in self.choices if not c.skipped and c.measures]
        return materialize(reduce(DataFrame.unionByName, by_value, self.flags), "all-flags")

    @cached_property
    def digest(self) -> DataFrame:
        return materialize(D.digest(self.choices, self.all_flags), "digest")

    @cached_property
    def month_series(self) -> DataFrame:
        """The by_month rows of all months; the digest shows the newest."""
        dated = [c for c in self.choices if c.date]
        return materialize(D.digest(dated, self.all_flags, months=None).filter("section = 'by_month'"), "months")

    def anomalies(self, as_of: dt.date) -> DataFrame:
        return A.anomalies(self.tables, self.choices, self.month_series, self.all_flags, as_of)

    def reconciliation(self, lineage: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
        computed = [c.table.table_id for c in self.choices if not c.skipped]
        return C.reconcile(self.tables, self.profiles, self.frequencies, self.roles, computed, self.all_flags, lineage, regions)
