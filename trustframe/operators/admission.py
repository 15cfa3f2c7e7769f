"""Admission of SQL from outside by its plan: one statement that only reads registered relations.

Spark's own parser makes the plan; every node of it, down to subqueries, common table expressions and arguments, must be
of a kind listed here, every function must belong to an admitted group of Spark's own registry (or be registered by this
library), and every relation must be a common table expression in scope or one of the relations named by the caller.
Whatever is not listed is refused: commands, writes, scripts, files as relations, time travel, IDENTIFIER(), hints,
parameters, table functions over relations, and functions that run code or show the session or its files.
"""

from __future__ import annotations

import functools
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..functions.text import SQL_FUNCTIONS

#: Operators of a query.
PLANS = frozenset("""Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except
    Join LateralJoin UnresolvedWith SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable
    LocalRelation OneRowRelation WithWindowDefinition Generate Pivot Unpivot Sample RepartitionByExpression PipeOperator
    UnresolvedTableValuedFunction""".split())

#: Parts of expressions that are no function; what the parser makes of operators and calls is found in the registry.
EXPRESSIONS = frozenset("""UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias Alias MultiAlias
    UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedOrdinal UnresolvedNamedLambdaVariable LambdaFunction
    UnresolvedWindowExpression WindowExpression WindowSpecDefinition WindowSpecReference SpecifiedWindowFrame UnspecifiedFrame$
    CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ RowFrame$ RangeFrame$ SortOrder Literal AttributeReference Cast Extract
    In InSubquery ListQuery ScalarSubquery Exists LateralSubquery Cube Rollup GroupingSets LikeAny LikeAll NotLikeAny NotLikeAll
    TimestampDiff TimestampAdd CreateNamedStruct CreateArray CreateMap CaseWhen UnaryMinus UnaryPositive Between
    EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not IsNull IsNotNull Like ILike RLike
    Add Subtract Multiply Divide Remainder IntegralDivide Concat CurrentDate CurrentTimestamp""".split())

#: Groups of built-in functions; `misc_funcs` (JVM calls, the session, files, keys) and `xml_funcs` are left out.
GROUPS = frozenset("""agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs
    generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs
    url_funcs variant_funcs window_funcs""".split())

#: Table functions that read nothing.
TABLE_FUNCTIONS = frozenset(["range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"])


class PackError(ValueError):
    """A pack, or a statement, that cannot be used as written."""


class SqlRefused(PackError):
    """A statement that is not one query over the admitted relations."""


class UnknownRelation(SqlRefused):
    """A relation that is not among the admitted ones; `name` is what the statement calls it."""

    def __init__(self, name: str):
        super().__init__(f"SQL must not read {name}: only registered views")
        self.name = name


@dataclass(frozen=True)
class Admitted:
    """The statement without its final semicolon, its plan as Spark parsed it, and the relations it reads."""
    text: str
    plan: object
    relations: frozenset[str]


@functools.cache
def _registry(jvm) -> dict[str, tuple[str, str]]:
    """Built-in function -> (group, simple class name)."""
    out, entries = {}, jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.expressions().iterator()
    while entries.hasNext():
        entry = entries.next()
        info = entry._2()._1()
        out[entry._1().lower()] = (info.getGroup(), info.getClassName().rsplit(".", 1)[-1])
    return out


class _Walk:
    """Checks every node below a plan; `relations` None admits any name of one part."""

    def __init__(self, spark: SparkSession, relations: Collection[str] | None):
        self.jvm = spark._jvm
        self.known = _registry(self.jvm)
        self.classes = EXPRESSIONS | {cls for group, cls in self.known.values() if group in GROUPS}
        self.relations = None if relations is None else {r.casefold() for r in relations}
        self.used: set[str] = set()
        self.kinds: dict[str, str] = {}
        of = self.jvm.java.lang.Class.forName
        self.types = [(kind, of(f"{name}")) for kind, name in (
            ("plan", "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"), ("expression", "org.apache.spark.sql.catalyst.expressions.Expression"),
            ("node", "org.apache.spark.sql.catalyst.trees.TreeNode"), ("items", "scala.collection.Iterable"), ("option", "scala.Option"), ("product", "scala.Product"))]

    def kind(self, item) -> str:
        cls = item.getClass()
        name = cls.getName()
        if name not in self.kinds:
            self.kinds[name] = next((kind for kind, t in self.types if t.isAssignableFrom(cls)), "value")
        return self.kinds[name]

    def visit(self, item, scope: frozenset[str]) -> None:
        if not hasattr(item, "getClass"):
            return
        kind = self.kind(item)
        if kind in ("plan", "expression", "node"):
            name = item.getClass().getName().rsplit(".", 1)[-1]
            if name not in (PLANS if kind == "plan" else self.classes if kind == "expression" else ()):
                raise SqlRefused(f"SQL must only read: {name} is not admitted")
            if name == "UnresolvedWith":
                return self.common_tables(item, scope)
            check = getattr(self, f"check_{name}", None)
            if check:
                check(item, scope)
        if kind == "items":
            items = item.iterator()
            while items.hasNext():
                self.visit(items.next(), scope)
        elif kind == "option":
            if item.isDefined():
                self.visit(item.get(), scope)
        elif kind != "value" and not item.getClass().getName().startswith("org.apache.spark.sql.types."):
            parts = item.productIterator()
            while parts.hasNext():
                self.visit(parts.next(), scope)

    def common_tables(self, item, scope: frozenset[str]) -> None:
        """Each common table expression sees those before it, and itself where it is recursive; the query sees all."""
        tables = item.cteRelations().iterator()
        while tables.hasNext():
            table = tables.next()
            name = table.productElement(0).casefold()
            self.visit(table.productElement(1), scope | {name} if item.allowRecursion() else scope)
            scope |= {name}
        self.visit(item.child(), scope)

    def check_UnresolvedRelation(self, item, scope: frozenset[str]) -> None:
        names = _strings(item.multipartIdentifier())
        if len(names) != 1:
            raise UnknownRelation(".".join(names))
        if names[0].casefold() not in scope:
            self.used.add(names[0])
            if self.relations is not None and names[0].casefold() not in self.relations:
                raise UnknownRelation(names[0])

    def check_UnresolvedAttribute(self, item, scope: frozenset[str]) -> None:
        names = _strings(item.nameParts())
        if len(names) == 1 and names[0].lower() in ("current_user", "session_user"):
            raise SqlRefused(f"SQL must not call {names[0]}")

    def check_UnresolvedFunction(self, item, scope: frozenset[str]) -> None:
        self.function(".".join(_strings(item.nameParts())).lower())

    def check_UnresolvedGenerator(self, item, scope: frozenset[str]) -> None:
        self.function(item.name().unquotedString().lower())

    def check_UnresolvedTableValuedFunction(self, item, scope: frozenset[str]) -> None:
        name = ".".join(_strings(item.name())).lower()
        if name not in TABLE_FUNCTIONS:
            raise SqlRefused(f"SQL must not call {name}")

    def function(self, name: str) -> None:
        if self.known.get(name, ("",))[0] not in GROUPS and name not in SQL_FUNCTIONS:
            raise SqlRefused(f"SQL must not call {name}")


def _strings(seq) -> list[str]:
    return [seq.apply(i) for i in range(seq.size())]


def one_statement(sql: str) -> str:
    """The statement without its final semicolon, if it starts like a query and nothing follows it."""
    text = sql.strip().rstrip(";").strip()
    if not text.lower().startswith(("select", "with")):
        raise SqlRefused("SQL must be exactly one SELECT or WITH statement")
    return text


def admit(sql: str, relations: Collection[str] | None = None, spark: SparkSession | None = None) -> Admitted:
    """The statement, if it is exactly one SELECT or WITH query over `relations` (None: over any registered names)."""
    spark = spark or SparkSession.active()
    text = one_statement(sql)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise SqlRefused("SQL must be exactly one SELECT or WITH statement: " + str(e).split("\n", 1)[0]) from e
    walk = _Walk(spark, relations)
    walk.visit(plan, frozenset())
    return Admitted(text, plan, frozenset(walk.used))


# ---- single aggregates over one relation ------------------------------------------------------------------------
AGGREGATES = frozenset(["count", "sum", "min", "max", "avg", "count_if", "bool_and", "bool_or", "every", "any", "some", "approx_count_distinct"])


@dataclass(frozen=True)
class SingleAggregate:
    """A statement that is one aggregate of one relation: the relation, its alias, and the aggregate with its filter as SQL."""
    relation: str
    alias: str | None
    sql: str


def _name(node) -> str:
    return node.getClass().getName().rsplit(".", 1)[-1]


def _as_sql(parser, expression) -> str | None:
    """The expression as SQL, if that parses back to the very same expression."""
    try:
        text = expression.sql()
        return text if parser.parseExpression(text).equals(expression) else None
    except Exception:                               # expressions that have no SQL form
        return None


def single_aggregate(admitted: Admitted, spark: SparkSession) -> SingleAggregate | None:
    """The statement as an aggregate that can share a scan with others over the same relation; None if it is anything else.

    `SELECT f(x) FROM t WHERE c` is `f(x) FILTER (WHERE c)` of t: also over no rows both are 0 for counts and null else.
    """
    plan, parser = admitted.plan, spark._jsparkSession.sessionState().sqlParser()
    if _name(plan) != "Project" or plan.projectList().size() != 1:
        return None
    call, source, condition = plan.projectList().apply(0), plan.child(), None
    if _name(call) in ("UnresolvedAlias", "Alias"):
        call = call.child()
    if _name(source) == "Filter":
        condition, source = source.condition(), source.child()
    alias = source.alias() if _name(source) == "SubqueryAlias" else None
    source = source.child() if alias else source
    if _name(source) != "UnresolvedRelation" or _name(call) != "UnresolvedFunction":
        return None
    name = _strings(call.nameParts())[-1].lower()
    if name not in AGGREGATES or call.filter().isDefined() or call.ignoreNulls() or call.orderingWithinGroup().size():
        return None
    arguments = [_as_sql(parser, call.arguments().apply(i)) for i in range(call.arguments().size())]
    wanted = None if condition is None else _as_sql(parser, condition)
    if None in arguments or (condition is not None and wanted is None):
        return None
    text = f"{name}({'DISTINCT ' if call.isDistinct() else ''}{', '.join(arguments)})" + (f" FILTER (WHERE {wanted})" if wanted else "")
    return SingleAggregate(_strings(source.multipartIdentifier())[0], alias, text)
