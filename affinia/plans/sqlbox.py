"""Ad-hoc SQL: one read-only statement over the store's tables, a row limit and a deadline; panels and their history.

A statement is refused before it is analysed: every node of its parsed plan is visited, those of subqueries
and WITH included. It may read the tables that it is given (the session's temporary views, if none are
named) by their plain names, call built-in functions of the groups below, and nothing else: no paths, no
other catalogs, no commands, scripts, parameters or session functions.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ROWS, SECONDS, SLOTS = 500, 5.0, 2
#: Bytes of one value at most, in the answer and in what a function builds by a stated length.
VALUE = 8 << 20
_slots = threading.BoundedSemaphore(SLOTS)

#: Nodes of parsed plans that only read.
_READS = {
    "Project", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Filter", "Distinct", "Union", "Intersect", "Except", "UnresolvedWith", "WithCTE", "UnresolvedHaving", "Join",
    "UnresolvedInlineTable", "LocalRelation", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Offset", "UnresolvedOffset", "Deduplicate", "OneRowRelation",
    "Generate", "Pivot", "Unpivot", "Expand", "LateralJoin", "Sample", "UnresolvedRelation", "UnresolvedTableValuedFunction", "UnresolvedOrdinal", "UnresolvedCTERelation", "CTERelationDef", "CTERelationRef", "UnionLoop", "UnresolvedUnionLoop",
}
#: Groups of built-in functions that compute a value from their arguments.
_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs",
    "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs",
}
#: Table functions, and functions of no group, that do no more.
_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "coalesce", "if", "ifnull", "nullif", "nvl", "nvl2", "typeof", "not", "and", "or"}
#: Functions whose result is as long as an argument says: which argument, by place.
_SIZED = {"repeat": 1, "array_repeat": 1, "space": 0, "lpad": 1, "rpad": 1, "sequence": 1, "randstr": 0}


class Refused(Exception):
    """The statement isn't one that may run."""


@dataclass
class Answer:
    columns: list[str]
    rows: list[Row]
    truncated: bool
    labels: dict[str, str] = field(default_factory=dict)


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _names(spark: SparkSession) -> set[str]:
    return {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}


class _Guard:
    """Walks a parsed plan and refuses what isn't allowed."""

    def __init__(self, spark: SparkSession, tables: Collection[str]):
        self.spark, self.tables = spark, {t.lower() for t in tables}
        self.registry = spark._jsparkSession.sessionState().functionRegistry()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def plan(self, node, named: frozenset[str] = frozenset()) -> None:
        kind = _kind(node)
        if kind not in _READS:
            raise Refused(f"only a SELECT may run, and it may not hold {kind}")
        if kind == "UnresolvedWith":
            # A name of WITH may be read in the later ones, in its own if it recurs, and in the statement.
            for one in _each(node.cteRelations()):
                name = one.productElement(0).lower()
                self.plan(one.productElement(1), named | {name} if node.allowRecursion() else named)
                named = named | {name}
            self.plan(node.child(), named)
            return
        if kind == "UnresolvedRelation":
            self.relation(node, named)
        if kind == "UnresolvedTableValuedFunction":
            self.function([str(x) for x in _each(node.name())], list(_each(node.functionArgs())))
        for e in _each(node.expressions()):
            self.expression(e, named)
        for child in _each(node.children()):
            self.plan(child, named)

    def relation(self, node, named: frozenset[str]) -> None:
        parts = [str(x) for x in _each(node.multipartIdentifier())]
        if len(parts) != 1 or node.isStreaming() or parts[0].lower() not in self.tables | named:
            raise Refused(f"there is no table {'.'.join(parts)} here")

    def expression(self, e, named: frozenset[str]) -> None:
        kind = _kind(e)
        if kind in ("NamedParameter", "PosParameter", "UnresolvedNamedParameter") or "WithUnresolvedIdentifier" in kind:
            raise Refused("a statement takes no parameters and no computed names")
        if kind == "UnresolvedFunction":
            self.function([str(x) for x in _each(e.nameParts())], list(_each(e.arguments())))
        if kind == "UnresolvedGenerator":
            self.function([e.name().funcName()] if not e.name().database().isDefined() else ["?", "?"], list(_each(e.children())))
        if hasattr(e, "plan") and self.holds_plan(e):
            self.plan(e.plan(), named)
        for child in _each(e.children()):
            self.expression(child, named)

    def holds_plan(self, e) -> bool:
        return self.spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(e)

    def function(self, parts: list[str], arguments: list) -> None:
        name = parts[-1].lower()
        found = self.registry.lookupFunction(self.identifier(name)) if len(parts) == 1 else None
        info = found.get() if found is not None and found.isDefined() else None
        group = info.getGroup() if info is not None and info.getSource() == "built-in" else None
        if len(parts) != 1 or (name not in _FUNCTIONS and group not in _GROUPS):
            raise Refused(f"there is no function {'.'.join(parts)} here")
        if name in _SIZED and len(arguments) > _SIZED[name]:
            size = arguments[_SIZED[name]]
            if _kind(size) != "Literal" or not str(size.value()).isdigit() or int(str(size.value())) > VALUE:
                raise Refused(f"{name} needs a plain number of at most {VALUE} as its length")


def checked(spark: SparkSession, sql: str, tables: Collection[str] | None = None) -> None:
    """Refuses a statement that does more than read the tables. tables: plain names, the session's temporary views if None."""
    if not sql.strip():
        raise Refused("the statement is blank")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the parser's error, whatever its class
        raise Refused(f"the statement can't be read: {str(e).splitlines()[0]}") from e
    _Guard(spark, _names(spark) if tables is None else tables).plan(plan)


def bounded(df: DataFrame, most: int = VALUE) -> DataFrame:
    """df, which fails on a text or binary value of more than so many bytes."""
    too_long = F.raise_error(F.lit(f"a value is longer than {most} bytes"))
    kept = [F.when(F.octet_length(df[f"`{c}`"]) > most, too_long.cast(kind)).otherwise(df[f"`{c}`"]).alias(c) if kind in ("string", "binary") else df[f"`{c}`"] for c, kind in df.dtypes]
    return df.select(*kept) if len(set(df.columns)) == len(df.columns) else df


def labels(items: DataFrame, rows: list[Row]) -> dict[str, str]:
    """A label for each text of the answer that is an item's id: its title, and its year if it has one. items: item_id, title, year."""
    ids = sorted({v for r in rows for v in r if isinstance(v, str)})
    if not ids:
        return {}
    label = F.when(F.col("year").isNull(), F.col("title")).otherwise(F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")")))
    found = items.where(F.col("item_id").isin(ids)).select("item_id", label.alias("label"))  # the cells of ROWS rows at most
    return {r["item_id"]: r["label"] for r in found.collect()}


def query(spark: SparkSession, sql: str, rows: int = ROWS, seconds: float = SECONDS, tables: Collection[str] | None = None, items: DataFrame | None = None) -> Answer:
    """The first rows of a statement, with labels if items are given; whoever runs too long is interrupted."""
    checked(spark, sql, tables)
    if not _slots.acquire(blocking=False):
        raise Refused("too many statements are running")
    tag = f"sql-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, spark.interruptTag, [tag])
    spark.addTag(tag)
    try:
        timer.start()
        df = spark.sql(sql)
        found = bounded(df.limit(rows + 1)).collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
        _slots.release()
    return Answer(df.columns, found[:rows], len(found) > rows, labels(items, found[:rows]) if items is not None else {})


def panel_value(spark: SparkSession, sql: str, value: str) -> DataFrame:
    """value: "rows" counts them, "column:<name>" takes the first row's."""
    checked(spark, sql)
    df = spark.sql(sql)
    if value == "rows":
        return df.agg(F.count(F.lit(1)).cast("double").alias("value"))
    return df.limit(1).select(F.col(value.removeprefix("column:")).cast("double").alias("value"))


def recorded(history: DataFrame, today: DataFrame) -> DataFrame:
    """history with today's values: one per series and day; a day that failed keeps its value. Columns: series, day, value."""
    good = today.where("value IS NOT NULL")
    kept = history.join(good, ["series", "day"], "left_anti")
    failed = today.where("value IS NULL").join(history, ["series", "day"], "left_anti")
    return kept.unionByName(good).unionByName(failed)
