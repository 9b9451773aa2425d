"""Read-only SQL entry: the parser decides what a statement is."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Roots of statements that only list the catalog.
_LISTINGS = ("DescribeRelation", "ShowTables", "ShowColumns", "DescribeColumn")
#: Logical operators a query may be made of; whatever else the parser builds is refused.
_QUERY_NODES = {
    "Project", "Filter", "UnresolvedRelation", "SubqueryAlias", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union",
    "Except", "Intersect", "UnresolvedWith", "CTE", "UnresolvedInlineTable", "OneRowRelation", "UnresolvedHaving", "WithWindowDefinition", "Generate", "Pivot",
    "Unpivot", "UnresolvedSubqueryColumnAliases", "LateralJoin", "UnresolvedTableValuedFunction", "ResolvedInlineTable", "LocalRelation", "Sample",
    "UnresolvedSubquery", "UnresolvedHint", "Expand", "GroupingSets", "UnresolvedTVFAliases",
}
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_OUTSIDE = re.compile(r"(?i)\b(?:java_method|reflect|try_reflect|read_files|input_file_name)\s*\(")


def refusal(spark: SparkSession, sql: str) -> str | None:
    """Why a statement may not run, or null. Only single queries over registered relations and listings of the catalog may."""
    text = (sql or "").strip()
    if not text:
        return "empty statement"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001  the parser's own exceptions reach Python under several names
        return "does not parse: " + str(e).strip().splitlines()[0][:200]
    root = plan.getClass().getSimpleName()
    if root.startswith(_LISTINGS):
        return None
    shape = plan.toString()
    for name in _nodes(plan):
        if name not in _QUERY_NODES:
            return f"not a query: {name}"
    if _OUTSIDE.search(text):
        return "calls outside the engine"
    for parts in (m.split(", ") for m in _RELATION.findall(shape)):
        if len(parts) > 1 and parts[0].lower() not in {r.name.lower() for r in spark.catalog.listDatabases()}:
            return "reads something else than a registered relation"
    return None


def _nodes(plan) -> list[str]:
    """Class names of a plan's operators."""
    out = [plan.getClass().getSimpleName()]
    children = plan.children()
    for i in range(children.size()):
        out += _nodes(children.apply(i))
    return out


def read_only_sql(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    """First ``limit`` rows of a read-only statement; anything else raises ValueError."""
    if why := refusal(spark, sql):
        raise ValueError(why)
    return spark.sql(sql).limit(limit)
