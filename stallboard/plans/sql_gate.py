"""SQL text from outside, run only if Spark's own parse of it is a plain query over registered views.

The text is parsed, not run, and the plan that Spark's parser returns is walked: with subqueries and common
table expressions. Let through are the kinds of plan that a SELECT is made of, and relations that are one
of the allowed views or a name that the query itself defines. Everything else is refused before it can do
anything: commands, writes, DDL, settings, files named as tables, tables of other catalogs, table functions,
and functions that call code or read the surroundings. Values come in as named parameters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of plan that a query may consist of (names of Spark's logical plans).
QUERY_PLANS = frozenset("""
    Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin
    LocalLimit LocalRelation Offset OneRowRelation ParameterizedQuery NameParameterizedQuery Pivot Project Sort SubqueryAlias Tail
    Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedWith Window WithWindowDefinition
""".split())
#: Functions that call code, read files or tell about the surroundings.
REFUSED_FUNCTIONS = frozenset("""
    reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length
    current_user user session_user current_catalog current_database current_schema version spark_partition_id
    raise_error assert_true python_worker_logs
""".split())


class RefusedQuery(ValueError):
    """A text that is no plain query over the allowed views."""


def _items(seq) -> Iterator:
    for k in range(seq.size()):
        yield seq.apply(k)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _functions(expression) -> Iterator[str]:
    if _kind(expression) == "UnresolvedFunction":
        yield ".".join(_items(expression.nameParts())).lower()
    for child in _items(expression.children()):
        yield from _functions(child)


def _plans(plan) -> Iterator:
    """A plan, its children, its subqueries and the bodies of its common table expressions."""
    yield plan
    inner = list(_items(plan.subqueries()))
    if _kind(plan) == "UnresolvedWith":
        inner += [r._2() for r in _items(plan.cteRelations())]
    for child in [*_items(plan.children()), *inner]:
        yield from _plans(child)


def check_query(spark: SparkSession, text: str, views: Iterable[str]) -> None:
    """Raises ``RefusedQuery`` unless the text is a query over ``views`` alone."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # noqa: BLE001 - whatever Spark's parser says is a refusal
        raise RefusedQuery(f"not a query: {str(error).splitlines()[0]}") from None
    allowed = {v.lower() for v in views}
    nodes = list(_plans(plan))
    for node in nodes:
        if _kind(node) == "UnresolvedWith":
            allowed |= {r._1().lower() for r in _items(node.cteRelations())}
    for node in nodes:
        kind = _kind(node)
        if kind not in QUERY_PLANS:
            raise RefusedQuery(f"{kind} is no part of a query")
        if kind == "UnresolvedRelation":
            name = list(_items(node.multipartIdentifier()))
            if len(name) != 1 or name[0].lower() not in allowed:
                raise RefusedQuery(f"{'.'.join(name)} is no registered view")
        for expression in _items(node.expressions()):
            for function in _functions(expression):
                if function.split(".")[-1] in REFUSED_FUNCTIONS:
                    raise RefusedQuery(f"function {function} is not allowed")


def run_query(spark: SparkSession, text: str, views: Iterable[str], args: dict | None = None) -> DataFrame:
    """The rows of a checked query."""
    check_query(spark, text, views)
    return spark.sql(text, args=args or {})


def rows_json(spark: SparkSession, text: str, views: Iterable[str], args: dict | None = None) -> DataFrame:
    """The rows of a checked query as JSON objects, one per row, written by the executors."""
    df = run_query(spark, text, views, args)
    return df.select(F.to_json(F.struct(*(F.col(c) for c in df.columns))).alias("row_json"))
