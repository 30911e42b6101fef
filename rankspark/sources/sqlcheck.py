"""Which SQL texts may run (SRC-4): one query over the bound tables, and nothing else.

Spark's own parser reads the text. The parsed plan, with its subqueries, must consist of the query operators
in PLANS; it may name only the bound tables and its own common table expressions, so no file path, view or
catalog table; and every function must be one of Spark's built-in ones from the groups in GROUPS. The others
(reflection, session and input-file information, user-defined functions, scripts) are refused. After analysis
``check_leaves`` looks again: what the plan reads must be what the bound tables read.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

PLANS = frozenset("""
    Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join LateralJoin Union Intersect Except Window Generate
    Pivot Unpivot Sample SubqueryAlias OneRowRelation LocalRelation WithWindowDefinition UnresolvedWith UnresolvedHaving UnresolvedHint
    UnresolvedRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases
""".split())
GROUPS = frozenset("""
    agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs
    hash_funcs json_funcs lambda_funcs map_funcs math_funcs operator_funcs predicate_funcs string_funcs struct_funcs url_funcs
    variant_funcs window_funcs xml_funcs
""".split())
ALSO = frozenset(["typeof", "equal_null", "uuid", "monotonically_increasing_id", "assert_true", "raise_error"])
LEAVES = frozenset(["OneRowRelation", "LocalRelation", "CTERelationRef", "Range"])


def parse(spark: SparkSession, text: str, tables: frozenset[str]):
    """The parsed statement; ValueError unless it is one query that keeps to the rules above."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JError) as e:
        raise ValueError(f"not one valid SELECT / WITH statement: {str(e)[:300]}") from e
    _check(spark, plan, tables)
    return plan


def _check(spark: SparkSession, node, known: frozenset[str]) -> None:
    """One node and all below it; ``known`` are the tables it may name: common table expressions count in their query only."""
    name = _name(node)
    if name not in PLANS:
        raise ValueError(f"only a single SELECT / WITH statement is accepted, not {name}")
    if name == "UnresolvedWith":
        known = known | {c.alias() for c in _seq(node.innerChildren())}
    elif name == "UnresolvedRelation":
        parts = _seq(node.multipartIdentifier())
        if len(parts) != 1 or parts[0] not in known:
            raise ValueError(f"no table {'.'.join(parts)!r}: a statement reads the bound tables only")
    elif name == "UnresolvedTableValuedFunction":
        _check_function(spark, _seq(node.name()), tables=True)
    for e in _expressions(node):
        if _name(e) == "UnresolvedFunction":
            _check_function(spark, _seq(e.nameParts()))
        elif _name(e) == "UnresolvedGenerator":
            _check_function(spark, [e.name().funcName()])
    for below in _below(node):
        _check(spark, below, known)


def check_leaves(df: DataFrame, bound: list[DataFrame]) -> None:
    """ValueError if the analysed plan reads anything but what the bound tables read."""
    allowed = [leaf for b in bound for leaf in _leaves(b)]
    for leaf in _leaves(df):
        if _name(leaf) not in LEAVES and not any(leaf.sameResult(a) for a in allowed):
            raise ValueError(f"a statement reads the bound tables only, not {leaf.toString()[:200]}")


def _check_function(spark: SparkSession, parts: list[str], tables: bool = False) -> None:
    name = parts[-1].lower()
    if len(parts) == 1:
        if tables and name == "range":
            return
        registry = spark._jsparkSession.sessionState().functionRegistry()
        found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if found.isDefined() and found.get().getSource() == "built-in":
            group = found.get().getGroup()
            if (group == "generator_funcs") if tables else (group in GROUPS or name in ALSO):
                return
    raise ValueError(f"function {'.'.join(parts)!r} is not accepted")


def _leaves(df: DataFrame) -> list:
    """What an analysed plan reads, its subqueries' included."""
    plan = df._jdf.queryExecution().analyzed()
    return [leaf for p in [plan, *_seq(plan.subqueriesAll())] for leaf in _seq(p.collectLeaves())]


def _below(plan) -> Iterator:
    """The plans under a node: children, common table expressions, subqueries in expressions."""
    yield from (c for c in [*_seq(plan.children()), *_seq(plan.innerChildren())] if _is_plan(c))
    yield from (e.plan() for e in _expressions(plan) if _is_a(e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"))


def _expressions(plan) -> Iterator:
    stack = _seq(plan.expressions())
    while stack:
        e = stack.pop()
        yield e
        stack += _seq(e.children())


def _is_plan(node) -> bool:
    return _is_a(node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")


def _is_a(node, cls: str) -> bool:
    c = node.getClass()
    while c is not None:
        if c.getName() == cls:
            return True
        c = c.getSuperclass()
    return False


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def limited(plan) -> bool:
    """Whether the outermost query of a parsed statement has a LIMIT."""
    while _name(plan) in ("UnresolvedWith", "SubqueryAlias", "Offset"):
        plan = plan.children().apply(0)
    return _name(plan) in ("GlobalLimit", "LocalLimit")
