"""SQL text to a sampled-aggregation query, through Spark's own parser.

Only this module touches the parser's private objects. ``AqpQuery`` can also be built by hand.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators.estimators import AVG, COUNT, SUM, Agg, default_alias
from tallgrass.operators.joins import Join


class Unsupported(ValueError):
    """The statement is legal SQL, but has no sampled form."""


@dataclass
class AqpQuery:
    """A fact table, joins to it, a predicate, group keys and aggregates; what follows the estimate is applied to it."""

    fact: DataFrame
    aggs: list[Agg]
    keys: dict[str, Column] = field(default_factory=dict)
    joins: list[Join] = field(default_factory=list)
    where: Column | None = None
    having: str | None = None
    order_by: list[tuple[str, bool]] = field(default_factory=list)  #: (name, ascending)
    limit: int | None = None
    where_text: str = ""
    columns: list[str] = field(default_factory=list)  #: output order
    name: str = ""  #: what the statement calls the fact table
    subquery: bool = False  #: the predicate holds a subquery: it can be filtered by, but not stand inside an aggregate

    @property
    def distinct(self) -> bool:
        """Whether it has aggregates over distinct values, which are never scaled."""
        return any(a.distinct for a in self.aggs)

    @property
    def universe(self) -> bool:
        """Whether COUNT(*) counts the whole fact table."""
        return self.where is None and not self.keys and not self.joins


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _sql(expression) -> str:
    return expression.sql()


def _has_subquery(expression) -> bool:
    kind = _kind(expression)
    if kind in ("ListQuery", "Exists", "ScalarSubquery", "InSubquery", "UnresolvedInlineTable"):
        return True
    return any(_has_subquery(child) for child in _items(expression.children()))


def _condition(expression) -> str:
    """A condition as SQL; one with a subquery in the words of the statement, which plan nodes cannot be printed back to."""
    if not _has_subquery(expression):
        return _sql(expression)
    places, found = [expression], []
    while places:
        node = places.pop()
        places += _items(node.children())
        origin = node.origin()
        if origin.sqlText().isDefined() and origin.startIndex().isDefined() and origin.stopIndex().isDefined():
            found.append((origin.startIndex().get(), origin.stopIndex().get(), origin.sqlText().get()))
    if not found:
        raise Unsupported("a predicate with a subquery whose place in the statement is unknown")
    return found[0][2][min(a for a, _, _ in found) : max(b for _, b, _ in found) + 1]


def _is_equality(expression) -> bool:
    """Whether a condition, or a part of it joined by AND, is an equality of two expressions of columns."""
    kind = _kind(expression)
    if kind == "And":
        return _is_equality(expression.left()) or _is_equality(expression.right())
    return kind in ("EqualTo", "EqualNullSafe") and not (expression.left().references().isEmpty() or expression.right().references().isEmpty())


HOW = {"Inner": "inner", "LeftOuter": "left", "RightOuter": "right", "FullOuter": "full"}


def _relations(spark: SparkSession, plan) -> tuple[DataFrame, list[Join]]:
    kind = _kind(plan)
    if kind == "SubqueryAlias" and _kind(plan.child()) == "UnresolvedRelation":
        fact, _ = _relations(spark, plan.child())
        return fact.alias(plan.alias()), []
    if kind == "UnresolvedRelation":
        return spark.table(plan.tableName()).alias(plan.tableName().split(".")[-1]), []
    if kind == "Join":
        how = _kind(plan.joinType()).rstrip("$")
        if how not in HOW or plan.condition().isEmpty():
            raise Unsupported(f"{how} joins without ON have no sampled form")
        fact, joins = _relations(spark, plan.left())
        other, more = _relations(spark, plan.right())
        if more:
            raise Unsupported("joins are taken from left to right")
        text = _sql(plan.condition().get())
        return fact, [*joins, Join(other, F.expr(text), HOW[how], text, _is_equality(plan.condition().get()))]
    raise Unsupported(f"{kind} in FROM has no sampled form")


def _aggregate(expression, alias: str | None) -> Agg | None:
    if _kind(expression) != "UnresolvedFunction":
        return None
    func = ".".join(_items(expression.nameParts())).lower()
    if func not in (COUNT, SUM, AVG):
        if func in ("min", "max"):
            raise Unsupported(f"{func} has no sampled form")
        return None
    arguments = _items(expression.arguments())
    if len(arguments) != 1 or expression.filter().isDefined():
        raise Unsupported("an aggregate takes one argument and no FILTER")
    star = _kind(arguments[0]) == "UnresolvedStar" or (_kind(arguments[0]) == "Literal" and func == COUNT)
    text = None if star else _sql(arguments[0])
    plain = (text or "").replace("`", "")
    if star and expression.isDistinct():
        raise Unsupported("DISTINCT takes a column")
    return Agg(func, None if star else F.expr(text), alias or default_alias(func, plain), expression.isDistinct())


def parse(spark: SparkSession, sql: str) -> AqpQuery:
    """The sampled form of a statement. Raises Spark's ParseException, or Unsupported."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    limit, order, having = None, [], None
    while _kind(plan) in ("GlobalLimit", "LocalLimit", "Sort", "UnresolvedHaving"):
        kind = _kind(plan)
        if kind == "GlobalLimit":
            limit = int(_sql(plan.limitExpr()))
        elif kind == "Sort":
            order = [(_sql(o.child()), "ASC" in o.direction().sql()) for o in _items(plan.order())]
        elif kind == "UnresolvedHaving":
            having = _sql(plan.havingCondition())
        plan = plan.child()
    if _kind(plan) == "Project":  # no GROUP BY
        outputs, groupings, child = _items(plan.projectList()), [], plan.child()
    elif _kind(plan) == "Aggregate":
        outputs, groupings, child = _items(plan.aggregateExpressions()), _items(plan.groupingExpressions()), plan.child()
    else:
        raise Unsupported(f"{_kind(plan)} has no sampled form")
    where_text, subquery = "", False
    if _kind(child) == "Filter":
        subquery = _has_subquery(child.condition())
        where_text, child = _condition(child.condition()), child.child()
    fact, joins = _relations(spark, child)
    first = child
    while _kind(first) == "Join":
        first = first.left()
    fact_name = first.alias() if _kind(first) == "SubqueryAlias" else first.tableName().split(".")[-1]

    wanted, keys, aggs, columns, names = [_sql(g) for g in groupings], {}, [], [], {}
    for out in outputs:
        alias = out.name() if _kind(out) == "Alias" else None
        inner = out.child() if _kind(out) in ("Alias", "UnresolvedAlias") else out
        agg = _aggregate(inner, alias)
        if agg:
            aggs.append(agg)
            columns.append(agg.alias)
            names[_sql(inner)] = agg.alias
        else:
            text = _sql(inner)
            name = alias or text.replace("`", "").split(".")[-1]
            if text not in wanted and name not in [w.replace("`", "") for w in wanted]:
                raise Unsupported(f"{text} is neither an aggregate that can be sampled nor a group key")
            keys[name] = F.expr(text)
            columns.append(name)
            names[text] = name
    if not aggs:
        raise Unsupported("no aggregate")
    if len(keys) != len(wanted):
        raise Unsupported("every group key must be selected")

    def named(text: str) -> str:
        """An expression over aggregates or keys, by the names of the outputs."""
        for old, new in sorted(names.items(), key=lambda x: -len(x[0])):
            text = text.replace(old, f"`{new}`")
        return text

    return AqpQuery(
        fact, aggs, keys, joins, F.expr(where_text) if where_text else None, named(having) if having else None,
        [(named(o), up) for o, up in order], limit, where_text, columns, fact_name, subquery,
    )


def finish(query: AqpQuery, wide: DataFrame) -> DataFrame:
    """HAVING, ORDER BY and LIMIT on the estimates."""
    if query.having:
        wide = wide.where(query.having)
    if query.order_by:
        wide = wide.orderBy(*(F.expr(n).asc() if up else F.expr(n).desc() for n, up in query.order_by))
    return wide.limit(query.limit) if query.limit is not None else wide
