"""Sampled joins: scaling, starting rates, cardinalities, Bloom and semi-join reduction, join order advice."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.estimators import AVG, Agg, plain_aggregate

#: Lowest starting rate by number of joins (three stands for more), rows wanted for each group, highest starting rate.
RATE_FLOOR = {0: 0.0, 1: 0.05, 2: 0.07, 3: 0.10}
ROWS_PER_GROUP, RATE_CEILING = 200, 0.60


@dataclass(frozen=True)
class Join:
    table: DataFrame
    on: Column
    how: str = "inner"
    text: str = ""  #: the condition as SQL
    equality: bool = False  #: whether the condition, or a part of it joined by AND, is an equality of two columns


def joined(fact: DataFrame, joins: list[Join]) -> DataFrame:
    for j in joins:
        fact = fact.join(j.table, j.on, j.how)
    return fact


def interval_is_defensible(joins: list[Join], wide: bool = False) -> bool:
    """Whether a total over the join is linear in the rows of the sampled first table.

    By default only inner joins on an equality. ``wide`` admits any condition and left joins: each output row still belongs to
    one sampled row.
    """
    if wide:
        return all(j.how in ("inner", "left", "left_outer") for j in joins)
    return all(j.how == "inner" and j.equality for j in joins)


def scaled(rows: DataFrame, keys: list[Column], aggs: list[Agg], fraction: float) -> DataFrame:
    """Sampled aggregates scaled up (COUNT and SUM by 1 / fraction); no interval."""
    if fraction < 1 and any(a.distinct for a in aggs):
        raise ValueError("aggregates over distinct values do not scale")
    out = [plain_aggregate(a) if a.func == AVG or fraction >= 1 else plain_aggregate(a) / F.lit(fraction) for a in aggs]
    return rows.groupBy(*keys).agg(*(value.alias(a.alias) for value, a in zip(out, aggs, strict=True)))


def starting_rate(fact_rows: int, groups: int, n_joins: int) -> float:
    """Rate that should give each output group enough rows, between a floor by joins and a ceiling."""
    floor = RATE_FLOOR[min(n_joins, 3)]
    return max(floor, min(RATE_CEILING, ROWS_PER_GROUP * groups / max(fact_rows, 1)))


def approximate_groups(df: DataFrame, keys: list[Column], deviation: float = 0.02) -> int:
    return df.agg(F.approx_count_distinct(F.struct(*keys) if len(keys) > 1 else keys[0], deviation)).first()[0]


def complexity_multiplier(joins: list[Join]) -> float:
    """How much longer than a scan a query with these joins may take: a rule of thumb for time budgets."""
    n = len(joins)
    if not n:
        return 1.0
    base = {1: 2.0, 2: 3.5}.get(n, 2 + 1.5 * n)
    for j in joins:
        base *= (1.0 if j.how == "inner" else 1.3) * (1.2 if " and " in j.text.lower() else 1.0)
    return base


def sampled_cardinality(left: DataFrame, right: DataFrame, on, left_fraction: float, right_fraction: float, seed: int = 1) -> float:
    """Rows of a join, from a join of Bernoulli samples."""
    a = left if left_fraction >= 1 else left.sample(False, left_fraction, seed)
    b = right if right_fraction >= 1 else right.sample(False, right_fraction, seed + 1)
    return a.join(b, on).count() / (left_fraction * right_fraction)


def distinct_cardinality(left_rows, right_rows, left_distinct, right_distinct):
    """|A| |B| / max(distinct keys): numbers or columns."""
    if isinstance(left_rows, Column):
        return left_rows * right_rows / F.greatest(left_distinct, right_distinct, F.lit(1))
    return left_rows * right_rows / max(left_distinct, right_distinct, 1)


def _expression(spark, column: Column):
    from pyspark.sql.classic.column import _to_java_column

    return spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(_to_java_column(column))


def _column(spark, expression) -> Column:
    return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


class Bloom:
    """A Bloom filter of a column, built in one aggregation (partial filters are merged by executors) and probed inside scans.

    ``expected`` distinct keys at the false positive ``rate`` settle its size (about 10 bits for each key at 1 %). It travels
    with the plan, so more than ``MOST_BITS`` are refused.
    """

    MOST_BITS = 1 << 26  #: 8 MB

    def __init__(self, df: DataFrame, column: str, expected: int, rate: float = 0.01):
        self.bits = max(64, math.ceil(-max(1, expected) * math.log(rate) / math.log(2) ** 2))
        if self.bits > self.MOST_BITS:
            raise ValueError(f"a filter of {self.bits} bits is too large to travel with a plan: use a semi-join")
        self.spark = df.sparkSession
        sizes = [_expression(self.spark, F.lit(n).cast("long")) for n in (max(1, expected), self.bits)]
        catalyst = self.spark._jvm.org.apache.spark.sql.catalyst.expressions
        build = catalyst.aggregate.BloomFilterAggregate(_expression(self.spark, F.xxhash64(column)), *sizes)
        self.data = df.where(F.col(column).isNotNull()).agg(_column(self.spark, build.toAggregateExpression()).alias("b")).first()[0]

    def probe(self, column: str | Column) -> Column:
        """Whether a value may be among the keys; false for null."""
        if self.data is None:  # no key at all
            return F.lit(False)
        column = F.col(column) if isinstance(column, str) else column
        catalyst = self.spark._jvm.org.apache.spark.sql.catalyst.expressions
        met = catalyst.BloomFilterMightContain(_expression(self.spark, F.lit(bytes(self.data))), _expression(self.spark, F.xxhash64(column)))
        return column.isNotNull() & _column(self.spark, met)

    def reduced(self, df: DataFrame, column: str) -> DataFrame:
        """The rows that may have a partner: all that have one, and about a share ``rate`` of the others."""
        return df.where(self.probe(column))

    def might_contain(self, value, kind: str = "long") -> bool:
        return self.spark.range(1).select(self.probe(F.lit(value).cast(kind)).alias("met")).first()[0]


def hll(df: DataFrame, column: str, precision: int = 14) -> DataFrame:
    """One row: distinct values by a HyperLogLog sketch, mergeable over partitions."""
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, precision)).alias("distinct"))


def semi_join_reduced(fact: DataFrame, dimension: DataFrame, key: str, dimension_key: str | None = None) -> DataFrame:
    """Fact rows that have a partner: distinct keys are semi-joined, so that nothing is multiplied before the real join."""
    keys = dimension.select(F.col(dimension_key or key).alias(key)).distinct()
    return fact.join(keys, key, "left_semi")


def selectivity(fact: DataFrame, dimension: DataFrame, key: str, dimension_key: str | None = None, pilot: float = 1.0, seed: int = 1) -> float:
    """Share of fact rows that survive the semi-join, from a pilot sample of them."""
    some = fact if pilot >= 1 else fact.sample(False, pilot, seed)
    met = dimension.select(F.col(dimension_key or key).alias(key), F.lit(1).alias("__met")).distinct()
    row = some.join(met, key, "left").agg(F.avg(F.coalesce("__met", F.lit(0)).cast("double"))).first()
    return row[0] or 0.0


@dataclass(frozen=True)
class Reduction:
    """What a pilot says of one dimension, and how the fact rows were reduced by it."""

    key: str
    selectivity: float
    by: str  #: "bloom", "semi" or "none"


def two_phase(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str]], pilot: float = 0.005, worthwhile: float = 0.8, rate: float = 0.01, seed: int = 1) -> tuple[DataFrame, list[Reduction]]:
    """Fact rows that (nearly all) have partners in every (dimension, fact key, dimension key), the most selective first.

    A pilot sample of the fact tells the share of rows that each dimension keeps. Those that keep less than ``worthwhile`` reduce
    the fact before any join: by a Bloom filter while it is small enough to travel with the plan, else by a semi-join.
    """
    shares = sorted(((selectivity(fact, d, key, own, pilot, seed), i) for i, (d, key, own) in enumerate(dimensions)), key=lambda x: x)
    done = []
    for share, i in shares:
        dimension, key, own = dimensions[i]
        if share >= worthwhile:
            done.append(Reduction(key, share, "none"))
            continue
        expected = dimension.agg(F.approx_count_distinct(own)).first()[0]
        try:
            fact, by = Bloom(dimension, own, math.ceil(1.1 * expected), rate).reduced(fact, key), "bloom"
        except ValueError:
            fact, by = semi_join_reduced(fact, dimension, key, own), "semi"
        done.append(Reduction(key, share, by))
    return fact, done


@dataclass
class JoinGraph:
    """Sizes of tables, and edges (a, b) with the distinct keys on both sides."""

    rows: dict[str, float]
    edges: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)

    def size(self, joined_rows: float, inside: set[str], table: str) -> float | None:
        touching = [(a, d) for (a, b), d in self.edges.items() if (a in inside and b == table) or (b in inside and a == table)]
        found = [distinct_cardinality(joined_rows, self.rows[table], *(d if a in inside else d[::-1])) for a, d in touching]
        return min(found) if found else None

    def order(self) -> list[tuple[str, float]]:
        """Advice: from the smallest table, always the join whose result is smallest. (table, rows so far)."""
        first = min(self.rows, key=lambda t: (self.rows[t], t))
        order, inside, rows = [(first, self.rows[first])], {first}, self.rows[first]
        while len(inside) < len(self.rows):
            left = [t for t in self.rows if t not in inside]
            sizes = {t: self.size(rows, inside, t) for t in left}
            linked = {t: s for t, s in sizes.items() if s is not None} or {t: rows * self.rows[t] for t in left}
            table = min(linked, key=lambda t: (linked[t], t))
            rows = linked[table]
            inside.add(table)
            order.append((table, rows))
        return order
