"""Quantiles, tail bounds and error-rate allocation: driver-side numbers and the matching columns."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom from which Student's t is taken as normal.
NORMAL_FROM = 2000


def z_quantile(level: float) -> float:
    """Half width, in standard errors, of a two-sided normal interval of this coverage."""
    if not 0 < level < 1:
        raise ValueError("a coverage level lies between 0 and 1")
    return NormalDist().inv_cdf((1 + level) / 2)


def t_tail(t: float, df: int) -> float:
    """P(|T| > t) for whole degrees of freedom: the finite sums in the angle atan(t / sqrt(df))."""
    angle = math.atan2(t, math.sqrt(df))
    step = math.cos(angle) ** 2
    odd = df % 2
    # terms 1, 1/2 c^2, 1/2 3/4 c^4, ... (even df) or c, 2/3 c^3, 2/3 4/5 c^5, ... (odd df)
    term = math.cos(angle) if odd else 1.0
    terms = []
    for k in range(df // 2):
        terms.append(term)
        term *= step * (2 * k + 1 + odd) / (2 * k + 2 + odd)
    inside = math.sin(angle) * math.fsum(terms)
    return 1 - (2 / math.pi * (angle + inside) if odd else inside)


@lru_cache(100_000)
def t_quantile(level: float, df: int) -> float:
    """Half width, in standard errors, of a two-sided t interval: bisection on the tail."""
    if df < 1:
        raise ValueError("at least one degree of freedom is needed")
    if df >= NORMAL_FROM:
        return z_quantile(level)
    df, low, high, alpha = int(df), 0.0, 2.0, 1 - level
    while t_tail(high, df) > alpha:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, df) > alpha else (low, middle)
        if high - low <= 1e-13 * high:
            break
    return (low + high) / 2


#: Degrees of freedom up to which a column looks its quantile up; beyond, the expansion in 1 / df is exact to 1e-9.
TABLE = 60


def fisher(level: float) -> tuple[float, ...]:
    """Coefficients of 1 / df, 1 / df^2, ... in the expansion of the quantile around the normal one."""
    z = z_quantile(level)
    return (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )


def t_sql(level: float, df: str | int) -> str:
    """The same as SQL text: a literal for a number, else a table of the first ``TABLE`` values and Fisher's expansion."""
    if isinstance(df, int):
        return f"({t_quantile(level, df)!r}D)" if df >= 1 else "CAST(NULL AS DOUBLE)"
    z = z_quantile(level)
    expansion = " + ".join([f"({z!r}D)", *(f"({term!r}D) / pow({df}, {power}D)" for power, term in enumerate(fisher(level), 1))])
    table = ", ".join(f"({t_quantile(level, k)!r}D)" for k in range(1, TABLE + 1))
    return f"CASE WHEN {df} >= {NORMAL_FROM} THEN ({z!r}D) WHEN {df} > {TABLE} THEN {expansion} WHEN {df} >= 1 THEN element_at(array({table}), CAST({df} AS INT)) END"


def t_column(level: float, df: Column | int) -> Column:
    """The same as a column."""
    if isinstance(df, int):
        return F.expr(t_sql(level, df))
    z, n = F.lit(z_quantile(level)), df.cast("double")
    table, expansion = F.expr(f"array({', '.join(f'({t_quantile(level, k)!r}D)' for k in range(1, TABLE + 1))})"), z
    for power, term in enumerate(fisher(level), 1):
        expansion = expansion + term / F.pow(n, F.lit(float(power)))
    return F.when(n >= NORMAL_FROM, z).when(n > TABLE, expansion).when(n >= 1, F.element_at(table, n.cast("int")))


def bernstein(variance: Column, spread: Column, n: Column, level: float) -> Column:
    """Empirical Bernstein half width of a mean."""
    log = math.log(3 / (1 - level))
    return F.sqrt(2 * variance * log / n) + 3 * spread * log / (n - 1)


def hoeffding(spread: Column, n: Column, level: float) -> Column:
    return spread * F.sqrt(F.lit(math.log(2 / (1 - level)) / 2) / n)


def rule_of_three(n: Column, level: float) -> Column:
    """Upper bound of a share that has not been seen in n draws."""
    return F.lit(-math.log(1 - level)) / n


def adjusted_level(level: float, cells: int, rule: str = "bonferroni") -> float:
    """Coverage that each of ``cells`` intervals needs so that all hold together."""
    if cells <= 1 or rule == "none":
        return level
    if rule == "bonferroni":
        return 1 - (1 - level) / cells
    if rule == "sidak":
        return level ** (1 / cells)
    raise ValueError(f"unknown rule {rule!r}")


def look_alpha(alpha: float, look: int, looks: int | None = None) -> float:
    """Error rate for a look (from 1): an equal share of ``looks`` planned ones, or alpha / (t (t + 1)) for any number.

    Looks beyond the planned ones go on with the second rule, so that the sum stays finite.
    """
    if look < 1:
        raise ValueError("looks count from 1")
    return alpha / looks if looks and look <= looks else alpha / (look * (look + 1))
