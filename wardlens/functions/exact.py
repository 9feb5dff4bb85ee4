"""Exact decimal ratios that come out the same in every SQL engine.

Engines disagree on decimal division (Spark keeps a rounded decimal,
DuckDB returns a double, SQL Server rounds to scale 6) and on how a double
is rounded back to a decimal.  Here a ratio is computed on integers:

    round_half_away(a / b, s) = sign(N) * ((2|N| + D) div 2D)
    with N = A * 10**(sb + s), D = B * 10**sa

where A, B are the unscaled integers of a (scale sa) and b (scale sb).
Operators that report a rounded ratio use :func:`ratio`; the oracle SQL
uses the same formula through :func:`sql_ratio`, so results are bit-equal.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_D0 = "decimal(38,0)"


def _unscaled(c: Column, scale: int) -> Column:
    return (c * F.lit(10 ** scale)).cast(_D0) if scale else c.cast(_D0)


def ratio(num: Column, num_scale: int, den: Column, den_scale: int, scale: int,
          precision: int = 38) -> Column:
    """``num / den`` rounded half away from zero to ``scale`` places.

    Returns ``decimal(precision, scale)``; NULL when a side is NULL or
    ``den <= 0`` (callers divide by counts and totals).
    """
    n = _unscaled(num, num_scale) * F.lit(10 ** (den_scale + scale)).cast(_D0)
    d = _unscaled(den, den_scale) * F.lit(10 ** num_scale).cast(_D0)
    n, d = n.cast(_D0), d.cast(_D0)
    two = F.lit(2).cast(_D0)
    # IntegralDivide on decimals is exact (divideToIntegralValue).
    q = F.call_function("div", (two * F.abs(n) + d).cast(_D0), (two * d).cast(_D0))
    signed = F.when(n < 0, -q).otherwise(q).cast("decimal(20,0)")
    if scale:
        signed = signed * F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    return F.when(d > 0, signed.cast(f"decimal({precision},{scale})"))


def sql_ratio(num: str, num_scale: int, den: str, den_scale: int, scale: int,
              precision: int = 38) -> str:
    """DuckDB text of :func:`ratio` (HUGEINT arithmetic)."""
    n = f"(CAST(({num}) * {10 ** num_scale} AS HUGEINT) * {10 ** (den_scale + scale)})"
    d = f"(CAST(({den}) * {10 ** den_scale} AS HUGEINT) * {10 ** num_scale})"
    q = f"((2 * abs({n}) + {d}) // (2 * {d}))"
    signed = f"CAST(CASE WHEN {n} < 0 THEN -{q} ELSE {q} END AS DECIMAL(20,0))"
    if scale:
        signed = f"({signed} * CAST({Decimal(1).scaleb(-scale)} AS DECIMAL({scale + 1},{scale})))"
    return f"(CASE WHEN {d} > 0 THEN CAST({signed} AS DECIMAL({precision},{scale})) END)"


def int_avg(total: Column, count: Column) -> Column:
    """``avg`` of an integer column as SQL Server returns it: truncated int."""
    return F.when(count > 0, F.call_function("div", total.cast("bigint"), count.cast("bigint")).cast("int"))


def sql_int_avg(total: str, count: str) -> str:
    return f"(CASE WHEN ({count}) > 0 THEN CAST(CAST(({total}) AS BIGINT) // CAST(({count}) AS BIGINT) AS INTEGER) END)"


def money_sum(expr: Column, scale: int = 4, precision: int = 38) -> Column:
    """Exact ``sum(expr)`` for a decimal expression with ``scale`` decimals.

    Accumulates the unscaled values as longs (a fixed-width aggregation
    buffer) instead of wide decimals, and converts the group total back to
    ``decimal(precision, scale)`` once.  Overflow past 9.2e18 unscaled units
    raises under ANSI mode rather than wrapping.
    """
    total = F.sum((expr * F.lit(10 ** scale)).cast("long"))
    step = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    return (total.cast("decimal(20,0)") * step).cast(f"decimal({precision},{scale})")
