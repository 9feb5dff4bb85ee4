"""Chi-squared tail probabilities.

Spark SQL has no gamma or error function, so the p-value of a statistic is a
finite recursion over the degrees of freedom as a column expression
(:func:`chi2_pvalue`).  :func:`chi2_sf` is the same tail as a plain number, for
critical values: the regularized incomplete gamma function by its series below
a + 1 and a continued fraction above it (standard numerical method).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(a: float, x: float) -> range:
    """Steps that either expansion needs by far: they grow with the root of the degrees of freedom."""
    return range(1, 10_000 + 200 * int(math.sqrt(max(a, x))))


def _gamma_p_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    n = a
    for _ in _steps(a, x):
        n += 1.0
        term *= x / n
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    else:
        raise ArithmeticError(f"chi-squared series did not converge (a={a}, x={x})")
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_q_fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in _steps(a, x):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    else:
        raise ArithmeticError(f"chi-squared fraction did not converge (a={a}, x={x})")
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(stat: float, dof: int) -> float:
    """P(X > stat) for X ~ chi-squared(dof)."""
    if stat is None or dof is None or dof <= 0 or (isinstance(stat, float) and math.isnan(stat)):
        return float("nan")
    if stat <= 0:
        return 1.0
    a, x = dof / 2.0, stat / 2.0
    if x < a + 1.0:
        return max(0.0, 1.0 - _gamma_p_series(a, x))
    return _gamma_q_fraction(a, x)


def chi2_critical(dof: int, alpha: float = 0.05) -> float:
    """Smallest statistic with tail probability <= alpha (bisection)."""
    lo, hi = 0.0, max(10.0, dof * 10.0)
    while chi2_sf(hi, dof) > alpha:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if chi2_sf(mid, dof) > alpha:
            lo = mid
        else:
            hi = mid
    return hi


def _erfc_root(h: Column) -> Column:
    """erfc(sqrt(h)) for h > 0: the error function's series of positive terms up to 2.5, a continued fraction beyond."""
    z = F.sqrt(h)
    start = F.struct(z.alias("t"), z.alias("s"))

    def add(acc: Column, n: Column) -> Column:
        t = acc["t"] * 2 * h / (2 * n + 1)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    root_pi = math.sqrt(math.pi)
    series = 1 - 2 / root_pi * F.exp(-h) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda a: a["s"])
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1)), F.lit(1.0), lambda f, n: 1 + n / (2 * h) / f)
    return F.when(h < 2.5, series).otherwise(F.exp(-h) / (z * root_pi * fraction))


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    """P(X > stat) for X ~ chi-squared(dof), as a column expression: no Python worker.

    The tail of dof + 2 is that of dof and one more term, so it is the tail of
    dof 1 or 2 and a finite sum.  Terms are kept as logarithms, which neither
    overflow nor vanish for large statistics or many degrees of freedom.  NULL
    for a NULL or NaN statistic and for dof below 1; 1 for a statistic of 0 or less.
    """
    stat, k = stat.cast("double"), dof.cast("int")
    # Guarded, as all branches are computed for the rows of a batch under ANSI rules.
    ok = (k >= 1) & (stat > 0) & ~F.isnan(stat)
    h = F.when(ok, stat / 2).otherwise(F.lit(1.0))
    odd = k % 2 == 1
    log_h = F.log(h)
    first = F.when(odd, -h + 0.5 * log_h - math.lgamma(1.5)).otherwise(-h)
    n = F.when(ok, F.floor(k / 2)).otherwise(0).cast("int")  # terms: dof / 2, rounded down
    # Term i (from 0) is h^(i + r) e^-h / gamma(i + r + 1), with r = 0, or 1/2 for odd dof; the next has the factor h / (i + 1 + r).
    r = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    begin = F.struct(first.alias("log"), F.lit(0.0).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        return F.struct((acc["log"] + log_h - F.log(i + r)).alias("log"), (acc["s"] + F.exp(acc["log"])).alias("s"))

    steps = F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n)
    total = F.aggregate(steps, begin, add, lambda a: a["s"])
    tail = F.least(F.lit(1.0), F.when(odd, _erfc_root(h) + total).otherwise(total))
    return F.when((k >= 1) & stat.isNotNull() & ~F.isnan(stat), F.when(stat <= 0, F.lit(1.0)).otherwise(tail))
