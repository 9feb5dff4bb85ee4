"""Contingency tables and Pearson chi-squared tests, per group, in one job.

The statistic uses chi2 = sum(N * O^2 / (R * C)) - N over the cells of
each table, so it needs only the cell counts and their row/column totals:
small aggregates of the input.  Each term is an exact ratio (9 decimals),
which makes the statistic identical in every engine.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.chisq import chi2_critical, chi2_pvalue
from wardlens.functions.exact import ratio
from wardlens.session import materialize

col, lit = F.col, F.lit
#: Rows of a contingency table up to which the statistic is exact.
MOST_ROWS = 10 ** 12


def _norm(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def deidentify(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop identifying columns, matching names loosely (case, blanks,
    underscores); names that do not exist are ignored."""
    drop = {_norm(n) for n in names}
    return df.select(*[c for c in df.columns if _norm(c) not in drop])


def clean_cost(df: DataFrame, cost_col: str = "vdc", id_col: str = "encounter_id") -> DataFrame:
    """Text 'NULL' or missing cost -> 0, as a number; keep cost > 0."""
    v = F.coalesce(col(cost_col).cast("string").try_cast("double"), lit(0.0))
    out = df.withColumn(cost_col, v).where(col(cost_col) > 0)
    return out.withColumn(id_col, col(id_col).cast("string")) if id_col in df.columns else out


def _attach(cells: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cells`` with the totals of their ``keys`` (NULL is a key too); without keys ``totals`` is one row."""
    if not keys:
        return cells.withColumn("_j", lit(1)).join(F.broadcast(totals.withColumn("_j", lit(1))), "_j").drop("_j")
    t = totals.withColumnsRenamed({c: "_t_" + c for c in keys})
    same = reduce(and_, [cells[c].eqNullSafe(t["_t_" + c]) for c in keys])
    return cells.join(t, same).drop(*["_t_" + c for c in keys])


def chi_term(n: Column, row: Column, column: Column, total: Column) -> Column:
    """total * n^2 / (row * column), rounded to 9 decimals, exact for tables of up to :data:`MOST_ROWS` rows.

    The division is staged: the whole part first, then the decimals of what is
    left, so that no product leaves 38 digits.  A larger table is an error,
    also where ANSI mode is off and an overflow would be a NULL that sums skip.
    """
    whole_number = "decimal(38,0)"
    n, row, column, big = (c.cast("decimal(13,0)") for c in (n, row, column, total))
    above, below = (big * n).cast(whole_number) * n, (row * column).cast(whole_number)
    whole = F.call_function("div", above.cast(whole_number), F.when(below > 0, below)).cast(whole_number)
    rest = above.cast(whole_number) - (whole * below).cast(whole_number)
    term = (whole.cast("decimal(20,0)") + ratio(rest, 0, below, 0, 9, precision=11)).cast("decimal(38,9)")
    error = F.raise_error(lit(f"a contingency table of more than {MOST_ROWS} rows")).cast("decimal(38,9)")
    return F.when(total > MOST_ROWS, error).otherwise(term)


def contingency(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per (groups, x, y) cell: count, share of the y-bar, and the
    table's chi-squared statistic and degrees of freedom.

    The input is aggregated once to cells, which are cut; row, column and
    table totals are partial aggregates of the cells joined back, so no task
    holds all cells of a table.
    """
    g = list(groups)
    cells = materialize(df.groupBy(*g, x, y).agg(F.count(lit(1)).alias("n")))
    rows = cells.groupBy(*g, x).agg(F.sum("n").alias("n_x"))
    cols = cells.groupBy(*g, y).agg(F.sum("n").alias("n_y"))
    j = _attach(_attach(cells, rows, [*g, x]), cols, [*g, y])
    j = _attach(j, rows.groupBy(*g).agg(F.sum("n_x").alias("n_total"), F.count(x).alias("_r")), g)
    j = _attach(j, cols.groupBy(*g).agg(F.count(y).alias("_c")), g)
    j = j.withColumn("_term", chi_term(col("n"), col("n_x"), col("n_y"), col("n_total")))
    j = _attach(j, j.groupBy(*g).agg(F.sum("_term").alias("_s")), g)
    return j.select(
        *groups, x, y, col("n").alias("n"), col("n_y").alias("n_bar"),
        ratio(col("n") * 100, 0, col("n_y"), 0, 2).alias("pct"),
        (col("_s") - col("n_total")).cast("decimal(20,6)").alias("chi_square"),
        ((col("_r") - 1) * (col("_c") - 1)).cast("int").alias("dof"))


def significant_levels(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Per level of ``y``, goodness-of-fit of ``x`` to equal shares
    (the per-bar test of a stacked bar chart); flag p < alpha.

    chi2 = (k * sum(O^2) - n^2) / n with k the number of x levels.  Works
    on the (y, x) count table only.
    """
    cnt = df.groupBy(y, x).agg(F.count(lit(1)).alias("o"))
    # number of x levels: a global aggregate (exactly one row), broadcast
    k = cnt.agg(F.count_distinct(x).alias("_k")).withColumn("_j", lit(1))
    per = cnt.groupBy(y).agg(F.sum("o").alias("n"), F.sum(col("o").cast("decimal(20,0)") * col("o")).alias("_ss"))
    per = per.withColumn("_j", lit(1)).join(F.broadcast(k), "_j")
    chi = ratio(col("_k") * col("_ss") - col("n").cast("decimal(20,0)") * col("n"), 0, col("n"), 0, 6).cast("decimal(20,6)")
    dof = (col("_k") - 1).cast("int")
    out = per.select(y, "n", chi.alias("chi_square"), dof.alias("dof"))
    return out.withColumn("significant", chi2_pvalue(col("chi_square").cast("double"), col("dof")) < alpha)


def significant_subset(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Rows whose ``y`` level passed :func:`significant_levels`."""
    sig = significant_levels(df, x, y, alpha).where(col("significant")).select(y)
    return df.join(sig, y, "left_semi")


def with_pvalues(tests: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per table with statistic, dof and p-value (NULL for tables of one row or column)."""
    t = tests.select(*groups, "chi_square", "dof").distinct()
    return t.withColumn("p_value", chi2_pvalue(col("chi_square").cast("double"), col("dof")))


__all__ = ["deidentify", "clean_cost", "contingency", "significant_levels", "significant_subset",
           "with_pvalues", "chi2_critical"]
