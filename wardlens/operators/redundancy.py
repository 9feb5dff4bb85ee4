"""Redundant-test analysis: same-day and consecutive-day repeats of a test.

The reference numbers every usage row globally (an unpartitioned
ROW_NUMBER, i.e. one task) and self-joins row i to row i+1.  Here the
rows are range-sorted over many tasks and each reads the row before it, the
last row of a task being handed to the next one, so no task ever has to hold
a whole encounter.

Scopes ("record numbers having any ...") are one partial aggregate per
record number joined back, serving both the same-day and next-day sums.

The savings need no rows at all: :func:`savings_from_usage` aggregates them
to a state per day (its first row and the sums of the others), reads the day
before from the states of an encounter, and sums over the record numbers in
scope.  Cleaning is a flag of the same states, so usage is scanned once.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.exact import money_sum
from wardlens.functions.ranking import group_row_number, previous_row, range_sorted
from wardlens.operators._keys import join_costs, line_key_columns
from wardlens.params import RedundancyParams

col, lit = F.col, F.lit

NEW_ENCOUNTER = 99999          # day-difference sentinel of the reference
SAME_DAY_RATE = "0.75"
NEXT_DAY_RATE = "0.5"


def ctf_mapping(ctf: DataFrame, icd_map: DataFrame, cpt_map: DataFrame, version: int = 2) -> DataFrame:
    """Case-type families with their MS-DRG, ICD-10 and CPT codes at ``version``.

    Emitted in long form (one row per family x code, the other code column
    NULL) instead of the per-family product of the two code lists.
    """
    icd = icd_map.where(col("version_id") == version).select("ctf", "msdrg_code", "icd10_code")
    cpt = cpt_map.where(col("version_id") == version).select("ctf", "cpt_code")
    a = ctf.join(icd, "ctf", "left").select("ctf", "msdrg_code", "icd10_code", lit(None).cast("string").alias("cpt_code"))
    b = ctf.join(cpt, "ctf", "left").select("ctf", *[lit(None).cast("string").alias(c) for c in ("msdrg_code", "icd10_code")],
                                            "cpt_code")
    return a.unionByName(b)


def billing_source_systems(source_system: DataFrame, category_id: int = 1) -> DataFrame:
    """Source systems of the hospital-billing category."""
    return source_system.where(col("category_id") == category_id).select("source_system_id").distinct()


def encounter_usage(enc: DataFrame, lines: DataFrame, costs: DataFrame, charge_code: DataFrame,
                    cpt: DataFrame, physician: DataFrame, source_system: DataFrame,
                    p: RedundancyParams) -> DataFrame:
    """Encounter x test x day usage of the chosen CPT codes.

    Filters on the encounter (year, setting, source) and on the dimensions
    (CPT, cost driver) are applied before the line fact is joined, so the
    line scan meets only qualifying codes and encounters.
    """
    e = (enc.where((col("fiscal_year") == p.fiscal_year) & col("patient_setting").isin(list(p.patient_settings)))
         .join(billing_source_systems(source_system, p.source_category_id), "source_system_id", "left_semi")
         .select("encounter_id", "record_number", "service_line", "patient_setting", "entity"))
    c = cpt.where(col("cpt_code").isin(list(p.cpt_codes))).select("cpt_id", "cpt_code", col("cpt_name").alias("cpt_description"))
    cc = charge_code.where(col("cost_driver").isin(list(p.cost_drivers))).select("charge_code_id")
    md = physician.select("physician_id", col("full_name").alias("ordering_md_name"),
                          col("specialty").alias("ordering_md_spec"))
    l = (lines.select(*line_key_columns(lines, costs), "encounter_id", "charge_code_id", "cpt_id", "physician_id",
                      "service_date", "service_ts", "units")
         .join(c, "cpt_id").join(cc, "charge_code_id").join(md, "physician_id"))
    j = join_costs(l.join(e, "encounter_id"), costs, "left")
    keys = ["encounter_id", "record_number", "service_line", "patient_setting", "entity", "service_date",
            "service_ts", "ordering_md_name", "ordering_md_spec", "cpt_code", "cpt_description", "unit_cost"]
    return j.groupBy(*keys).agg(
        F.sum("units").cast("decimal(38,2)").alias("uos"),
        money_sum(col("units") * col("unit_cost")).alias("vdc"))


def clean_usage(usage: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Drop encounters having any row with UOS <= 0 or VDC <= 0.

    NULL VDC (line without a cost row) does not disqualify.  Written as an
    anti join on the non-null offending ids, not a null-aware NOT IN.
    """
    bad = usage.where(((col("uos") <= 0) | (col("vdc") <= 0)) & col(key).isNotNull()).select(key).distinct()
    return usage.join(bad, key, "left_anti")


def rank_codes(usage: DataFrame, ranks: Iterable[tuple[str, str]]) -> DataFrame:
    """A10: test-complexity rank per CPT code, 'NA' for unranked codes."""
    expr = lit("NA")
    for code, rank in reversed(list(ranks)):
        expr = F.when(col("cpt_code") == code, rank).otherwise(expr)
    return usage.withColumn("cc_rank", expr)


def _order_cols(tiebreak: Sequence[str]) -> list[str]:
    return ["cc_rank", *tiebreak]


def _full_order(ranked: DataFrame, tiebreak: Sequence[str], key: str) -> list[str]:
    """The order inside a day: rank, tie-break, then all other columns, so that only equal rows are interchangeable."""
    order = _order_cols(tiebreak)
    return [*order, *(f.name for f in ranked.schema.fields if f.name not in (key, "service_date", *order)
                      and not isinstance(f.dataType, (T.MapType, T.VariantType)))]


def row_index(ranked: DataFrame, tiebreak: Sequence[str], key: str = "encounter_id",
              whole_table: bool = False) -> DataFrame:
    """Position of each row in (day, rank, tie-break) order within ``key``,
    or with ``whole_table`` in (``key``, day, rank, tie-break) order of all rows.

    A distributed row number (range partitioning + per-task offsets), so
    an encounter with a huge number of rows is numbered by many tasks.
    """
    order = ["service_date", *_order_cols(tiebreak)]
    if whole_table:
        return group_row_number(ranked, [], [key, *order], "row_num")
    return group_row_number(ranked, [key], order, "row_num")


def adjacent_rows(ranked: DataFrame, tiebreak: Sequence[str], key: str = "encounter_id",
                  keep_null_time: bool = False) -> DataFrame:
    """Compare each row with the row before it in (day, rank, tie-break) order.

    ``same_day`` is 'same day' when the previous row of the encounter is on
    the same day, else 'NA'; ``date_diff`` is the day difference to the
    previous row, 99999 for the first row of an encounter.  Rows that agree
    in the whole ordering key follow each other: the first is compared with
    the day before, the others are on the same day.  Which one is first is
    settled by the other columns; only equal rows are interchangeable.  Rows
    without a date are a day of their own, the first.
    """
    j = previous_row(range_sorted(ranked, [key, "service_date", *_full_order(ranked, tiebreak, key)]), [key, "service_date"])
    same_key = col("_prev").isNotNull() & col(f"_prev.{key}").eqNullSafe(col(key))
    same = same_key & col("_prev.service_date").eqNullSafe(col("service_date"))
    gap = F.when(same_key, F.date_diff(col("service_date"), col("_prev.service_date")))
    out = j.select(
        *ranked.columns,
        F.when(same, "same day").otherwise("NA").alias("same_day"),
        F.when(same, lit(0)).otherwise(F.coalesce(gap, lit(NEW_ENCOUNTER))).cast("int").alias("date_diff"))
    return out if keep_null_time else out.where(col("service_ts").isNotNull())


def _with_scopes(adjacent_all: DataFrame, scope_key: str) -> DataFrame:
    same = (col("same_day") == "same day") | ((col("same_day") == "NA") & (col("uos") > 1))
    nxt = col("date_diff") == 1
    scopes = adjacent_all.groupBy(scope_key).agg(
        F.max(same.cast("int")).alias("_in_same"), F.max(nxt.cast("int")).alias("_in_next"))
    scopes = scopes.where((col("_in_same") == 1) | (col("_in_next") == 1))
    return adjacent_all.join(scopes, scope_key).where(col("service_ts").isNotNull())


def _same_day_cols():
    vdc = (F.when(col("same_day") == "same day", col("vdc"))
           .when((col("same_day") == "NA") & (col("uos") > 1), (col("uos") - 1) * col("unit_cost"))
           .otherwise(lit(0))).cast("decimal(38,4)")
    uos = F.when(col("same_day") == "same day", col("uos")).otherwise(col("uos") - 1)
    return vdc.alias("same_day_excess_vdc"), uos.alias("same_day_excess_uos")


def _next_day_cols():
    vdc = F.when(col("date_diff") == 1, col("unit_cost")).otherwise(lit(0)).cast("decimal(38,4)")
    uos = F.when(col("date_diff") == 1, lit(1)).otherwise(lit(0))
    return vdc.alias("subseq_day_excess_vdc"), uos.alias("subseq_day_excess_uos")


def same_day_excess(adjacent_all: DataFrame, scope_key: str = "record_number") -> DataFrame:
    """Rows of record numbers having a same-day repeat or a multi-unit row."""
    s = _with_scopes(adjacent_all, scope_key).where(col("_in_same") == 1)
    return s.select(*adjacent_all.columns, *_same_day_cols())


def next_day_excess(adjacent_all: DataFrame, scope_key: str = "record_number") -> DataFrame:
    """Rows of record numbers having a test on consecutive days."""
    s = _with_scopes(adjacent_all, scope_key).where(col("_in_next") == 1)
    return s.select(*adjacent_all.columns, *_next_day_cols())


def savings(adjacent_all: DataFrame, fiscal_year: int, scope_key: str = "record_number") -> DataFrame:
    """Excess tests and VDC, savings at 75 % (same day) and 50 % (next day).

    One scan and one global aggregate (partial per task, one final row).
    An empty scope yields NULL, which propagates into the totals.
    """
    s = _with_scopes(adjacent_all, scope_key)
    sd_vdc, sd_uos = _same_day_cols()
    nd_vdc, nd_uos = _next_day_cols()
    in_same, in_next = col("_in_same") == 1, col("_in_next") == 1
    a = s.agg(
        F.sum(F.when(in_same, sd_uos)).alias("sd_uos"), F.sum(F.when(in_same, sd_vdc)).alias("sd_vdc"),
        F.sum(F.when(in_next, nd_uos)).alias("nd_uos"), F.sum(F.when(in_next, nd_vdc)).alias("nd_vdc"))
    return _savings_report(a, fiscal_year)


def _savings_report(a: DataFrame, fiscal_year: int) -> DataFrame:
    r75 = lit(SAME_DAY_RATE).cast("decimal(3,2)")
    r50 = lit(NEXT_DAY_RATE).cast("decimal(3,2)")
    return a.select(
        lit(fiscal_year).cast("int").alias("fiscalyear"),
        col("sd_uos").cast("int").alias("same_day_excess_tests"),
        col("sd_vdc").cast("double").alias("same_day_excess_vdc"),
        col("nd_uos").cast("int").alias("consecutive_daily_tests"),
        col("nd_vdc").cast("double").alias("consecutive_daily_vdc"),
        (col("sd_uos") + col("nd_uos")).cast("int").alias("total_excess_tests"),
        (col("sd_vdc") + col("nd_vdc")).cast("double").alias("total_excess_vdc"),
        (col("sd_vdc") * r75).cast("double").alias("same_day_savings_75"),
        (col("nd_vdc") * r50).cast("double").alias("consecutive_daily_savings_50"),
        (col("sd_vdc") * r75 + col("nd_vdc") * r50).cast("double").alias("total_savings"))


def savings_from_usage(usage: DataFrame, ranks: Iterable[tuple[str, str]], tiebreak: Sequence[str], fiscal_year: int,
                       key: str = "encounter_id", scope_key: str = "record_number") -> DataFrame:
    """A09, A10, A12-A15 in one derivation: the savings of unclean, unranked usage rows.

    Equal to ``savings(adjacent_rows(rank_codes(clean_usage(usage))))``, with
    one scan of ``usage`` and three exchanges: usage rows are combined to day
    states (by day, combined map-side), these go to their record number, where
    encounters, days before and scope flags are found, and one row per task
    goes to the total.  ``scope_key`` must be a function of ``key`` (an
    encounter has one record number), or the same column.

    A state holds one day: a row per day of stay, never the rows of a day.
    Rows that tie in the whole ordering key count as in :func:`adjacent_rows`.
    """
    u = rank_codes(usage, ranks)
    timed = col("service_ts").isNotNull()
    first = F.min(F.struct(*_full_order(u, tiebreak, key))).alias("f")
    bad = F.max(F.coalesce((col("uos") <= 0) | (col("vdc") <= 0), lit(False)) & col(key).isNotNull()).alias("bad")
    # Of rows without a time only their place counts, not what they used.
    keys = list(dict.fromkeys((scope_key, key)))
    day = u.groupBy(*keys, "service_date").agg(
        first, bad, F.count(lit(1)).alias("n"), F.count("service_ts").alias("n_timed"),
        *[F.sum(F.when(timed, col(c))).alias(f"s_{c}") for c in ("uos", "vdc")])

    stay = Window.partitionBy(*keys)
    before = stay.orderBy("service_date")
    day = (day.repartition(scope_key)
           .withColumn("_bad", F.max("bad").over(stay)).where(~col("_bad"))
           .withColumn("diff", F.coalesce(F.date_diff(col("service_date"), F.lag("service_date").over(before)), lit(NEW_ENCOUNTER))))
    f_timed = col("f.service_ts").isNotNull()

    def others(c: str):  # the sum over the rows of the day but the first
        return F.coalesce(col(f"s_{c}"), lit(0)) - F.when(f_timed, F.coalesce(col(f"f.{c}"), lit(0))).otherwise(lit(0))

    more = col("f.uos") > 1
    first_vdc = F.when(f_timed & more, (col("f.uos") - 1) * col("f.unit_cost"))
    next_day = f_timed & (col("diff") == 1)
    scope = day.where(col(scope_key).isNotNull()).groupBy(scope_key).agg(
        F.sum("n_timed").alias("n_timed"),
        F.max((col("n") > 1) | F.coalesce(more, lit(False))).alias("in_same"), F.max(col("diff") == 1).alias("in_next"),
        F.sum(others("uos") + F.when(f_timed, F.coalesce(col("f.uos") - 1, lit(0))).otherwise(lit(0))).alias("sd_uos"),
        F.sum((others("vdc") + F.coalesce(first_vdc, lit(0))).cast("decimal(38,4)")).alias("sd_vdc"),
        F.sum(next_day.cast("int")).alias("nd_uos"),
        F.sum(F.when(next_day, F.coalesce(col("f.unit_cost"), lit(0))).otherwise(lit(0)).cast("decimal(38,4)")).alias("nd_vdc"))
    a = scope.where(col("n_timed") > 0).agg(*[F.sum(F.when(col(f), col(c))).alias(c) for f, c in
                    (("in_same", "sd_uos"), ("in_same", "sd_vdc"), ("in_next", "nd_uos"), ("in_next", "nd_vdc"))])
    return _savings_report(a, fiscal_year)
