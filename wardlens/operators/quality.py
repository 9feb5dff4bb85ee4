"""Quality-event association: event vs control cost drivers and a 2x2 test.

Both groups come from one function (the reference duplicates the query
with different column names); the 2x2 table per cost driver is built from
pre-aggregated counts, never from the many-to-many join of the two groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.exact import money_sum, ratio
from wardlens.functions.ranking import group_row_number
from wardlens.functions.text import norm_text
from wardlens.operators._keys import join_costs, line_key_columns
from wardlens.params import QualityParams

col, lit = F.col, F.lit

ATTRS = ["fiscal_year", "entity", "encounter_id", "msdrg_case_type_family", "patient_population",
         "attend_physician_name", "attend_physician_specialty", "age_cohort", "age", "gender",
         "risk_of_mortality", "severity_of_illness", "los", "patient_setting"]


def _population(indicator: DataFrame, names) -> DataFrame:
    # One row per encounter (largest matching name): an encounter with
    # several indicators must not multiply its billing lines later.
    return (indicator.where(col("name").isin(list(names)))
            .groupBy("encounter_id").agg(F.max("name").alias("patient_population")))


def quality_encounters(enc: DataFrame, source_system: DataFrame, physician: DataFrame,
                       indicator: DataFrame, gender: DataFrame, apr_drg: DataFrame, age_cohort: DataFrame,
                       p: QualityParams, ctf_col: str = "service_line", compat_fanout: bool = False) -> DataFrame:
    """Inpatient encounters of the population with their attributes.

    One row per encounter: every join is to a keyed dimension and the
    indicator bridge is reduced to one row per encounter first, so the
    reference's SELECT DISTINCT needs no shuffle.

    ``population_kind='ctf'`` selects by case-type family (indicator names
    attached where present); ``'indicator'`` selects by clinical indicator.
    ``compat_fanout`` keeps the reference's left join to the indicator
    bridge as written: an encounter with a matching and a non-matching
    indicator yields two rows (named and NULL), doubling its lines later.
    """
    src = source_system.where(col("category_name") == p.source_category_name).select("source_system_id", "category_name")
    e = (enc.where((col("fiscal_year") == p.fiscal_year) & (col("has_charge") == "Yes")
                   & col("patient_setting").isin(list(p.inpatient_settings)) & (col("attend_physician_id") != 0))
         .join(src, "source_system_id"))
    pop = _population(indicator, p.population)
    if compat_fanout and p.population_kind == "ctf":
        pop = indicator.select("encounter_id", F.when(col("name").isin(list(p.population)), col("name"))
                               .alias("patient_population")).distinct()
    if p.population_kind == "ctf":
        e = e.where(col(ctf_col).isin(list(p.population))).join(pop, "encounter_id", "left")
    elif p.population_kind == "indicator":
        e = e.join(pop, "encounter_id")
    else:
        raise ValueError(p.population_kind)
    md = physician.select(col("physician_id").alias("attend_physician_id"),
                          col("full_name").alias("attend_physician_name"),
                          col("specialty").alias("attend_physician_specialty"))
    e = (e.join(md, "attend_physician_id")
         .join(gender.select("gender_id", col("description").alias("gender")), "gender_id")
         .join(apr_drg.select("apr_drg_id", col("aprrom").alias("risk_of_mortality"),
                              col("aprsoi").alias("severity_of_illness")), "apr_drg_id")
         .join(age_cohort.select("age_cohort_id", col("name").alias("age_cohort")), "age_cohort_id"))
    return e.select(
        "encounter_id", col(ctf_col).alias("msdrg_case_type_family"), "patient_population", "fiscal_year",
        col("category_name").alias("source_system_category"), "patient_setting", "attend_physician_name",
        "attend_physician_specialty", "entity", "age_cohort", "age", "gender", "risk_of_mortality",
        "severity_of_illness", "los", "primary_qvi_id")


def procedure_dates(lines: DataFrame, encounters: DataFrame, cpt: DataFrame, cpt_codes,
                    by_date: bool = False) -> DataFrame:
    """Distinct (encounter, day, datetime) of the procedure of interest.

    As in the reference, two times on one day are two procedures; with
    ``by_date`` a day counts once (its first time is kept).
    """
    c = cpt.where(col("cpt_code").isin(list(cpt_codes))).select("cpt_id")
    p = (lines.select("encounter_id", "cpt_id", "service_date", "service_ts").join(c, "cpt_id")
         .join(encounters.select("encounter_id"), "encounter_id", "left_semi"))
    if by_date:
        return p.groupBy("encounter_id", "service_date").agg(F.min("service_ts").alias("service_ts"))
    return p.select("encounter_id", "service_date", "service_ts").distinct()


def procedure_order(proc_dates: DataFrame) -> DataFrame:
    """Procedure order within the encounter (one row per procedure time),
    numbered without holding an encounter's procedures in one task."""
    return group_row_number(proc_dates, ["encounter_id"], ["service_date", "service_ts"], "proc_order") \
        .withColumn("proc_order", col("proc_order").cast("int"))


def single_procedure(proc_dates: DataFrame) -> DataFrame:
    """Encounters with exactly one procedure time (max order = count)."""
    return (proc_dates.groupBy("encounter_id").agg(F.count(lit(1)).cast("int").alias("maxproc"))
            .where(col("maxproc") == 1))


def phase(proc_ts, charge_ts):
    """Charge timing relative to the procedure, by calendar days."""
    d = F.date_diff(F.to_date(charge_ts), F.to_date(proc_ts))
    return (F.when(d < 0, "Before Proc").when(d > 0, "After Proc").when(d == 0, "Day of Proc")
            .otherwise("NA"))


def _group_lines(encounter_keys, proc_dates, lines, costs, charge_code, ub_revenue_code, p: QualityParams):
    """Billing lines of single-procedure encounters in ``encounter_keys``
    (encounter id plus group-label columns), with the procedure time.

    The cost driver is that of the line's UB revenue code; the excluded
    driver is compared without regard to case and outer blanks.
    """
    # Single-procedure encounters have order 1 and one procedure time, so
    # one aggregate gives both (no window, no self join of the dates).
    proc = (proc_dates.groupBy("encounter_id")
            .agg(F.count(lit(1)).cast("int").alias("maxproc"), F.min("service_ts").alias("proc_date"))
            .where(col("maxproc") == 1))
    ub = ub_revenue_code.where(norm_text(col("cost_driver")) != norm_text(lit(p.excluded_driver))).select(
        "ub_revenue_code_id", "cost_driver")
    cc = charge_code.select("charge_code_id", col("description").alias("charge_code_desc"))
    # The few encounters come first: only their lines meet the cost fact.
    l = (lines.select(*line_key_columns(lines, costs), "encounter_id", "charge_code_id", "ub_revenue_code_id",
                      "service_ts", "units")
         .join(encounter_keys.join(proc, "encounter_id"), "encounter_id")
         .join(ub, "ub_revenue_code_id").join(cc, "charge_code_id"))
    return join_costs(l, costs, "left")


def _aggregate_group(j: DataFrame, label, encounters: DataFrame) -> DataFrame:
    """Sum VDC on the line-level keys, then attach the encounter attributes.

    The attributes depend on the encounter only, so they are joined after
    the aggregate instead of riding through its shuffle as 16 extra keys.
    """
    keys = [label.alias("qvi"), "encounter_id", phase(col("proc_date"), col("service_ts")).alias("date_of_service"),
            col("maxproc").alias("total_proc"), "proc_date", col("service_ts").alias("charge_service_date"),
            "cost_driver", "charge_code_desc"]
    agg = j.groupBy(*keys).agg(money_sum(col("unit_cost") * col("units")).alias("vdc"))
    return agg.join(encounters.select(*ATTRS), "encounter_id").select(
        "qvi", *ATTRS, "date_of_service", "total_proc", "proc_date", "charge_service_date", "cost_driver",
        "charge_code_desc", "vdc")


def event_group(encounters, proc_dates, lines, costs, charge_code, ub_revenue_code, qvi,
                p: QualityParams) -> DataFrame:
    """Single-procedure encounters with a selected quality event."""
    q = qvi.where(col("qvi_name").isin(list(p.qvi_names))).select("encounter_id", "qvi_name")
    keys = encounters.select("encounter_id").join(q, "encounter_id")
    return _aggregate_group(_group_lines(keys, proc_dates, lines, costs, charge_code, ub_revenue_code, p),
                            col("qvi_name"), encounters)


def control_group(encounters, proc_dates, lines, costs, charge_code, ub_revenue_code, p: QualityParams) -> DataFrame:
    """Single-procedure encounters without any quality event."""
    keys = encounters.where(col("primary_qvi_id") == 0).select("encounter_id")
    return _aggregate_group(_group_lines(keys, proc_dates, lines, costs, charge_code, ub_revenue_code, p),
                            lit(p.control_label), encounters)


def driver_summary(groups: DataFrame, control_label: str, event_label: str = "Quality event") -> DataFrame:
    """Per cost driver of the event and the control group: cases, group cases, VDC per case.

    All selected quality events are one group, as in the 2x2 table.
    """
    g = groups.withColumn("event_group", F.when(col("qvi") == control_label, control_label).otherwise(event_label))
    per = g.groupBy("event_group", "cost_driver").agg(
        F.count_distinct("encounter_id").alias("cases"), F.sum("vdc").alias("_vdc"))
    tot = g.groupBy("event_group").agg(F.count_distinct("encounter_id").alias("totcases"))
    return per.join(tot, "event_group").select(
        "event_group", "cost_driver", "cases", "totcases",
        ratio(col("_vdc"), 4, col("cases"), 0, 6).alias("vdc_per_case"))


def chi_base(groups: DataFrame, control_label: str) -> DataFrame:
    """Per driver, treated and total encounters in event and control groups."""
    is_con = col("qvi") == control_label
    g = groups.select(is_con.alias("_con"), "cost_driver", "encounter_id")
    con = col("_con")
    # distinct (group, driver, encounter) first, then plain sums: no Expand
    per = (g.distinct()
           .groupBy("cost_driver").agg(F.sum(F.when(~con, 1).otherwise(0)).alias("qvi_trmt"),
                                       F.sum(F.when(con, 1).otherwise(0)).alias("con_trmt")))
    tot = (g.select("_con", "encounter_id").distinct()
           .agg(F.sum(F.when(~con, 1).otherwise(0)).alias("qvi_tot"),
                F.sum(F.when(con, 1).otherwise(0)).alias("con_tot")))
    # ``tot`` is a global aggregate: exactly one row, broadcast on a constant key.
    j = per.withColumn("_k", lit(1)).join(F.broadcast(tot.withColumn("_k", lit(1))), "_k").drop("_k")
    return j.select("cost_driver", *[col(c).cast("bigint").alias(c) for c in ("qvi_trmt", "qvi_tot", "con_trmt", "con_tot")])


def chi_rows(base: DataFrame) -> DataFrame:
    """Untreated counts and treated percentages (2 decimals)."""
    return base.select(
        "cost_driver", "qvi_trmt", (col("qvi_tot") - col("qvi_trmt")).alias("qvi_no_trmt"), "qvi_tot",
        ratio(col("qvi_trmt") * 100, 0, col("qvi_tot"), 0, 2, 19).alias("qvi_trmt_perc"),
        "con_trmt", (col("con_tot") - col("con_trmt")).alias("con_no_trmt"), "con_tot",
        ratio(col("con_trmt") * 100, 0, col("con_tot"), 0, 2, 19).alias("con_trmt_perc"))


def chi_cols(rows: DataFrame) -> DataFrame:
    """Treated, untreated and grand totals."""
    return rows.select(
        "cost_driver",
        (col("qvi_trmt") + col("con_trmt")).cast("decimal(19,2)").alias("trmt_tot"),
        (col("qvi_no_trmt") + col("con_no_trmt")).cast("decimal(19,2)").alias("no_trmt_tot"),
        (col("qvi_tot") + col("con_tot")).cast("decimal(19,2)").alias("grand_tot"))


def chi_expected(rows: DataFrame) -> DataFrame:
    """Expected counts of the four cells, rounded to 2 decimals."""
    trmt = col("qvi_trmt") + col("con_trmt")
    no = col("qvi_no_trmt") + col("con_no_trmt")
    grand = col("qvi_tot") + col("con_tot")
    e = lambda a, b: ratio(a * b, 0, grand, 0, 2, 19)
    return rows.select(
        "cost_driver", e(col("qvi_tot"), trmt).alias("exp_qvi_trmt"), e(col("qvi_tot"), no).alias("exp_qvi_no_trmt"),
        e(col("con_tot"), trmt).alias("exp_con_trmt"), e(col("con_tot"), no).alias("exp_con_no_trmt"))


CELLS = [("qvi_trmt", "exp_qvi_trmt"), ("qvi_no_trmt", "exp_qvi_no_trmt"),
         ("con_trmt", "exp_con_trmt"), ("con_no_trmt", "exp_con_no_trmt")]


def chi_diff(rows: DataFrame, expected: DataFrame, compat_rounding: bool = False) -> DataFrame:
    """Cell contributions (O - E)^2 / E, 0 where E = 0.

    ``compat_rounding`` multiplies by the first cell's deviation, as the
    reference text does (identical unless rounding of E differs by cell).
    """
    j = rows.join(expected, "cost_driver")
    first = F.abs(col("qvi_trmt") - col("exp_qvi_trmt"))
    out = []
    for o, e in CELLS:
        dev = F.abs(col(o) - col(e))
        num = dev * (first if compat_rounding else dev)
        out.append(F.coalesce(ratio(num, 4, col(e), 2, 6), lit(0).cast("decimal(38,6)")).alias("diff_" + o))
    return j.select("cost_driver", *out)


def chi_label(rows: DataFrame, diff: DataFrame, critical: str = "3.841") -> DataFrame:
    """Significance label per cost driver."""
    j = diff.join(rows, "cost_driver")
    chi = col("diff_qvi_trmt") + col("diff_qvi_no_trmt") + col("diff_con_trmt") + col("diff_con_no_trmt")
    sig = chi > lit(critical).cast("decimal(10,3)")
    label = (F.when(sig & (col("qvi_trmt_perc") > col("con_trmt_perc")), "Statistically Higher Utilization")
             .when(sig & (col("qvi_trmt_perc") < col("con_trmt_perc")), "Statistically Lower Utilization")
             .otherwise("Not Statistical Difference"))
    return j.select("cost_driver", chi.alias("chi_square"), label.alias("significance"))


def quality_groups(encounters, proc_dates, lines, costs, charge_code, ub_revenue_code, qvi,
                   p: QualityParams) -> DataFrame:
    """A34 + A35 in one pass over the encounter x procedure x line chain.

    Each encounter carries the list of group labels it belongs to (its
    selected quality events, plus the control label when it has none) and
    rows are exploded per label, so an encounter in both groups appears in
    both, as with the two separate queries.
    """
    q = (qvi.where(col("qvi_name").isin(list(p.qvi_names)))
         .groupBy("encounter_id").agg(F.collect_set("qvi_name").alias("_events")))
    e = encounters.select("encounter_id", "primary_qvi_id").join(q, "encounter_id", "left")
    empty = F.array().cast("array<string>")
    ctrl = F.when(col("primary_qvi_id") == 0, F.array(lit(p.control_label))).otherwise(empty)
    keys = (e.select("encounter_id", F.concat(F.coalesce(col("_events"), empty), ctrl).alias("_labels"))
            .where(F.size("_labels") > 0))
    j = _group_lines(keys, proc_dates, lines, costs, charge_code, ub_revenue_code, p)
    j = j.withColumn("_label", F.explode("_labels"))
    return _aggregate_group(j, col("_label"), encounters)
