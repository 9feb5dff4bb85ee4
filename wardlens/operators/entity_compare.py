"""Cross-entity charge-code comparison.

The reference walks a work list of (entity, setting, service line) groups
in a WHILE loop, re-scanning the encounter and bill tables on each pass.
Set-based here: one aggregate of code usage for *all* groups, then running
sums over the entities that use a code, ordered by cost per case: what the
cheaper entities sum to is a prefix, less the own entity's part of it.  So no
pair of entities is formed; :func:`comparison_pairs` has them for who asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.exact import int_avg, money_sum, ratio
from wardlens.operators.redundancy import billing_source_systems
from wardlens.operators._keys import join_costs, line_key_columns
from wardlens.params import EntityCompareParams

col, lit = F.col, F.lit
GROUP = ["entity", "patient_setting", "service_line"]
CODE = ["full_charge_code_description", "cost_driver", "cc_rollup"]

HIGHER = "Over 5% Higher Utilization than other entities"
LOWER = "Over 5% Lower Utilization than other entities"
WITHIN = "Within 5% Utilization of other entities"


def encounter_base(enc: DataFrame, source_system: DataFrame, physician: DataFrame,
                   p: EntityCompareParams) -> DataFrame:
    """Encounters of the year from billing sources with a positive charge."""
    e = (enc.where(col("fiscal_year").isin(list(p.fiscal_years)) & (col("has_charge") == "Yes"))
         .join(billing_source_systems(source_system, p.source_category_id), "source_system_id", "left_semi"))
    md = physician.select(col("physician_id").alias("attend_physician_id"),
                          col("full_name").alias("primary_md"), col("specialty").alias("primary_md_spec"))
    return e.join(md, "attend_physician_id").select(
        "encounter_id", "record_number", *GROUP, "primary_md", "primary_md_spec")


def with_service_line(enc: DataFrame, dimension: DataFrame, key: str, name_col: str) -> DataFrame:
    """Take the service line from the client-configured dimension."""
    d = dimension.select(key, col(name_col).alias("service_line"))
    return enc.drop("service_line").join(d, key)


def bill(enc: DataFrame, lines: DataFrame, costs: DataFrame, charge_code: DataFrame,
         p: EntityCompareParams) -> DataFrame:
    """Encounter x charge code UOS and VDC (lines without cost drop out).

    Facts that carry the encounter's fiscal year are read for the years in
    question only: where they are partitioned by it, other folders are pruned.
    """
    lines, costs = (f.where(col("fiscal_year").isin(list(p.fiscal_years))) if "fiscal_year" in f.columns else f for f in (lines, costs))
    cc = charge_code.where(~col("cost_driver").isin(list(p.excluded_drivers))).select(
        "charge_code_id", "cost_driver", col("rollup_name").alias("cc_rollup"),
        col("name").alias("full_charge_code_description"))
    # Encounters of the year and codes first: only their lines meet the cost fact.
    l = (lines.select(*line_key_columns(lines, costs), "encounter_id", "charge_code_id", "units")
         .join(enc.withColumnRenamed("encounter_id", "_enc"), col("encounter_id") == col("_enc")).drop("_enc")
         .join(cc, "charge_code_id"))
    keys = [c for c in enc.columns]
    return join_costs(l, costs, "inner").groupBy(*keys, *CODE).agg(
        F.sum("units").cast("decimal(38,2)").alias("uos"),
        money_sum(col("units") * col("unit_cost")).alias("vdc"))


def bill_by_encounter(b: DataFrame) -> DataFrame:
    """Encounter-level VDC."""
    return b.groupBy("encounter_id", *GROUP).agg(F.sum("vdc").alias("vdc"))


def work_list(bill_enc: DataFrame, p: EntityCompareParams) -> DataFrame:
    """Groups above the VDC floor; with ``worklist_size``, the top N by VDC then cases (top-k plan)."""
    g = bill_enc.groupBy(*GROUP).agg(F.count(lit(1)).alias("cases"), F.sum("vdc").alias("vdc"))
    g = g.where(col("vdc") > lit(p.min_group_vdc))
    if p.worklist_size is None:
        return g
    return g.orderBy(col("vdc").desc(), col("cases").desc(), *GROUP).limit(p.worklist_size)


def first_setting_per_line(worklist: DataFrame) -> DataFrame:
    """A26 compat: the reference loop marks every setting of an (entity,
    line) done after its first pass, so only the top setting is compared."""
    w = Window.partitionBy("entity", "service_line").orderBy(col("vdc").desc(), col("cases").desc(), "patient_setting")
    return worklist.withColumn("_rn", F.row_number().over(w)).where(col("_rn") == 1).drop("_rn")


def group_volumes(enc: DataFrame) -> DataFrame:
    """Distinct encounters per (entity, setting, line), from encounters."""
    return enc.groupBy(*GROUP).agg(F.count_distinct("encounter_id").alias("tot_cases"))


def code_usage(b: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per group and charge code: cases, VDC, VDC per case, group cases.

    ``bill`` is unique per (encounter, code), so count(*) is the number of
    distinct encounters using the code.  VDC per case keeps 6 decimals, as
    the reference's decimal division does.
    """
    u = b.groupBy(*CODE, *GROUP).agg(F.count(lit(1)).alias("cases"), F.sum("vdc").alias("vdc"))
    u = u.join(volumes, GROUP)
    return u.withColumn("vdc_per_case", ratio(col("vdc"), 4, col("cases"), 0, 6))


def comparison_pairs(usage: DataFrame, worklist: DataFrame) -> DataFrame:
    """Each work-list group's code rows against the same code at the
    other entities of the same setting and line (left join; NULL = none).

    ``usage`` is unique per (code, driver, rollup, entity, setting, line)
    and both rows' keys are in the output, so every pair is already a
    distinct row: the reference's GROUP BY over all columns needs no
    shuffle here.
    """
    a = usage.join(worklist.select(*GROUP), GROUP, "left_semi").alias("a")
    b = usage.alias("b")
    cond = ((col("a.full_charge_code_description") == col("b.full_charge_code_description"))
            & (col("a.cost_driver") == col("b.cost_driver"))
            & (col("a.service_line") == col("b.service_line"))
            & (col("a.patient_setting") == col("b.patient_setting"))
            & (col("a.entity") != col("b.entity")))
    j = a.join(b, cond, "left")
    return j.select(
        col("a.full_charge_code_description").alias("full_cc_description"),
        col("a.cost_driver").alias("cost_driver"),
        col("a.cc_rollup").alias("cc_rollup"),
        col("b.cc_rollup").alias("comparison_cc_rollup"),
        col("a.patient_setting").alias("patient_setting"),
        col("a.service_line").alias("service_line"),
        col("a.entity").alias("entity_of_interest"),
        col("b.entity").alias("comparison_entity"),
        (col("a.vdc_per_case") - col("b.vdc_per_case")).alias("cost_per_case_diff"),
        col("a.vdc_per_case").alias("eoi_vdc_per_case"),
        F.coalesce(col("b.vdc_per_case"), lit(0)).alias("other_entity_vdc_per_case"),
        ratio(col("a.cases"), 0, col("a.tot_cases"), 0, 6).alias("eoi_case_vol_perc"),
        ratio(col("b.cases"), 0, col("b.tot_cases"), 0, 6).alias("other_entities_case_vol_perc"),
        col("a.cases").alias("eoi_cases"),
        col("a.tot_cases").alias("eoi_tot_cases"),
        F.coalesce(col("b.cases"), lit(0)).alias("other_entity_cases"),
        F.coalesce(col("b.tot_cases"), lit(0)).alias("other_entity_tot_cases"),
        col("a.vdc").alias("eoi_vdc"),
        F.coalesce(col("b.vdc"), lit(0)).alias("other_entity_vdc"),
    )


def unique_codes(pairs: DataFrame) -> DataFrame:
    """Codes no other entity uses, with positive EOI VDC.

    An unmatched code row yields exactly one pair row, keyed by its
    (code, driver, rollup, entity, setting, line): already distinct.
    """
    return _unique_report(pairs.where(col("comparison_entity").isNull()))


def _unique_report(rows: DataFrame) -> DataFrame:
    return rows.where(col("eoi_vdc") > 0).select(
        col("full_cc_description").alias("charge_codes_unique_to_entity_of_interest"), "cost_driver",
        col("cc_rollup").alias("charge_code_rollup"),
        "entity_of_interest", "patient_setting", "service_line",
        col("eoi_case_vol_perc").cast("decimal(20,2)").alias("eoi_case_perc"),
        col("eoi_cases").cast("int").alias("eoi_cases"),
        col("eoi_tot_cases").cast("int").alias("eoi_tot_cases"),
        col("eoi_vdc").cast("decimal(20,2)").alias("eoi_vdc"),
        col("eoi_vdc_per_case").cast("decimal(20,2)").alias("eoi_vdc_per_case"))


def overlapping_codes(pairs: DataFrame, band: str = "0.05") -> DataFrame:
    """Codes where cheaper comparators exist; impact = avg diff x EOI cases.

    Comparator averages are over the cheaper comparators only (the filter
    precedes the average, as in the reference).
    """
    keys = ["full_cc_description", "cost_driver", "cc_rollup", "patient_setting", "service_line",
            "entity_of_interest", "eoi_case_vol_perc", "eoi_tot_cases", "eoi_cases", "eoi_vdc_per_case"]
    p = pairs.where(col("comparison_entity").isNotNull() & (col("cost_per_case_diff") > 0))
    # Two levels instead of count(distinct comparator): per comparator
    # entity first, then per code row (the row count is the number of
    # distinct comparators), so pair rows are not expanded.
    # Sums run on exact micro-unit longs (the 6-decimal values scaled by
    # 1e6), which aggregate much faster than wide decimals; each average is
    # one exact division per output row.
    micro = lambda c: (col(c) * 1000000).cast("long")
    per_entity = p.groupBy(*keys, "comparison_entity").agg(
        F.count(lit(1)).alias("_n"),
        F.sum(micro("cost_per_case_diff")).alias("_s_diff"),
        F.sum(micro("other_entity_vdc_per_case")).alias("_s_vpc"),
        F.sum(micro("other_entities_case_vol_perc")).alias("_s_perc"),
        F.count("other_entities_case_vol_perc").alias("_n_perc"),
        F.sum("other_entity_cases").alias("_s_cases"),
        F.sum("other_entity_tot_cases").alias("_s_tot"))
    g = per_entity.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("_n", "_s_diff", "_s_vpc", "_s_perc", "_n_perc", "_s_cases", "_s_tot")],
        F.count(lit(1)).alias("_n_ent"))
    return _overlap_report(g, band)


def _overlap_report(g: DataFrame, band: str) -> DataFrame:
    avg = lambda s, n: ratio(col(s), 0, col(n) * 1000000, 0, 6)
    avg_diff = avg("_s_diff", "_n")
    avg_perc = avg("_s_perc", "_n_perc")
    gap = col("eoi_case_vol_perc") - avg_perc
    b = lit(band).cast("decimal(10,4)")
    label = F.when(gap > b, HIGHER).when(gap < -b, LOWER).otherwise(WITHIN)
    return g.select(
        col("full_cc_description").alias("overlapping_charge_codes"),
        (avg_diff * col("eoi_cases")).cast("decimal(20,2)").alias("impact_dollars"),
        label.alias("utilization_comparison"),
        "cost_driver", col("cc_rollup").alias("charge_code_rollup"), "patient_setting", "service_line",
        "entity_of_interest",
        col("_n_ent").cast("int").alias("num_other_entities"),
        avg_diff.cast("decimal(20,2)").alias("avg_cost_per_case_diff"),
        col("eoi_vdc_per_case").cast("decimal(20,2)").alias("eoi_vdc_per_case"),
        avg("_s_vpc", "_n").cast("decimal(20,2)").alias("avg_other_entity_vdc_per_case"),
        col("eoi_case_vol_perc").cast("decimal(20,2)").alias("eoi_case_perc"),
        avg_perc.cast("decimal(20,2)").alias("avg_other_entity_case_perc"),
        col("eoi_cases").cast("int").alias("eoi_cases"),
        int_avg(col("_s_cases"), col("_n")).alias("avg_other_entity_cases"),
        col("eoi_tot_cases").cast("int").alias("eoi_tot_cases"),
        int_avg(col("_s_tot"), col("_n")).alias("avg_other_entity_tot_cases"))


def work_groups(usage: DataFrame, p: EntityCompareParams) -> DataFrame:
    """A20 without a top N, from the code usage: the groups above the VDC floor (a group's VDC is the sum over its codes)."""
    return usage.groupBy(*GROUP).agg(F.sum("vdc").alias("vdc")).where(col("vdc") > lit(p.min_group_vdc))


def compared_usage(usage: DataFrame) -> DataFrame:
    """A23 without pairs: each code row with what the other entities' rows of its code, setting and line sum to.

    ``others`` is their number; the ``_`` columns are over the cheaper ones
    (a lower cost per case, ties are not cheaper): rows, entities and sums.
    They are running sums in the order of cost per case, of the whole code
    group less the own entity; both share one exchange by code group.  A code
    group has a row for each entity and rollup that uses the code, so a window
    holds at most as many rows as the entity dimension has, times the rollups;
    work is linear in these rows.  A row with a NULL in the group key or the
    entity compares with nothing, as in the join.
    """
    key = ["full_charge_code_description", "cost_driver", "service_line", "patient_setting"]
    known = col("entity").isNotNull()
    for c in key:
        known = known & col(c).isNotNull()
    perc = ratio(col("cases"), 0, col("tot_cases"), 0, 6)
    u = usage.where(known).withColumns({"_m": (col("vdc_per_case") * 1000000).cast("long"), "_perc": perc})
    u = u.withColumn("_p", (col("_perc") * 1000000).cast("long"))
    group, own = Window.partitionBy(*key), Window.partitionBy(*key, "entity")
    u = u.withColumn("_lowest", F.min("_m").over(own))
    # One row of each entity stands for it: the first of its cheapest.
    u = u.withColumn("_stands", (col("_m").isNotNull() & (F.row_number().over(own.orderBy(col("_m").asc_nulls_last(), "cc_rollup")) == 1)).cast("int"))
    priced = col("_m").isNotNull()
    sums = {"_n": priced.cast("int"), "_s_vpc": col("_m"), "_s_perc": F.when(priced, col("_p")),
            "_n_perc": (priced & col("_p").isNotNull()).cast("int"), "_s_cases": F.when(priced, col("cases")),
            "_s_tot": F.when(priced, col("tot_cases")), "_n_ent": col("_stands")}

    def cheaper(over, c):
        return F.coalesce(F.sum(c).over(over.orderBy("_m").rangeBetween(Window.unboundedPreceding, -1)), lit(0))

    less = {"_n_ent": (col("_lowest") < col("_m")).cast("int")}
    out = {k: F.when(priced, cheaper(group, c) - (less[k] if k in less else cheaper(own, c))).otherwise(lit(0)) for k, c in sums.items()}
    u = u.withColumns({**out, "others": F.count(lit(1)).over(group) - F.count(lit(1)).over(own)})
    alone = usage.where(~known).withColumns({"_m": lit(None).cast("long"), "_perc": perc, "others": lit(0),
                                             **{k: lit(0) for k in sums}})
    columns = [*usage.columns, "_m", "_perc", "others", *sums]
    return u.select(columns).union(alone.select(columns)).withColumn("_s_diff", col("_n") * col("_m") - col("_s_vpc"))


def _of_interest(compared: DataFrame, worklist: DataFrame) -> DataFrame:
    return compared.join(worklist.select(*GROUP), GROUP, "left_semi").select(
        col("full_charge_code_description").alias("full_cc_description"), "cost_driver", "cc_rollup", "patient_setting",
        "service_line", col("entity").alias("entity_of_interest"), col("_perc").alias("eoi_case_vol_perc"),
        col("tot_cases").alias("eoi_tot_cases"), col("cases").alias("eoi_cases"), col("vdc").alias("eoi_vdc"),
        col("vdc_per_case").alias("eoi_vdc_per_case"), "others", "_n", "_n_ent", "_s_diff", "_s_vpc", "_s_perc", "_n_perc", "_s_cases", "_s_tot")


def unique_usage(usage: DataFrame, worklist: DataFrame) -> DataFrame:
    """A24 without pairs: equal to ``unique_codes(comparison_pairs(usage, worklist))``."""
    return _unique_report(_of_interest(compared_usage(usage), worklist).where(col("others") == 0))


def overlapping_usage(usage: DataFrame, worklist: DataFrame, band: str = "0.05") -> DataFrame:
    """A25 without pairs: equal to ``overlapping_codes(comparison_pairs(usage, worklist), band)``, linear in the entities."""
    return _overlap_report(_of_interest(compared_usage(usage), worklist).where(col("_n") > 0), band)


def reports(enc: DataFrame, lines: DataFrame, costs: DataFrame, charge_code: DataFrame,
            p: EntityCompareParams, compat_first_setting: bool = False,
            checkpoint: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both reports, ordered as the reference prints them.

    The code usage feeds both; with ``checkpoint`` it is cut from its lineage
    in the shared checkpoint folder, so it is derived from the line fact once.
    Only a top-N work list needs the bill by encounter besides.
    """
    b = bill(enc, lines, costs, charge_code, p)
    usage = code_usage(b, group_volumes(enc))
    if checkpoint:
        from wardlens.session import materialize
        usage = materialize(usage)
    wl = work_groups(usage, p) if p.worklist_size is None and not compat_first_setting else work_list(bill_by_encounter(b), p)
    if compat_first_setting:
        wl = first_setting_per_line(wl)
    uniq = unique_usage(usage, wl).orderBy(col("eoi_vdc").desc(), "charge_codes_unique_to_entity_of_interest",
                                        "entity_of_interest", "patient_setting", "service_line")
    over = overlapping_usage(usage, wl, p.band).orderBy(col("impact_dollars").desc(), "overlapping_charge_codes",
                                                     "entity_of_interest", "patient_setting", "service_line")
    return uniq, over
