"""Query registry: every analysis wired onto the test tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and runs the library
operator over the whole adapted tables, with the parameters below standing
in for the reference's hand-edited placeholders.
"""

from __future__ import annotations

import uuid as _uuid
from collections.abc import Callable
from dataclasses import replace as _replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.bins import DONOR_AGE_COMPAT, DONOR_BMI
from wardlens.functions.bins import DONOR_BINS as _BINS
from wardlens.functions.distinct import distinct_counts, distinct_state
from wardlens.functions.drg import category_ranges
from wardlens.operators import benchmark as bm
from wardlens.operators import cohort as co
from wardlens.operators import contingency as ct
from wardlens.operators import drg as drg_ops
from wardlens.operators import entity_compare as ent
from wardlens.operators import opportunity as opp
from wardlens.operators import quality as qa
from wardlens.operators import redundancy as red
from wardlens.params import (CohortCriteria, DonorCohortParams, EntityCompareParams, OpportunitySpec,
                             QualityParams, RedundancyParams)
from wardlens.session import ensure_checkpoint_dir, materialize
from wardlens.sources.clients import ClientDatabases, publish_clients
from wardlens.sources.collation import collated, plain
from wardlens.sources.reports import ReportStore
from wardlens.sources.tables import ParquetTables
from wardlens.sources.warehouse import bucket_count, co_located

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def fx(spark: SparkSession, sf_dir: str):
    return ParquetTables(spark, sf_dir).fixtures


# ------------------------------------------------------------ parameters
OPP_YEARS = (1996, 1997)
OPP_KEYWORDS = ("widget", "bolt")
OPP_CATEGORY = "PROMO"
OPP_SPECS = (
    OpportunitySpec("Widget reduction", "reduction", "PROMO", ("widget",)),
    OpportunitySpec("Fastener substitution", "substitution", "ECONOMY", ("bolt", "gear")),
    OpportunitySpec("Ring review", "reduction", "PROMO", ("ring", "red")),
)


# ----------------------------------------------------------- opportunity
@register("opp_codes")
def q_opp_codes(spark, sf):
    return opp.pick_charge_codes(fx(spark, sf).charge_code, OPP_KEYWORDS, OPP_CATEGORY)


def _opp_summary(spark, sf):
    f = fx(spark, sf)
    codes = opp.pick_charge_codes(f.charge_code, OPP_KEYWORDS, OPP_CATEGORY)
    return opp.opportunity_summary(f.line, f.cost, codes, OPP_YEARS)


@register("opp_summary")
def q_opp_summary(spark, sf):
    return _opp_summary(spark, sf)


@register("opp_rollup")
def q_opp_rollup(spark, sf):
    return opp.opportunity_rollup(_opp_summary(spark, sf), "Widget and bolt review", "reduction", OPP_CATEGORY)


@register("opp_multi")
def q_opp_multi(spark, sf):
    f = fx(spark, sf)
    return opp.multi_opportunity_report(f.line, f.cost, f.charge_code, OPP_SPECS, OPP_YEARS)


@register("opp_replace")
def q_opp_replace(spark, sf):
    f = fx(spark, sf)
    report = opp.multi_opportunity_report(f.line, f.cost, f.charge_code, OPP_SPECS, OPP_YEARS)
    redo = opp.multi_opportunity_report(f.line, f.cost, f.charge_code, OPP_SPECS[:1], (1996,))
    return opp.replace_opportunity(report, OPP_SPECS[0].name, redo)


@register("opp_replace_on_disk")
def q_opp_replace_on_disk(spark, sf):
    """A05 in a stored report: one opportunity redone, one redone without rows, one deleted and added again."""
    f = fx(spark, sf)

    def report(specs, years):
        return opp.multi_opportunity_report(f.line, f.cost, f.charge_code, specs, years)

    store = ReportStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardlens-reports/{_uuid.uuid4().hex}")
    first, second, third = OPP_SPECS
    store.write(report(OPP_SPECS, OPP_YEARS))
    store.replace([first.name], report([first], (1996,)))
    store.replace([second.name], report([second], ()))
    store.delete([third.name])
    store.replace([third.name], report([third], (1997,)))
    store.vacuum()
    return store.read()


def _dictionary(spark, sf):
    """Keywords out of the charge codes' own descriptions, hundreds of them: the description less its outer letters, a spec a brand and driver; some short ones and wildcards."""
    codes = fx(spark, sf).charge_code
    inner = codes.select(F.col("rollup_name").alias("spec_name"), F.lit("dictionary").alias("spec_type"), F.col("cost_driver").alias("category"),
                         F.upper(F.expr("substring(description, 3, length(description) - 3)")).alias("keyword"))
    drivers = codes.select(F.col("cost_driver").alias("category")).distinct()
    short = drivers.select(F.explode(F.array(*[F.struct(F.lit(s).alias("spec_name"), F.lit("short").alias("spec_type"), F.col("category"), F.lit(k).alias("keyword")) for s, k in DICTIONARY_SHORT])).alias("s")).select("s.*")
    return inner.unionByName(short).distinct()


DICTIONARY_SHORT = (("Two letters", "OT"), ("Two letters", "#7"), ("Wildcards", "b_lt%#1"), ("Wildcards", "r%g"), ("No such text", "qqq"))


@register("opp_codes_dictionary")
def q_opp_codes_dictionary(spark, sf):
    return opp.pick_from_dictionary(fx(spark, sf).charge_code, _dictionary(spark, sf), "description")


@register("opp_multi_dictionary")
def q_opp_multi_dictionary(spark, sf):
    f = fx(spark, sf)
    picked = opp.pick_from_dictionary(f.charge_code, _dictionary(spark, sf), "description")
    return opp.report_of_codes(f.line, f.cost, picked, OPP_YEARS)


@register("collated_units")
def q_collated_units(spark, sf):
    """Charge codes typed in odd case and with trailing blanks: filtered, joined with clean drivers and grouped as the warehouse does."""
    f = fx(spark, sf)
    odd = F.when(F.col("charge_code_id") % 3 == 0, F.lower("cost_driver")).when(F.col("charge_code_id") % 3 == 1, F.concat("cost_driver", F.lit("  "))).otherwise(F.col("cost_driver"))
    name = F.when(F.col("charge_code_id") % 2 == 0, F.upper("name")).otherwise(F.concat("name", F.lit(" ")))
    codes = collated(f.charge_code.select("charge_code_id", odd.alias("cost_driver"), name.alias("name")))
    drivers = collated(f.charge_code.select(F.initcap("cost_driver").alias("cost_driver")).distinct())
    picked = codes.where(F.col("name").isin("red widget", "Blue Bolt  ", "HOT GEAR")).join(drivers, "cost_driver")
    per = f.line.join(picked, "charge_code_id").groupBy("cost_driver", "name").agg(F.sum("units").cast("decimal(38,2)").alias("uos"), F.count(F.lit(1)).alias("n_lines"))
    return per.select(plain(F.col("cost_driver")).alias("cost_driver"), plain(F.col("name")).alias("name"), "uos", "n_lines")


# ------------------------------------------------------------ redundancy

RED = RedundancyParams(cpt_codes=("C007", "C011", "C023"), cost_drivers=("PROMO", "ECONOMY", "STANDARD"),
                       fiscal_year=1996, patient_settings=("1-URGENT", "2-HIGH", "3-MEDIUM"),
                       ranks=(("purchase", "A"), ("click", "B")))
USAGE_TIEBREAK = ("service_ts", "cpt_code", "unit_cost", "event_id")
USAGE_YEAR = 2024


@register("ctf_map")
def q_ctf_map(spark, sf):
    f = fx(spark, sf)
    return red.ctf_mapping(f.ctf, f.ctf_map, f.ctf_cpt_map, 2)


@register("src_filter")
def q_src_filter(spark, sf):
    return red.billing_source_systems(fx(spark, sf).source_system, 1)


@register("enc_usage")
def q_enc_usage(spark, sf):
    f = fx(spark, sf)
    return red.encounter_usage(f.encounter, f.line, f.cost, f.charge_code, f.cpt, f.physician,
                               f.source_system, RED)


@register("enc_clean")
def q_enc_clean(spark, sf):
    return red.clean_usage(fx(spark, sf).usage)


def _ranked(spark, sf):
    return red.rank_codes(red.clean_usage(fx(spark, sf).usage), RED.ranks)


@register("code_rank")
def q_code_rank(spark, sf):
    return _ranked(spark, sf)


@register("row_index")
def q_row_index(spark, sf):
    return red.row_index(_ranked(spark, sf), USAGE_TIEBREAK, RED.key)


@register("row_index_whole_table")
def q_row_index_whole_table(spark, sf):
    return red.row_index(_ranked(spark, sf), USAGE_TIEBREAK, RED.key, whole_table=True)


@register("adjacent_rows")
def q_adjacent_rows(spark, sf):
    return red.adjacent_rows(_ranked(spark, sf), USAGE_TIEBREAK, RED.key)


def _adjacent_all(spark, sf):
    return red.adjacent_rows(_ranked(spark, sf), USAGE_TIEBREAK, RED.key, keep_null_time=True)


@register("same_day_excess")
def q_same_day_excess(spark, sf):
    return red.same_day_excess(_adjacent_all(spark, sf))


@register("next_day_excess")
def q_next_day_excess(spark, sf):
    return red.next_day_excess(_adjacent_all(spark, sf))


@register("savings")
def q_savings(spark, sf):
    return red.savings_from_usage(fx(spark, sf).usage, RED.ranks, USAGE_TIEBREAK, USAGE_YEAR, RED.key)


# ------------------------------------------------------- entity compare

ENT = EntityCompareParams(fiscal_years=(1996,))


def _ent_enc(spark, sf):
    f = fx(spark, sf)
    return ent.encounter_base(f.encounter, f.source_system, f.physician, ENT)


def _ent_bill(spark, sf):
    f = fx(spark, sf)
    return ent.bill(_ent_enc(spark, sf), f.line, f.cost, f.charge_code, ENT)


def _ent_usage(spark, sf, b=None):
    return ent.code_usage(b if b is not None else _ent_bill(spark, sf), ent.group_volumes(_ent_enc(spark, sf)))


def _ent_worklist(spark, sf, compat=False, b=None, top=None):
    params = _replace(ENT, worklist_size=100 if compat else top)
    wl = ent.work_list(ent.bill_by_encounter(b if b is not None else _ent_bill(spark, sf)), params)
    return ent.first_setting_per_line(wl) if compat else wl


def _ent_compared(spark, sf, compat=False, top=None):
    """The aggregated usage, cut once as two steps read it, and the groups to compare."""
    if compat or top:  # the top N counts cases, so it needs the bill by encounter besides
        b = materialize(_ent_bill(spark, sf).select("encounter_id", *ent.GROUP, *ent.CODE, "vdc"))
        return materialize(_ent_usage(spark, sf, b)), _ent_worklist(spark, sf, compat, b, top)
    u = materialize(_ent_usage(spark, sf))
    return u, ent.work_groups(u, ENT)


@register("ent_enc")
def q_ent_enc(spark, sf):
    return _ent_enc(spark, sf)


@register("service_line")
def q_service_line(spark, sf):
    f = fx(spark, sf)
    nations = f.t.nation.select(F.col("n_nationkey").alias("orgpin"), "n_name")
    enc = _ent_enc(spark, sf).join(f.encounter.select("encounter_id", "orgpin"), "encounter_id")
    return ent.with_service_line(enc, nations, "orgpin", "n_name").select("encounter_id", "service_line")


@register("ent_bill")
def q_ent_bill(spark, sf):
    return _ent_bill(spark, sf)


@register("ent_bill_co_located")
def q_ent_bill_co_located(spark, sf):
    """A16, A18 over facts that are loaded bucketed by encounter and partitioned by year."""
    f = fx(spark, sf)
    buckets = bucket_count(f.t.lineitem.count(), least=8)  # counted in the files' footers
    facts = co_located(spark, f.encounter, f.line, f.cost, buckets)
    enc = ent.encounter_base(facts.table("encounter"), f.source_system, f.physician, ENT)
    return ent.bill(enc, facts.table("billing_line"), facts.table("line_cost"), f.charge_code, ENT)


@register("ent_bill_enc")
def q_ent_bill_enc(spark, sf):
    return ent.bill_by_encounter(_ent_bill(spark, sf))


@register("ent_worklist")
def q_ent_worklist(spark, sf):
    return _ent_worklist(spark, sf, top=100)


@register("ent_volumes")
def q_ent_volumes(spark, sf):
    return ent.group_volumes(_ent_enc(spark, sf))


@register("ent_volumes_merged")
def q_ent_volumes_merged(spark, sf):
    """A21 at every level from one table of mergeable states: group, entity and setting, entity, all."""
    state = materialize(distinct_state(_ent_enc(spark, sf), ent.GROUP, "encounter_id"))
    levels = [distinct_counts(state, ent.GROUP[:n], "tot_cases").select(
        F.lit(n).cast("int").alias("level"), *[(F.col(c) if i < n else F.lit(None).cast("string")).alias(c) for i, c in enumerate(("entity", "patient_setting", "service_line"))],
        "tot_cases") for n in (3, 2, 1, 0)]
    return reduce(DataFrame.unionByName, levels)


@register("ent_usage")
def q_ent_usage(spark, sf):
    return _ent_usage(spark, sf)


@register("ent_pairs")
def q_ent_pairs(spark, sf):
    return ent.comparison_pairs(*_ent_compared(spark, sf))


@register("ent_unique")
def q_ent_unique(spark, sf):
    return ent.unique_usage(*_ent_compared(spark, sf))


@register("ent_overlap")
def q_ent_overlap(spark, sf):
    return ent.overlapping_usage(*_ent_compared(spark, sf), ENT.band)


@register("ent_overlap_top100")
def q_ent_overlap_top100(spark, sf):
    return ent.overlapping_usage(*_ent_compared(spark, sf, top=100), ENT.band)


@register("ent_overlap_compat")
def q_ent_overlap_compat(spark, sf):
    return ent.overlapping_usage(*_ent_compared(spark, sf, compat=True), ENT.band)


@register("ent_report_sorted")
def q_ent_report_sorted(spark, sf):
    f = fx(spark, sf)
    _, over = ent.reports(_ent_enc(spark, sf), f.line, f.cost, f.charge_code, ENT, checkpoint=True)
    return over


@register("ent_report_unique_sorted")
def q_ent_report_unique_sorted(spark, sf):
    f = fx(spark, sf)
    uniq, _ = ent.reports(_ent_enc(spark, sf), f.line, f.cost, f.charge_code, ENT, checkpoint=True)
    return uniq


# --------------------------------------------------------------- quality


QA = QualityParams(fiscal_year=1996, qvi_names=("VAP",), population=("MACHINERY", "BUILDING", "FURNITURE"),
                   population_kind="ctf", procedure_cpts=("C007", "C011", "C023", "C031", "C042"),
                   inpatient_settings=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"))
QA_TWO = _replace(QA, qvi_names=("VAP", "FALL"))
QA_IND = _replace(QA, population=("CI_A",), population_kind="indicator")


def _qa_enc(spark, sf, p=QA):
    f = fx(spark, sf)
    return qa.quality_encounters(f.encounter, f.source_system, f.physician, f.indicator, f.gender, f.apr_drg,
                                 f.age_cohort, p)


def _proc_dates(spark, sf):
    f = fx(spark, sf)
    return qa.procedure_dates(f.line, _qa_enc(spark, sf), f.cpt, QA.procedure_cpts)


def _qa_groups(spark, sf, p=QA):
    f = fx(spark, sf)
    enc, pd_ = _qa_enc(spark, sf), _proc_dates(spark, sf)
    return qa.quality_groups(enc, pd_, f.line, f.cost, f.charge_code, f.ub_revenue_code, f.qvi, p)


def _chi_rows(spark, sf):
    # The group rows feed two aggregates: only the columns that these read are cut.
    groups = materialize(_qa_groups(spark, sf).select("qvi", "cost_driver", "encounter_id"))
    # one row per cost driver, read by the expected, diff and label steps
    return materialize(qa.chi_rows(qa.chi_base(groups, QA.control_label)))


@register("qa_encounters")
def q_qa_encounters(spark, sf):
    return _qa_enc(spark, sf)


@register("qa_population")
def q_qa_population(spark, sf):
    return _qa_enc(spark, sf, QA_IND)


@register("proc_dates")
def q_proc_dates(spark, sf):
    return _proc_dates(spark, sf)


@register("proc_order")
def q_proc_order(spark, sf):
    return qa.procedure_order(_proc_dates(spark, sf))


@register("single_proc")
def q_single_proc(spark, sf):
    return qa.single_procedure(_proc_dates(spark, sf))


@register("phase_label")
def q_phase_label(spark, sf):
    f = fx(spark, sf)
    pd_ = _proc_dates(spark, sf)
    proc = pd_.join(qa.single_procedure(pd_), "encounter_id").select("encounter_id", F.col("service_ts").alias("proc_date"))
    return (f.line.select("row_id", "encounter_id", "service_ts").join(proc, "encounter_id")
            .select("row_id", "encounter_id", "proc_date", F.col("service_ts").alias("charge_service_date"),
                    qa.phase(F.col("proc_date"), F.col("service_ts")).alias("date_of_service")))


@register("qvi_group")
def q_qvi_group(spark, sf):
    f = fx(spark, sf)
    return qa.event_group(_qa_enc(spark, sf), _proc_dates(spark, sf), f.line, f.cost, f.charge_code,
                          f.ub_revenue_code, f.qvi, QA)


@register("control_group")
def q_control_group(spark, sf):
    f = fx(spark, sf)
    return qa.control_group(_qa_enc(spark, sf), _proc_dates(spark, sf), f.line, f.cost, f.charge_code,
                            f.ub_revenue_code, QA)


@register("driver_summary")
def q_driver_summary(spark, sf):
    return qa.driver_summary(materialize(_qa_groups(spark, sf)), QA.control_label)


@register("driver_summary_two_events")
def q_driver_summary_two_events(spark, sf):
    return qa.driver_summary(materialize(_qa_groups(spark, sf, QA_TWO)), QA_TWO.control_label)


@register("chi_base")
def q_chi_base(spark, sf):
    return qa.chi_base(materialize(_qa_groups(spark, sf).select("qvi", "cost_driver", "encounter_id")), QA.control_label)


@register("chi_rows")
def q_chi_rows(spark, sf):
    return _chi_rows(spark, sf)


@register("chi_cols")
def q_chi_cols(spark, sf):
    return qa.chi_cols(_chi_rows(spark, sf))


@register("chi_expected")
def q_chi_expected(spark, sf):
    return qa.chi_expected(_chi_rows(spark, sf))


@register("chi_diff")
def q_chi_diff(spark, sf):
    r = _chi_rows(spark, sf)
    return qa.chi_diff(r, qa.chi_expected(r))


@register("chi_label")
def q_chi_label(spark, sf):
    r = _chi_rows(spark, sf)
    return qa.chi_label(r, qa.chi_diff(r, qa.chi_expected(r)), QA.critical_value)


# ----------------------------------------------------------- contingency

IDENTIFYING = ("Entity", "Patient Population", "AttendPhysicianName")


def _clean_export(spark, sf):
    return ct.clean_cost(ct.deidentify(_qa_groups(spark, sf), IDENTIFYING), "vdc")


def _tested(spark, sf):
    """The cleaned rows with the columns that the tests read, cut once for the screen and the tests."""
    return ct.clean_cost(materialize(_qa_groups(spark, sf).select("qvi", "cost_driver", "date_of_service", "vdc")), "vdc")


@register("deidentify")
def q_deidentify(spark, sf):
    return ct.deidentify(_qa_groups(spark, sf), IDENTIFYING)


@register("clean_cost")
def q_clean_cost(spark, sf):
    return _clean_export(spark, sf)


@register("assoc_overall")
def q_assoc_overall(spark, sf):
    return ct.contingency(_tested(spark, sf), "qvi", "cost_driver")


@register("sig_drivers")
def q_sig_drivers(spark, sf):
    return ct.significant_levels(_tested(spark, sf), "qvi", "cost_driver")


def _by_driver(spark, sf):
    sub = ct.significant_subset(_tested(spark, sf), "qvi", "cost_driver")
    return ct.contingency(sub, "qvi", "date_of_service", ["cost_driver"])


@register("assoc_by_driver")
def q_assoc_by_driver(spark, sf):
    return _by_driver(spark, sf)


@register("assoc_pvalues")
def q_assoc_pvalues(spark, sf):
    return _rounded(ct.with_pvalues(_by_driver(spark, sf), ["cost_driver"]))


@register("assoc_overall_p")
def q_assoc_overall_p(spark, sf):
    return _rounded(ct.with_pvalues(ct.contingency(_tested(spark, sf), "qvi", "cost_driver"), []))


def _rounded(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", F.round("p_value", 6))


# ------------------------------------------------------------- benchmark

BM = CohortCriteria(source_category="Hospital Billing", patient_setting=("1-URGENT", "2-HIGH", "3-MEDIUM"),
                    discharge_year=1996, clienttype="T0", censusregion="ASIA", entitytype="MACHINERY",
                    coi_pattern="%NATION_7%", entities_of_interest=((7, "Alpha Hospital"), (32, "Beta Hospital")),
                    cpt_code="C007")
BM_CLIENT_DIMS = (("clienttype", "clientofinterest", ("T0",)), ("client_region", "clientofinterest", ("ASIA",)),
                  ("client_opex", "clientofinterest", ("X1",)))
BM_ENTITY_DIMS = (("entitytype", "entities_of_interest", ("MACHINERY",)),
                  ("entity_opex", "entities_of_interest", ("X1", "X2")),
                  ("entity_bedsize", "entities_of_interest", ("small", "large")),
                  ("entity_urban", "entities_of_interest", None))


def _cohort(spark, sf):
    f = fx(spark, sf)
    return bm.peer_cohort(f.encounter, f.system_criteria, f.entity_criteria, f.source_system, BM)


def _peer_billing(spark, sf):
    return bm.peer_billing(fx(spark, sf).billing, _cohort(spark, sf), BM.cpt_code)


@register("peer_cohort")
def q_peer_cohort(spark, sf):
    return _cohort(spark, sf)


@register("peer_flags")
def q_peer_flags(spark, sf):
    return bm.peer_flags(_cohort(spark, sf))


@register("peer_billing")
def q_peer_billing(spark, sf):
    return _peer_billing(spark, sf)


@register("peer_checks")
def q_peer_checks(spark, sf):
    return bm.peer_checks(_cohort(spark, sf))


@register("peer_billing_checks")
def q_peer_billing_checks(spark, sf):
    return bm.peer_billing_checks(_peer_billing(spark, sf))


@register("util_client_dims")
def q_util_client_dims(spark, sf):
    return bm.utilisation(_peer_billing(spark, sf), BM_CLIENT_DIMS)


@register("util_entity_dims")
def q_util_entity_dims(spark, sf):
    return bm.utilisation(_peer_billing(spark, sf), BM_ENTITY_DIMS)


@register("util_all_dims")
def q_util_all_dims(spark, sf):
    return bm.utilisation(_peer_billing(spark, sf), BM_CLIENT_DIMS + BM_ENTITY_DIMS)


@register("volume_dims")
def q_volume_dims(spark, sf):
    return bm.volumes(_cohort(spark, sf), BM_CLIENT_DIMS + BM_ENTITY_DIMS)


def _cut_cohort_billing(spark, sf):
    # the top-k reports read the cohort and its billing rows several times:
    # cut both once in the shared checkpoint folder
    cohort = materialize(_cohort(spark, sf))
    return cohort, materialize(bm.peer_billing(fx(spark, sf).billing, cohort, BM.cpt_code))


@register("top_drg_coi")
def q_top_drg_coi(spark, sf):
    _, billing = _cut_cohort_billing(spark, sf)
    return bm.top_drg_coi(billing)


@register("top_drg_coi_total")
def q_top_drg_coi_total(spark, sf):
    cohort, billing = _cut_cohort_billing(spark, sf)
    return bm.top_drg_coi_total(billing, cohort)


@register("top_drg_cohort")
def q_top_drg_cohort(spark, sf):
    cohort, billing = _cut_cohort_billing(spark, sf)
    return bm.top_drg_cohort(billing, cohort)


# ------------------------------------------------------------------- drg

DRG_YEAR = 1996


def _px_detail(spark, sf):
    f = fx(spark, sf)
    return drg_ops.procedure_detail(f.encounter, f.procedure, f.pcs_map, f.msdrg, f.icd10px, f.icd10dx, DRG_YEAR)


@register("client_db_name")
def q_client_db_name(spark, sf):
    return drg_ops.client_database_name(fx(spark, sf).system_criteria.select("orgpin", "client"), "client", "_")


CLIENT_PINS = (2, 3, 7, 11, 16, 20)


@register("client_entities")
def q_client_entities(spark, sf):
    """Several clients' own entity tables, their databases found by org pin."""
    f = fx(spark, sf)
    clients = ClientDatabases(spark, f.system_criteria, id_col="client", separator="_")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardlens-clients/{_uuid.uuid4().hex}"
    publish_clients(clients, f.entity_criteria.select("orgpin", "entity_key", "alias", "entitytype", "bedsize"), "entity", folder)
    return clients.table(CLIENT_PINS, "entity")


@register("mdc_group")
def q_mdc_group(spark, sf):
    return drg_ops.with_mdc_group(fx(spark, sf).encounter.select("encounter_id", "msdrg_code"))


@register("mdc_group_ranges")
def q_mdc_group_ranges(spark, sf):
    """A60 with the categories as a range table."""
    ranges = spark.createDataFrame(category_ranges(), "lo int, hi int, label string")
    return drg_ops.with_range_group(fx(spark, sf).encounter.select("encounter_id", "msdrg_code"), ranges)


@register("px_detail")
def q_px_detail(spark, sf):
    return _px_detail(spark, sf)


@register("px_by_encounter")
def q_px_by_encounter(spark, sf):
    return drg_ops.by_encounter(_px_detail(spark, sf))


@register("px_pattern")
def q_px_pattern(spark, sf):
    return drg_ops.description_pattern(_px_detail(spark, sf), "% 98%")


@register("mdc_body_part")
def q_mdc_body_part(spark, sf):
    return drg_ops.category_body_part(_px_detail(spark, sf))


# ---------------------------------------------------------------- cohort


DONOR = DonorCohortParams(min_year=1998)
DONOR_KEYS = ("donor_key", "donor_line")


def _donors(spark, sf):
    return co.cohort_filter(fx(spark, sf).donor, DONOR)


@register("csv_load")
def q_csv_load(spark, sf):
    donor = fx(spark, sf).donor
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardlens-csv/{_uuid.uuid4().hex}"
    co.write_csv(donor, path)
    return co.shape(co.read_registry_csv(spark, path, donor.schema))


def _csv_with_faults(spark, sf):
    """The registry as CSV text in which some records hold an age that is no number."""
    donor = fx(spark, sf).donor
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardlens-csv/{_uuid.uuid4().hex}"
    text = donor.select([F.col(c).cast("string").alias(c) for c in donor.columns])
    co.write_csv(text.withColumn("age", F.when(F.col("donor_key") % 40 == 7, "n/a").otherwise(F.col("age"))), path)
    return co.load_registry_csv(spark, path, donor.schema)


@register("csv_rows")
def q_csv_rows(spark, sf):
    return _csv_with_faults(spark, sf).rows


@register("csv_rejects")
def q_csv_rejects(spark, sf):
    field = F.split("record", ",")
    rejects = _csv_with_faults(spark, sf).rejects
    return rejects.select(field[0].cast("bigint").alias("donor_key"), field[1].cast("int").alias("donor_line"), field[2].alias("age"))


@register("populated_pct")
def q_populated_pct(spark, sf):
    return co.populated_pct(_donors(spark, sf), co.POPULATED_COLUMNS)


@register("cohort_filter")
def q_cohort_filter(spark, sf):
    return _donors(spark, sf)


@register("bin_generic")
def q_bin_generic(spark, sf):
    from wardlens.functions.bins import bin_label
    return _donors(spark, sf).select(*DONOR_KEYS, "bmi_don", bin_label(F.col("bmi_don"), DONOR_BMI).alias("donor_bmi_categories"))


@register("bin_specs")
def q_bin_specs(spark, sf):
    from wardlens.functions.bins import DONOR_BINS
    return co.add_bins(_donors(spark, sf)).select(*DONOR_KEYS, *[b[1] for b in DONOR_BINS])


@register("one_hot")
def q_one_hot(spark, sf):
    from wardlens.functions.bins import DONOR_BINS
    names = [r[2] for b in DONOR_BINS for r in b[2]]
    return co.one_hot(co.add_bins(_donors(spark, sf))).select(*DONOR_KEYS, *names)


@register("flags")
def q_flags(spark, sf):
    return co.flags(_donors(spark, sf)).select(*DONOR_KEYS, *[f[0] for f in co.DONOR_FLAGS])


@register("feature_matrix")
def q_feature_matrix(spark, sf):
    return co.feature_matrix(_donors(spark, sf))


# ------------------------------------- redundancy over the billing lines
LINE_RANKS = (("C007", "A"), ("C011", "B"))
LINE_TIEBREAK = ("service_ts", "cpt_code", "unit_cost", "ordering_md_name", "ordering_md_spec")


@register("savings_lines")
def q_savings_lines(spark, sf):
    """A08 -> A15 end to end on the line fact (usage of the chosen CPT codes)."""
    return red.savings_from_usage(q_enc_usage(spark, sf), LINE_RANKS, LINE_TIEBREAK, RED.fiscal_year, RED.key)


@register("adjacent_lines")
def q_adjacent_lines(spark, sf):
    usage = materialize(q_enc_usage(spark, sf))
    ranked = red.rank_codes(red.clean_usage(usage), LINE_RANKS)
    return red.adjacent_rows(ranked, LINE_TIEBREAK, RED.key)


# ----------------------------------------- literal (compat) behaviours

QA_FAN = _replace(QA, population=QA.population + ("CI_A",))
COMPAT_BINS = ((_BINS[0][0], _BINS[0][1], DONOR_AGE_COMPAT),) + tuple(_BINS[1:])


@register("qa_encounters_fanout")
def q_qa_encounters_fanout(spark, sf):
    f = fx(spark, sf)
    return qa.quality_encounters(f.encounter, f.source_system, f.physician, f.indicator, f.gender, f.apr_drg,
                                 f.age_cohort, QA_FAN, compat_fanout=True)


@register("single_proc_by_date")
def q_single_proc_by_date(spark, sf):
    f = fx(spark, sf)
    return qa.single_procedure(qa.procedure_dates(f.line, _qa_enc(spark, sf), f.cpt, QA.procedure_cpts, by_date=True))


@register("chi_diff_compat")
def q_chi_diff_compat(spark, sf):
    r = _chi_rows(spark, sf)
    return qa.chi_diff(r, qa.chi_expected(r), compat_rounding=True)


@register("util_literal_cases")
def q_util_literal_cases(spark, sf):
    return bm.utilisation(_peer_billing(spark, sf), BM_CLIENT_DIMS + BM_ENTITY_DIMS, case_key=bm.LITERAL_CASE_KEY)


@register("one_hot_compat")
def q_one_hot_compat(spark, sf):
    names = [r[2] for b in _BINS for r in b[2]]
    return co.one_hot(co.add_bins(_donors(spark, sf)), compat_substring=True).select(*DONOR_KEYS, *names)


@register("bin_specs_compat_age")
def q_bin_specs_compat_age(spark, sf):
    return co.add_bins(_donors(spark, sf), COMPAT_BINS).select(*DONOR_KEYS, "age_don", "donor_age_categories")
