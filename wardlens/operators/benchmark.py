"""Cross-client CPT utilisation benchmarking.

Utilisation by seven client/entity dimensions is computed in one scan:
each billing row is exploded into (dimension, flag, value) entries and
aggregated once, first to the encounter (UOS and service days), then to
the dimension value.  Counting distinct (encounter, day) pairs uses the
pair itself, not a concatenated text key.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.exact import ratio
from wardlens.params import CohortCriteria

col, lit = F.col, F.lit
OTHER_ENTITIES = "Other Entities"

CRITERIA_COLS = ["client_name", "clienttype", "client_region", "client_opex", "entity_name", "entity_region",
                 "entity_amc", "entity_urban", "entitytype", "entity_opex", "entity_bedsize", "orgpin", "stratum_id"]
COHORT_COLS = [*CRITERIA_COLS, "msdrg_code", "primary_cpt_code", "dischargedate", "dc_year", "primary_icd10dx_code",
               "age_rollup", "encounter_id", "clientofinterest", "entities_of_interest"]


def peer_cohort(encounters: DataFrame, system_criteria: DataFrame, entity_criteria: DataFrame,
                source_system: DataFrame, p: CohortCriteria) -> DataFrame:
    """Encounters of comparable clients (any listed characteristic
    matches), flagged for the client and entities of interest."""
    src = source_system.where(col("category_name") == p.source_category).select("source_system_id")
    e = (encounters.where(col("patient_setting").isin(list(p.patient_setting))
                          & (col("discharge_date") >= lit(date(p.discharge_year, 1, 1)))
                          & (col("discharge_date") < lit(date(p.discharge_year + 1, 1, 1))))
         .join(src, "source_system_id", "left_semi"))
    sc = system_criteria.select("orgpin", "stratum_id", col("client").alias("client_name"), "clienttype",
                                col("censusregion").alias("client_region"), col("opex").alias("client_opex"))
    ec = entity_criteria.select("orgpin", "stratum_id", "entity_key", col("alias").alias("entity_name"),
                                col("censusregion").alias("entity_region"),
                                col("isamc").alias("entity_amc"), col("isurban").alias("entity_urban"),
                                "entitytype", col("opex").alias("entity_opex"), col("bedsize").alias("entity_bedsize"))
    j = e.join(sc, ["orgpin", "stratum_id"]).join(ec, ["orgpin", "stratum_id", "entity_key"])
    crit = [(col("clienttype"), p.clienttype), (col("client_region"), p.censusregion),
            (col("client_opex"), p.client_opex), (col("entitytype"), p.entitytype),
            (col("entity_opex"), p.entity_opex), (col("entity_bedsize"), p.bedsize)]
    conds = [c == v for c, v in crit if v is not None]
    if conds:
        j = j.where(reduce(or_, conds))
    label = lit(OTHER_ENTITIES)
    for key, name in reversed(list(p.entities_of_interest)):
        label = F.when(col("entity_key") == key, name).otherwise(label)
    return j.select(
        *CRITERIA_COLS, "msdrg_code", "primary_cpt_code", col("discharge_date").alias("dischargedate"),
        F.year("discharge_date").cast("int").alias("dc_year"), "primary_icd10dx_code", "age_rollup", "encounter_id",
        F.when(col("client_name").ilike(p.coi_pattern), 1).otherwise(0).alias("clientofinterest"),
        label.alias("entities_of_interest")).distinct()


def peer_flags(cohort: DataFrame) -> DataFrame:
    """A49 view: the two flags per encounter."""
    return cohort.select("orgpin", "stratum_id", "encounter_id", "clientofinterest", "entities_of_interest")


def peer_billing(billing: DataFrame, cohort: DataFrame, cpt_code: str) -> DataFrame:
    """UOS and cost per encounter x service day for one CPT code."""
    b = billing.where(col("billedcptcode") == cpt_code).withColumnRenamed("encounterid", "encounter_id")
    j = b.join(cohort, ["encounter_id", "orgpin", "stratum_id"])
    keys = COHORT_COLS + ["servicedateid", "servicedate", "billedcptid", "billedcptcode", "billedcptdescription",
                          "chargecodecostdriver"]
    return j.groupBy(*keys).agg(F.sum("totalunitsofservice").cast("decimal(38,2)").alias("units_of_service"),
                                F.sum("variabledirectcost").cast("decimal(38,4)").alias("variable_direct_cost"))


def peer_checks(cohort: DataFrame) -> DataFrame:
    """Clients per flag and the last discharge date."""
    return cohort.groupBy("clientofinterest").agg(F.count_distinct("client_name").alias("clients"),
                                                  F.max("dischargedate").alias("max_discharge_date"))


def peer_billing_checks(billing: DataFrame) -> DataFrame:
    """A51, billing side: per flag and billed code, the clients and the last discharge date."""
    return billing.groupBy("clientofinterest", "billedcptcode", "billedcptdescription").agg(
        F.count_distinct("client_name").alias("clients"), F.max("dischargedate").alias("max_discharge_date"))


CLIENT_DIMS = ("clienttype", "client_region", "client_opex")
ENTITY_DIMS = ("entitytype", "entity_opex", "entity_bedsize", "entity_urban")


def _stack(df: DataFrame, dims: Sequence[tuple[str, str, Sequence[str] | None]], extra: Sequence[str]) -> DataFrame:
    entries = []
    for dim, flag, allowed in dims:
        keep = col(dim).isNotNull() if allowed is None else col(dim).cast("string").isin(list(allowed))
        entries.append(F.when(keep, F.struct(lit(dim).alias("dimension"), col(flag).cast("string").alias("flag"),
                                              col(dim).cast("string").alias("dim_value"))))
    s = df.select(*extra, F.explode(F.array(*entries)).alias("_e")).where(col("_e").isNotNull())
    return s.select(*extra, "_e.dimension", "_e.flag", "_e.dim_value")


CASE_KEY = ("orgpin", "stratum_id", "encounter_id")
LITERAL_CASE_KEY = ("encounter_id",)   # the reference counts encounter ids alone


def _case_metrics(df: DataFrame, keys: Sequence[str], with_uos: bool = True,
                  case_key: Sequence[str] = CASE_KEY) -> DataFrame:
    enc = [c for c in case_key if c not in keys]
    if not with_uos:
        return df.select(*keys, *enc).distinct().groupBy(*keys).agg(F.count(lit(1)).alias("cases"))
    per_enc = df.groupBy(*keys, *enc).agg(F.sum("units_of_service").alias("_uos"),
                                          F.count_distinct("servicedateid").alias("_days"))
    g = per_enc.groupBy(*keys).agg(F.count(lit(1)).alias("cases"),
                                   F.sum("_uos").cast("decimal(38,2)").alias("uos"),
                                   F.sum("_days").alias("patient_days"))
    return g.select(*keys, "cases", "uos", "patient_days",
                    ratio(col("uos"), 2, col("cases"), 0, 1).alias("uos_per_case"),
                    ratio(col("uos"), 2, col("patient_days"), 0, 1).alias("uos_per_patientday"))


def utilisation(billing_rows: DataFrame, dims: Sequence[tuple[str, str, Sequence[str] | None]],
                case_key: Sequence[str] = CASE_KEY) -> DataFrame:
    """Cases, UOS, patient days and rates per (dimension, flag, value).

    ``dims`` lists (dimension column, flag column, allowed values or None);
    any number of dimensions costs one scan and one two-level aggregate.
    A case is the composite (orgpin, stratum_id, encounter); pass
    ``LITERAL_CASE_KEY`` to count encounter ids alone, as the reference does.
    """
    if tuple(case_key) == CASE_KEY:
        # Every dimension and flag is an attribute of the case, so UOS and
        # service days are aggregated per case first and only the case rows
        # are exploded into (dimension, flag, value) entries.
        attrs = sorted({c for d, f, _ in dims for c in (d, f)})
        per_case = billing_rows.groupBy(*CASE_KEY, *attrs).agg(
            F.sum("units_of_service").alias("_uos"), F.count_distinct("servicedateid").alias("_days"))
        s = _stack(per_case, dims, [*CASE_KEY, "_uos", "_days"])
        g = s.groupBy("dimension", "flag", "dim_value").agg(
            F.count(lit(1)).alias("cases"), F.sum("_uos").cast("decimal(38,2)").alias("uos"),
            F.sum("_days").alias("patient_days"))
        return g.select("dimension", "flag", "dim_value", "cases", "uos", "patient_days",
                        ratio(col("uos"), 2, col("cases"), 0, 1).alias("uos_per_case"),
                        ratio(col("uos"), 2, col("patient_days"), 0, 1).alias("uos_per_patientday"))
    s = _stack(billing_rows, dims, ["orgpin", "stratum_id", "encounter_id", "servicedateid", "units_of_service"])
    return _case_metrics(s, ["dimension", "flag", "dim_value"], case_key=case_key)


def volumes(cohort: DataFrame, dims: Sequence[tuple[str, str, Sequence[str] | None]],
            case_key: Sequence[str] = CASE_KEY) -> DataFrame:
    """Total distinct cases per (dimension, flag, value) of the cohort."""
    s = _stack(cohort, dims, ["orgpin", "stratum_id", "encounter_id"])
    return _case_metrics(s, ["dimension", "flag", "dim_value"], with_uos=False, case_key=case_key)


def _top(df: DataFrame, keys: Sequence[str], k: int, with_uos: bool = True) -> DataFrame:
    m = _case_metrics(df, keys, with_uos)
    return m.orderBy(col("cases").desc(), *keys).limit(k)


def _side(df: DataFrame, side: str, with_uos: bool = True) -> DataFrame:
    out = df.withColumn("side", lit(side))
    if "orgpin" not in df.columns:
        out = out.withColumn("orgpin", lit(None).cast("int"))
    if not with_uos:
        for c, t in (("uos", "decimal(38,2)"), ("patient_days", "bigint"), ("uos_per_case", "decimal(38,1)"),
                     ("uos_per_patientday", "decimal(38,1)")):
            out = out.withColumn(c, lit(None).cast(t))
    return out.select("side", "msdrg_code", "orgpin", "cases", "uos", "patient_days", "uos_per_case",
                      "uos_per_patientday")


def top_drg_coi(billing_rows: DataFrame, k: int = 5) -> DataFrame:
    """The client's top MS-DRGs by CPT cases, and comparator volumes of them."""
    coi = _top(billing_rows.where(col("clientofinterest") == 1), ["msdrg_code", "orgpin"], k)
    comp = billing_rows.where(col("clientofinterest") == 0).join(coi.select("msdrg_code"), "msdrg_code", "left_semi")
    return _side(coi, "coi").unionByName(_side(_top(comp, ["msdrg_code"], k), "comparator"))


def top_drg_coi_total(billing_rows: DataFrame, cohort: DataFrame, k: int = 5) -> DataFrame:
    """Total case volume of the client's top MS-DRGs, both sides."""
    coi = _top(billing_rows.where(col("clientofinterest") == 1), ["msdrg_code", "orgpin"], k).select("msdrg_code")
    e = cohort.join(coi, "msdrg_code", "left_semi")
    a = _top(e.where(col("clientofinterest") == 1), ["msdrg_code", "orgpin"], k, with_uos=False)
    b = _top(e.where(col("clientofinterest") == 0), ["msdrg_code"], k, with_uos=False)
    return _side(a, "coi_total", False).unionByName(_side(b, "comparator_total", False))


def top_drg_cohort(billing_rows: DataFrame, cohort: DataFrame, k: int = 5, exclude: str = "000") -> DataFrame:
    """The cohort's top MS-DRGs (excluding ``exclude``) by CPT cases,
    the client's volumes of them, and total volumes on both sides."""
    comp = _top(billing_rows.where((col("clientofinterest") == 0) & (col("msdrg_code") != exclude)), ["msdrg_code"], k)
    drgs = comp.select("msdrg_code")
    coi = _top(billing_rows.where(col("clientofinterest") == 1).join(drgs, "msdrg_code", "left_semi"),
               ["msdrg_code", "orgpin"], k)
    e = cohort.join(drgs, "msdrg_code", "left_semi")
    tc = _top(e.where(col("clientofinterest") == 0), ["msdrg_code"], k, with_uos=False)
    tk = _top(e.where(col("clientofinterest") == 1), ["msdrg_code", "orgpin"], k, with_uos=False)
    return (_side(comp, "comparator").unionByName(_side(coi, "coi"))
            .unionByName(_side(tc, "comparator_total", False)).unionByName(_side(tk, "coi_total", False)))
