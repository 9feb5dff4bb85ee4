"""Procedure (ICD-10-PCS) to MS-DRG body-system mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.drg import UNGROUPABLE, drg_number, mdc_group
from wardlens.functions.ranges import checked, range_lookup

col, lit = F.col, F.lit


def client_database_name(clients: DataFrame, guid_col: str, separator: str = "-") -> DataFrame:
    """Client database name 'P_' + GUID without separators."""
    return clients.withColumn("db_name", F.concat(lit("P_"), F.replace(col(guid_col), lit(separator), lit(""))))


def with_mdc_group(df: DataFrame, code_col: str = "msdrg_code") -> DataFrame:
    """Numeric MS-DRG and its body-system category."""
    return df.withColumn("msdrg_numeric", drg_number(col(code_col))).withColumn(
        "msdrg_groupings", mdc_group(col(code_col)))


def with_range_group(df: DataFrame, ranges: DataFrame, code_col: str = "msdrg_code") -> DataFrame:
    """A60 with the categories as a table (``lo, hi, label``): a DRG version is data; overlapping ranges are rejected."""
    numbered = df.withColumn("msdrg_numeric", drg_number(col(code_col)))
    return range_lookup(numbered, col("msdrg_numeric"), checked(ranges), "label", "msdrg_groupings", UNGROUPABLE)


def procedure_detail(encounters: DataFrame, procedures: DataFrame, pcs_map: DataFrame, msdrg: DataFrame,
                     icd10px: DataFrame, icd10dx: DataFrame, fiscal_year: int) -> DataFrame:
    """Procedure rows of the year's encounters with the names of their DRG,
    procedure and primary diagnosis, the DRG category and the ICD-10-PCS body
    system / part (NULL when the code is unmapped)."""
    e = encounters.where(col("fiscal_year") == fiscal_year).select(
        "encounter_id", "record_number", "msdrg_code", "primary_icd10dx_code")
    e = (e.join(msdrg.select("msdrg_code", col("name").alias("msdrg_fulldescription")), "msdrg_code")
         .join(icd10dx.select(col("code").alias("primary_icd10dx_code"),
                              col("name").alias("prim_icd10dx_description")), "primary_icd10dx_code"))
    px = icd10px.select(col("code").alias("px_code"), col("name").alias("icd10px_fulldescription"))
    m = pcs_map.select(col("code").alias("px_code"), col("labelone").alias("section"),
                       col("labeltwo").alias("body_system"), col("labelfour").alias("body_part"))
    j = (e.join(procedures.select("encounter_id", "px_code", "seq"), "encounter_id").join(px, "px_code")
         .join(m, "px_code", "left"))
    return j.select(
        "encounter_id", "record_number", "prim_icd10dx_description", "msdrg_fulldescription",
        drg_number(col("msdrg_code")).alias("msdrg_numeric"), mdc_group(col("msdrg_code")).alias("msdrg_groupings"),
        "icd10px_fulldescription", col("seq").alias("sequence_number"), "section",
        F.concat(col("body_system"), lit("-"), col("body_part")).alias("body_system_part"),
        "body_system", "body_part")


def by_encounter(detail: DataFrame) -> DataFrame:
    """Encounter-level projection in procedure sequence order."""
    return detail.select("encounter_id", "sequence_number", "msdrg_groupings", "body_system_part") \
        .orderBy("encounter_id", "sequence_number")


def description_pattern(detail: DataFrame, pattern: str = "% 98%") -> DataFrame:
    """Rows whose DRG description matches ``pattern`` (case-insensitive)."""
    return detail.where(col("msdrg_fulldescription").ilike(pattern))


def category_body_part(detail: DataFrame) -> DataFrame:
    """Distinct cases and procedure rows per category x body system-part."""
    return detail.groupBy("msdrg_groupings", "body_system_part").agg(
        F.count_distinct("encounter_id").alias("cases"), F.count(lit(1)).alias("icd10px_codes"))
