"""Transplant registry cleaning and model-ready feature building.

The whole cleaning is one scan and one projection of generated column
expressions (no per-row Python); only the populated-percentage report
aggregates, and it does all columns in a single pass.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.bins import COMPAT_SUBSTRINGS, DONOR_BINS, bin_label
from wardlens.params import DonorCohortParams
from wardlens.session import ensure_checkpoint_dir

col, lit = F.col, F.lit

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): 0/1 flags as (name, column,
# operator, value), and the exported feature list (reference levels left out).
# ---------------------------------------------------------------------------
DONOR_FLAGS = (
    ("dHIV", "cdc_risk_hiv_don", "==", "Y"),
    ("dCOD_CVA", "cod_cad_don", "==", 2),
    ("dCOD_trauma", "cod_cad_don", "==", 3),
    ("dCOD_anoxia", "cod_cad_don", "==", 1),
    ("African_American_don", "ethcat_don", "==", 2),
    ("Female_Donor", "gender_don", "==", "F"),
    ("Donor_HBV_Core_Antibody", "hbv_core_don", "==", "P"),
    ("Donor_HCV_Antibody", "hep_c_anti_don", "==", "P"),
    ("hx_DM2", "hist_diabetes_don", "!=", 1),
    ("hx_HTN", "hist_hypertens_don", "==", "Y"),
    ("don_CCD", "controlled_don", "==", "Y"),
    ("Split_Liver_Transplant", "lityp", "<", 20),
    ("Regional_Share", "share_ty", "==", 4),
    ("National_Share", "share_ty", "==", 5),
    ("Foreign_Share", "share_ty", "==", 6),
)
FEATURES = (
    "dAgeSub15", "dAge15_19", "dAge20_24", "dAge25_30", "dAge45_54", "dAge55_59", "dAge60_64", "dAge65_69",
    "dAge70_75", "dAge75plus", "dBMIsub20", "dBMI30_34", "dBMI35plus", "dHIV", "dCOD_CVA", "dCOD_anoxia",
    "dCOD_trauma", "don_CCD", "dCreat15_19", "dCreat20_49", "dCreat50plus", "African_American_don",
    "Female_Donor", "Donor_HBV_Core_Antibody", "Donor_HCV_Antibody", "dHeightSub160cm", "dHeight182cmPlus",
    "hx_DM2", "hx_HTN", "dAST50_99", "dAST100_199", "dAST200_499", "dAST500Plus", "dALT50_99", "dALT100_199",
    "dALT200_499", "dALT500Plus", "dBili10_19", "dBili20_29", "dBili30_39", "dBili40_49", "dBili50_99",
    "dBili100Plus", "Split_Liver_Transplant", "Regional_Share", "National_Share", "Foreign_Share", "gstatus",
)
POPULATED_COLUMNS = (
    "age_don", "bmi_don", "cdc_risk_hiv_don", "cod_cad_don", "creat_don", "ethcat_don", "gender_don",
    "hbv_core_don", "hep_c_anti_don", "hgt_cm_don_calc", "hist_diabetes_don", "hist_hypertens_don", "sgot_don",
    "sgpt_don", "tbili_don", "controlled_don", "lityp", "share_ty",
)
OUTCOME = "gstatus"


def blank(c) -> "F.Column":
    """Missing in a CSV sense: NULL or only blanks."""
    c = col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c.cast("string")) == "")


def read_registry_csv(spark, path: str, schema: T.StructType | str) -> DataFrame:
    """A registry extract as CSV with an explicit schema (no inference)."""
    return spark.read.csv(path, header=True, schema=schema)


#: What a quoted blank is read as before it becomes an empty string: a character that no extract holds.
_QUOTED_BLANK = "\u0001"
_RECORD = "_record"


class CsvLoad(NamedTuple):
    """Rows that fit the schema, and the records that do not, as they stand in the file."""
    rows: DataFrame
    rejects: DataFrame


def load_registry_csv(spark, path: str, schema: T.StructType) -> CsvLoad:
    """A registry extract with a declared schema, its bad records apart.

    A record is rejected whole if a value does not have its column's type or
    it has too few or too many values.  An empty field is NULL, a quoted one
    (``""``) an empty string.  Headers must name the schema's columns, else
    Spark raises an error.  The file is parsed once, into Parquet in the
    shared checkpoint folder, which both outputs read.
    """
    wide = T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType())])
    parsed = (spark.read.schema(wide).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", _RECORD).option("nullValue", "").option("emptyValue", _QUOTED_BLANK).csv(path))
    text = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    parsed = parsed.select(*[F.when(col(c) != _QUOTED_BLANK, col(c)).when(col(c).isNotNull(), "").alias(c) if c in text else col(c) for c in schema.names], _RECORD)
    cut = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardlens-csv/{uuid.uuid4().hex}"
    parsed.write.parquet(cut)
    parsed = spark.read.schema(wide).parquet(cut)
    return CsvLoad(parsed.where(col(_RECORD).isNull()).drop(_RECORD), parsed.where(col(_RECORD).isNotNull()).select(col(_RECORD).alias("record")))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first few rows."""
    return df.limit(rows)


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts, as a one-row DataFrame."""
    return df.agg(F.count(lit(1)).alias("n_rows")).withColumn("n_cols", lit(len(df.columns)))


def populated_pct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent non-missing per column, all columns in one aggregate."""
    aggs = [F.count(c).alias(c) for c in columns] + [F.count(lit(1)).alias("_rows")]
    a = df.agg(*aggs)
    stacked = a.select("_rows", F.explode(F.array(*[F.struct(lit(c).alias("column_name"), col(c).alias("_n"))
                                                      for c in columns])).alias("_e"))
    return stacked.select(col("_e.column_name").alias("column_name"),
                          (col("_e._n").cast("double") / col("_rows").cast("double") * 100).alias("pct_populated"))


def cohort_filter(df: DataFrame, p: DonorCohortParams) -> DataFrame:
    """Adult primary liver transplants from the first year on, with a
    transplant date and a donor of at least the minimum age."""
    cond = (col("age") >= p.min_age) & (col("tx_year") >= p.min_year)
    for c in p.other_organs:
        cond = cond & blank(c)
    cond = (cond & blank("tx_retxdate") & ~col("prev_tx").eqNullSafe("Y") & ~blank("tx_date")
            & (col("age_don") >= p.min_donor_age))
    return df.where(cond)


def add_bins(df: DataFrame, bins=DONOR_BINS) -> DataFrame:
    """Label columns from the bin specs."""
    return df.withColumns({label: bin_label(col(src), spec) for src, label, spec in bins})


def one_hot(df: DataFrame, bins=DONOR_BINS, compat_substring: bool = False) -> DataFrame:
    """0/1 indicator per bin label (exact match; the reference's
    substring matching is available as ``compat_substring``)."""
    cols = {}
    for _, label_col, spec in bins:
        for _, _, name in spec:
            hit = (col(label_col).contains(COMPAT_SUBSTRINGS[name]) if compat_substring
                   else col(label_col) == name)
            cols[name] = F.when(hit, 1).otherwise(0)
    return df.withColumns(cols)


def flags(df: DataFrame, spec=DONOR_FLAGS) -> DataFrame:
    """0/1 flags; NULL compares as "not equal", as pandas does."""
    ops = {"==": lambda c, v: c == v, "<": lambda c, v: c < v, "!=": lambda c, v: ~c.eqNullSafe(v)}
    return df.withColumns({name: F.when(ops[op](col(c), lit(v)), 1).otherwise(0) for name, c, op, v in spec})


def feature_matrix(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The exported model matrix."""
    return flags(one_hot(add_bins(df))).select(*features)


def write_csv(df: DataFrame, path: str) -> None:
    """A72 sink: CSV with a header (one file per task, no single-task funnel)."""
    df.write.mode("overwrite").option("header", True).csv(path)
