"""Opportunity screening: charge-code keyword picks rolled up per fiscal year.

One pass over the billing lines serves any number of opportunity specs: the
specs become a small DataFrame (bounded by what the analyst typed) that is
joined to the charge-code dimension, and only the matching codes meet the
line fact.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.exact import money_sum
from wardlens.functions.keywords import match_keywords
from wardlens.operators._keys import join_costs, line_key_columns
from wardlens.params import OpportunitySpec

col, lit = F.col, F.lit


def pick_charge_codes(charge_code: DataFrame, keywords: Iterable[str], category: str,
                      case_insensitive: bool = True) -> DataFrame:
    """Codes whose description matches any keyword and whose driver is ``category``.

    Keyword matching ignores case by default, as LIKE does under the
    warehouse's default (case-insensitive) collation.
    """
    like = (lambda c, p: c.ilike(p)) if case_insensitive else (lambda c, p: c.like(p))
    match = reduce(or_, [like(col("name"), f"%{k}%") for k in keywords])
    return charge_code.where(match & (col("cost_driver") == category)).select(
        "charge_code_id", col("name").alias("full_description"), "cost_driver", "rollup_name")


def _line_cost(lines: DataFrame, costs: DataFrame) -> DataFrame:
    # line -> cost is 1:0..1; a missing cost keeps the line with NULL cost.
    return join_costs(lines, costs, "left")


def opportunity_summary(lines: DataFrame, costs: DataFrame, codes: DataFrame,
                        fiscal_years: Iterable[int], year_col: str = "line_year") -> DataFrame:
    """Per (fiscal year, code description, encounter): UOS and VDC."""
    l = lines.where(col(year_col).isin(list(fiscal_years))).select(
        *line_key_columns(lines, costs), "encounter_id", "charge_code_id", year_col, "units")
    j = _line_cost(l.join(codes.select("charge_code_id", "full_description"), "charge_code_id"), costs)
    return j.groupBy(col(year_col).alias("fiscal_year"), "full_description", "encounter_id").agg(
        F.sum("units").cast("decimal(38,2)").alias("uos"),
        money_sum(col("units") * col("unit_cost")).alias("vdc"))


def _report_columns(name, otype, category):
    return [col("fiscal_year").cast("int").alias("fiscalyear"),
            (name if not isinstance(name, str) else lit(name)).alias("opportunity_name"),
            (otype if not isinstance(otype, str) else lit(otype)).alias("opportunity_type"),
            (category if not isinstance(category, str) else lit(category)).alias("category"),
            col("full_description").alias("additional_info")]


def _report_aggs():
    # The summary is unique per (year, description, encounter), so
    # count(*) equals count(distinct encounter) without a distinct shuffle.
    return [F.count(lit(1)).cast("int").alias("total_cases"),
            F.sum("uos").cast("decimal(20,2)").alias("total_uos"),
            F.sum("vdc").cast("decimal(20,2)").alias("total_vdc")]


REPORT_COLUMNS = ["fiscalyear", "opportunity_name", "opportunity_type", "category",
                  "additional_info", "total_cases", "total_uos", "total_vdc"]


def opportunity_rollup(summary: DataFrame, spec_name: str, spec_type: str, category: str) -> DataFrame:
    """Distinct cases, total UOS and VDC per (year, description), tagged."""
    agg = summary.groupBy("fiscal_year", "full_description").agg(*_report_aggs())
    return agg.select(*_report_columns(spec_name, spec_type, category),
                      "total_cases", "total_uos", "total_vdc")


def specs_frame(spark: SparkSession, specs: Iterable[OpportunitySpec]) -> DataFrame:
    rows = [(s.name, s.type, s.category, k) for s in specs for k in s.keywords]
    return spark.createDataFrame(rows, "spec_name string, spec_type string, category string, keyword string")


def multi_opportunity_report(lines: DataFrame, costs: DataFrame, charge_code: DataFrame,
                             specs: Iterable[OpportunitySpec], fiscal_years: Iterable[int],
                             year_col: str = "line_year") -> DataFrame:
    """Every spec's A01-A03 block in one scan of the line fact.

    Specs x codes is an equi-join on the cost driver with a LIKE residual;
    the spec side is the analyst's list (bounded), so it is broadcast.
    """
    spark = lines.sparkSession
    sp = F.broadcast(specs_frame(spark, specs))
    cc = charge_code.select("charge_code_id", "name", "cost_driver")
    picked = (cc.join(sp, cc.cost_driver == sp.category)
              .where(F.ilike(col("name"), F.concat(lit("%"), col("keyword"), lit("%"))))
              .select("charge_code_id", col("name").alias("full_description"),
                      "spec_name", "spec_type", "category").distinct())
    return _tagged(_cases(lines, costs, picked, [*SPEC, *NAMED], fiscal_years, year_col))


def pick_from_dictionary(charge_code: DataFrame, specs: DataFrame, description: str = "name") -> DataFrame:
    """A01 for a dictionary of keywords: each spec's codes, a row per spec and code.

    ``specs`` has the columns of :func:`specs_frame`, of any length.  The
    keywords meet the distinct descriptions of their cost driver through a
    trigram index, not every code with every keyword.
    """
    codes = charge_code.select("charge_code_id", col(description).alias("full_description"), col("cost_driver").alias("category"))
    pairs = match_keywords(codes, "full_description", specs, "keyword", by=["category"])
    named = pairs.join(specs.select("spec_name", "spec_type", "category", "keyword"), ["category", "keyword"])
    named = named.select("spec_name", "spec_type", "category", "full_description").distinct()
    return codes.join(named, ["category", "full_description"]).select("charge_code_id", "full_description", "spec_name", "spec_type", "category")


def _cases(lines: DataFrame, costs: DataFrame, codes: DataFrame, by: list[str], fiscal_years: Iterable[int], year_col: str) -> DataFrame:
    """Cases, UOS and VDC per fiscal year and ``by``, columns of ``codes``, in one scan of the line fact."""
    l = lines.where(col(year_col).isin(list(fiscal_years))).select(
        *line_key_columns(lines, costs), "encounter_id", "charge_code_id", year_col, "units")
    j = _line_cost(l.join(codes, "charge_code_id"), costs)
    summary = j.groupBy(*by, col(year_col).alias("fiscal_year"), "encounter_id").agg(
        F.sum("units").alias("uos"), money_sum(col("units") * col("unit_cost")).alias("vdc"))
    return summary.groupBy(*by, "fiscal_year").agg(*_report_aggs())


def _tagged(cases: DataFrame) -> DataFrame:
    return cases.select(*_report_columns(col("spec_name"), col("spec_type"), col("category")),
                        "total_cases", "total_uos", "total_vdc")


NAMED = ["category", "full_description"]
SPEC = ["spec_name", "spec_type"]


def _alike(named: DataFrame, prefix: str):
    """``named`` with its columns prefixed, and the condition that they equal the plain ones (null equals null)."""
    on = reduce(and_, [col(c).eqNullSafe(col(prefix + c)) for c in NAMED])
    return named.select(*[col(c).alias(prefix + c if c in NAMED else c) for c in named.columns]), on


def report_of_codes(lines: DataFrame, costs: DataFrame, picked: DataFrame, fiscal_years: Iterable[int],
                    year_col: str = "line_year") -> DataFrame:
    """A02-A03 of picked codes (``charge_code_id``, description and spec) in one scan of the line fact.

    A line is not repeated for each spec that picks its code.  Where a
    description's specs pick the same codes (a keyword picks by the
    description, so they do), its lines are summed once, and the sums are
    given to each of its specs; other descriptions are summed spec by spec.
    A code picked repeatedly by a spec counts its lines as often.
    """
    # One exchange of the picks by code, which the following read.
    placed = picked.where(col("charge_code_id").isNotNull()).select("charge_code_id", *NAMED, *SPEC).repartition("charge_code_id")
    picks = placed.groupBy("charge_code_id", *NAMED, *SPEC).agg(F.count(lit(1)).alias("_times"))
    codes = picks.groupBy("charge_code_id", *NAMED).agg(
        F.count(lit(1)).alias("_specs"), F.min("_times").alias("_times"), F.max("_times").alias("_most"))
    specs = picks.select(*NAMED, *SPEC).distinct()
    # Every code has all specs of its description, each as often.
    even = codes.groupBy(*NAMED).agg(F.min("_specs").alias("_least"), F.min(col("_times") == col("_most")).alias("_even")).where("_even")
    size, same = _alike(specs.groupBy(*NAMED).agg(F.count(lit(1)).alias("_size")), "_s_")
    whole, of_whole = _alike(even.join(size, same & (col("_least") == col("_size"))).select(*NAMED), "_w_")

    none = [lit(None).cast(picked.schema[c].dataType).alias(c) for c in SPEC]
    once = codes.join(whole, of_whole, "left_semi").select("charge_code_id", *NAMED, lit(True).alias("_whole"), *none, "_times")
    apart = picks.join(whole, of_whole, "left_anti").select("charge_code_id", *NAMED, lit(False).alias("_whole"), *SPEC, "_times")
    listed = once.unionByName(apart).withColumn("_time", F.explode(F.array_repeat(lit(0), col("_times").cast("int")))).drop("_times", "_time")

    cases = _cases(lines, costs, listed, [*NAMED, "_whole", *SPEC], fiscal_years, year_col)
    tags, of_tag = _alike(specs.withColumnsRenamed({c: "_of_" + c for c in SPEC}), "_t_")
    spec = {c: F.when(col("_whole"), col("_of_" + c)).otherwise(col(c)) for c in SPEC}
    return _tagged(cases.join(tags, col("_whole") & of_tag, "left").withColumns(spec))


def replace_opportunity(report: DataFrame, name: str, new_rows: DataFrame) -> DataFrame:
    """Drop one opportunity's rows and append its recomputed rows."""
    return report.where(col("opportunity_name") != name).unionByName(new_rows.select(*REPORT_COLUMNS))


def write_report(report: DataFrame, path: str) -> None:
    """A05 on disk: the report partitioned by opportunity, so re-running one
    opportunity overwrites only its partition (dynamic partition overwrite).
    A redo without rows leaves the old partition; :class:`wardlens.sources.reports.ReportStore`
    replaces and deletes in that case too."""
    (report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("opportunity_name").parquet(path))
