"""Adapters that present the driver's TPC-H-style tables as the warehouse.

The reference analyses run on a hospital cost-accounting star schema
(encounters, billing lines, line costs, charge codes, ...).  The test data
is TPC-H shaped, so each method here maps it onto one warehouse relation.
Every method is a lazy DataFrame; joins here are fact-to-dimension joins
that Spark plans by size (broadcast only when the statistics say the
dimension is small), and the scans read only the columns named.

The SQL twin of every method lives in :mod:`wardlens.plans.fixture_sql`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

col, lit = F.col, F.lit


def _s(c):
    return c.cast("string")


def row_key():
    """Numeric parts of the line identity (what ``row_id`` spells out)."""
    return [col("l_linenumber").alias("rk_line"), col("l_partkey").alias("rk_part"),
            F.round(col("l_extendedprice") * 100).cast("bigint").alias("rk_cents")]


def row_id():
    return F.concat_ws("-", _s(col("l_orderkey")), _s(col("l_linenumber")), _s(col("l_partkey")),
                       _s(F.round(col("l_extendedprice") * 100).cast("bigint")))


class Fixtures:
    def __init__(self, tables):
        self.t = tables

    # ------------------------------------------------------------- facts
    @cached_property
    def encounter(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                 "o_orderdate", "o_orderpriority")
        cu = self.t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        n = self.t.nation.select("n_nationkey", "n_regionkey")
        r = self.t.region.select("r_regionkey", "r_name")
        j = (o.join(cu, cu.c_custkey == o.o_custkey)
             .join(n, n.n_nationkey == cu.c_nationkey)
             .join(r, r.r_regionkey == n.n_regionkey))
        return j.select(
            col("o_orderkey").alias("encounter_id"),
            F.concat(lit("R"), _s(col("o_orderkey"))).alias("record_number"),
            col("r_name").alias("entity"),
            col("o_orderpriority").alias("patient_setting"),
            col("c_mktsegment").alias("service_line"),
            col("o_orderdate").cast("date").alias("discharge_date"),
            F.year("o_orderdate").cast("int").alias("fiscal_year"),
            (col("o_custkey") % 3).cast("int").alias("source_system_id"),
            (col("o_custkey") % 11).cast("int").alias("attend_physician_id"),
            F.when(col("o_totalprice") > 5000, "Yes").otherwise("No").alias("has_charge"),
            (col("o_custkey") % 90).cast("int").alias("age"),
            (col("o_orderkey") % 15).cast("int").alias("los"),
            F.when(col("o_orderstatus") == "O", 0).otherwise(1).alias("primary_qvi_id"),
            F.lpad(_s(col("o_orderkey") % 1000), 3, "0").alias("msdrg_code"),
            col("o_custkey").alias("entity_key"),
            col("c_nationkey").alias("orgpin"),
            col("n_regionkey").alias("stratum_id"),
            (col("o_custkey") % 2).cast("int").alias("gender_id"),
            (col("o_orderkey") % 60).cast("int").alias("apr_drg_id"),
            F.floor(col("o_custkey") % 90 / 10).cast("int").alias("age_cohort_id"),
            F.floor(col("o_custkey") % 90 / 10).cast("int").alias("age_rollup"),
            F.concat(lit("C"), F.lpad(_s(col("o_orderkey") % 50 + 1), 3, "0")).alias("primary_cpt_code"),
            F.concat(lit("D"), _s(col("o_custkey") % 300)).alias("primary_icd10dx_code"),
        )

    def _lineitem_part(self, *cols: str) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", *cols)
        p = self.t.part.select("p_partkey", "p_size", "p_retailprice")
        return li.join(p, p.p_partkey == li.l_partkey)

    @cached_property
    def line(self) -> DataFrame:
        j = self._lineitem_part("l_suppkey", "l_shipdate", "l_quantity")
        return j.select(
            row_id().alias("row_id"),
            col("l_orderkey").alias("encounter_id"),
            col("l_partkey").alias("charge_code_id"),
            col("l_suppkey").alias("physician_id"),
            col("p_size").alias("cpt_id"),
            col("l_shipdate").cast("date").alias("service_date"),
            col("l_shipdate").alias("service_ts"),
            F.year("l_shipdate").cast("int").alias("line_year"),
            col("l_quantity").cast("decimal(18,2)").alias("units"),
            col("l_linenumber").alias("seq"),
            (col("l_suppkey") % 25).cast("int").alias("ub_revenue_code_id"),
            *row_key(),
        )

    @cached_property
    def cost(self) -> DataFrame:
        j = self._lineitem_part("l_tax", "l_discount").where(col("l_discount") > 0)
        return j.select(
            row_id().alias("row_id"),
            col("l_orderkey").alias("encounter_id"),
            *row_key(),
            F.when(col("l_tax") == 0, lit(0).cast("decimal(18,2)"))
             .otherwise(col("p_retailprice").cast("decimal(18,2)")).alias("unit_cost"),
        )

    # -------------------------------------------------------- dimensions
    @cached_property
    def charge_code(self) -> DataFrame:
        return self.t.part.select(
            col("p_partkey").alias("charge_code_id"),
            col("p_name").alias("name"),
            F.concat_ws(" ", "p_name", "p_brand").alias("description"),
            col("p_brand").alias("rollup_name"),
            F.when(col("p_type") == "SMALL", "Excluded").otherwise(col("p_type")).alias("cost_driver"),
        )

    @cached_property
    def ub_revenue_code(self) -> DataFrame:
        """UB revenue codes; two of them are excluded, one written carelessly."""
        n = self.t.nation.select("n_nationkey", "n_regionkey")
        r = self.t.region.select("r_regionkey", "r_name")
        return n.join(r, r.r_regionkey == n.n_regionkey).select(
            col("n_nationkey").cast("int").alias("ub_revenue_code_id"),
            F.when(col("n_nationkey") == 11, "Excluded").when(col("n_nationkey") == 23, "excluded ")
             .otherwise(col("r_name")).alias("cost_driver"))

    @cached_property
    def gender(self) -> DataFrame:
        k = (col("c_custkey") % 2).cast("int")
        return self.t.customer.select(k.alias("gender_id"), F.when(k == 0, "Female").otherwise("Male")
                                      .alias("description")).distinct()

    @cached_property
    def apr_drg(self) -> DataFrame:
        k = (col("o_orderkey") % 60).cast("int")
        return self.t.orders.select(k.alias("apr_drg_id"), (k % 4 + 1).alias("aprrom"),
                                    (F.floor(k / 15).cast("int") + 1).alias("aprsoi")).distinct()

    @cached_property
    def age_cohort(self) -> DataFrame:
        k = F.floor(col("c_custkey") % 90 / 10).cast("int")
        return self.t.customer.select(
            k.alias("age_cohort_id"), F.concat(_s(k * 10), lit("-"), _s(k * 10 + 9)).alias("name")).distinct()

    @cached_property
    def msdrg(self) -> DataFrame:
        k = col("o_orderkey") % 1000
        code = F.lpad(_s(k), 3, "0")
        return self.t.orders.select(code.alias("msdrg_code"), F.concat(
            lit("Stay "), code, F.when(k % 3 == 0, " with CC").otherwise(" without CC")).alias("name")).distinct()

    @cached_property
    def icd10px(self) -> DataFrame:
        k = col("p_partkey") % 500
        return (self.t.part.groupBy(k.alias("k")).agg(F.max("p_name").alias("name"))
                .select(F.concat(lit("PX"), _s(col("k"))).alias("code"), "name"))

    @cached_property
    def icd10dx(self) -> DataFrame:
        k = col("c_custkey") % 300
        return (self.t.customer.groupBy(k.alias("k")).agg(F.max("c_mktsegment").alias("m"))
                .select(F.concat(lit("D"), _s(col("k"))).alias("code"), F.concat(lit("Disorder "), "m").alias("name")))

    @cached_property
    def cpt(self) -> DataFrame:
        code = F.concat(lit("C"), F.lpad(_s(col("p_size")), 3, "0"))
        return self.t.part.select(
            col("p_size").alias("cpt_id"), code.alias("cpt_code"),
            F.concat(lit("Procedure "), code).alias("cpt_name")).distinct()

    @cached_property
    def physician(self) -> DataFrame:
        s = self.t.supplier.select("s_suppkey", "s_name", "s_nationkey")
        n = self.t.nation.select("n_nationkey", "n_name")
        return s.join(n, n.n_nationkey == s.s_nationkey).select(
            col("s_suppkey").alias("physician_id"), col("s_name").alias("full_name"),
            col("s_nationkey").alias("specialty_id"), col("n_name").alias("specialty"))

    @cached_property
    def source_system(self) -> DataFrame:
        k = (col("c_custkey") % 3).cast("int")
        return self.t.customer.select(
            k.alias("source_system_id"),
            F.when(k == 2, 2).otherwise(1).cast("int").alias("category_id"),
            F.when(k == 2, "Professional Billing").otherwise("Hospital Billing").alias("category_name"),
        ).distinct()

    @cached_property
    def qvi(self) -> DataFrame:
        return self.t.orders.where(col("o_orderstatus") == "F").select(
            col("o_orderkey").alias("encounter_id"),
            F.when(col("o_orderkey") % 2 == 0, "VAP").otherwise("FALL").alias("qvi_name"))

    @cached_property
    def indicator(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey")
        a = o.where(col("o_orderkey") % 3 == 0).select(col("o_orderkey").alias("encounter_id"), lit("CI_A").alias("name"))
        b = o.where(col("o_orderkey") % 6 == 0).select(col("o_orderkey").alias("encounter_id"), lit("CI_B").alias("name"))
        return a.unionByName(b)

    @cached_property
    def usage(self) -> DataFrame:
        """Event stream presented as per-test usage rows (input of the redundancy analysis)."""
        e = self.t.events
        uos = (lit(1) + col("event_id") % 2).cast("int")
        zero = col("event_id") % 97 == 0
        price = col("value").cast("decimal(18,2)")
        return e.select(
            col("user_id").alias("encounter_id"),
            F.concat(lit("R"), _s(col("user_id"))).alias("record_number"),
            col("event_type").alias("cpt_code"),
            col("ts").cast("date").alias("service_date"),
            col("ts").alias("service_ts"),
            uos.alias("uos"),
            F.when(zero, lit(0).cast("decimal(18,2)")).otherwise(price).alias("unit_cost"),
            F.when(zero, lit(0).cast("decimal(18,2)")).otherwise((uos * price).cast("decimal(18,2)")).alias("vdc"),
            col("event_id"),
        )

    @cached_property
    def system_criteria(self) -> DataFrame:
        n = self.t.nation.select("n_nationkey", "n_name", "n_regionkey")
        r = self.t.region.select("r_regionkey", "r_name")
        return n.join(r, r.r_regionkey == n.n_regionkey).select(
            col("n_nationkey").alias("orgpin"), col("n_regionkey").alias("stratum_id"),
            col("n_name").alias("client"),
            F.concat(lit("T"), _s(col("n_nationkey") % 3)).alias("clienttype"),
            col("r_name").alias("censusregion"),
            F.concat(lit("X"), _s(col("n_nationkey") % 4)).alias("opex"))

    @cached_property
    def entity_criteria(self) -> DataFrame:
        c = self.t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        n = self.t.nation.select("n_nationkey", "n_regionkey")
        return c.join(n, n.n_nationkey == c.c_nationkey).select(
            col("c_nationkey").alias("orgpin"), col("n_regionkey").alias("stratum_id"),
            col("c_custkey").alias("entity_key"), col("c_name").alias("alias"),
            col("c_mktsegment").alias("entitytype"), F.concat(lit("E"), _s(col("c_custkey") % 5)).alias("censusregion"),
            F.concat(lit("X"), _s(col("c_custkey") % 4)).alias("opex"),
            (col("c_custkey") % 2).cast("int").alias("isurban"),
            (col("c_custkey") % 5).cast("int").alias("isamc"),
            F.when(col("c_acctbal") < 0, "small").when(col("c_acctbal") < 5000, "medium")
             .otherwise("large").alias("bedsize"))

    @cached_property
    def pcs_map(self) -> DataFrame:
        k = col("p_partkey") % 500
        return (self.t.part.where(k % 7 != 0)
                .groupBy(k.alias("k"))
                .agg(F.min("p_type").alias("labeltwo"), F.min("p_name").alias("labelfour"))
                .select("k", F.concat(lit("PX"), _s(col("k"))).alias("code"), lit("Medical").alias("labelone"),
                        "labeltwo", "labelfour"))

    @cached_property
    def procedure(self) -> DataFrame:
        return self.t.lineitem.select(
            col("l_orderkey").alias("encounter_id"),
            F.concat(lit("PX"), _s(col("l_partkey") % 500)).alias("px_code"),
            col("l_linenumber").alias("seq"))

    @cached_property
    def ctf_map(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", "o_custkey")
        cu = self.t.customer.select("c_custkey", "c_mktsegment")
        return o.join(cu, cu.c_custkey == o.o_custkey).select(
            col("c_mktsegment").alias("ctf"),
            F.lpad(_s(col("o_orderkey") % 1000), 3, "0").alias("msdrg_code"),
            F.concat(lit("Z"), _s(col("o_orderkey") % 1000 % 97)).alias("icd10_code"),
            (lit(1) + col("o_orderkey") % 2).cast("int").alias("version_id")).distinct()

    @cached_property
    def ctf_cpt_map(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_partkey")
        p = self.t.part.select("p_partkey", "p_size")
        o = self.t.orders.select("o_orderkey", "o_custkey")
        cu = self.t.customer.select("c_custkey", "c_mktsegment")
        j = (li.join(p, p.p_partkey == li.l_partkey).join(o, o.o_orderkey == li.l_orderkey)
             .join(cu, cu.c_custkey == o.o_custkey))
        return j.select(col("c_mktsegment").alias("ctf"),
                        F.concat(lit("C"), F.lpad(_s(col("p_size")), 3, "0")).alias("cpt_code"),
                        (lit(1) + col("p_size") % 2).cast("int").alias("version_id")).distinct()

    @cached_property
    def ctf(self) -> DataFrame:
        """Case-type families: one per customer segment."""
        return self.t.customer.select(col("c_mktsegment").alias("ctf")).distinct()

    @cached_property
    def billing(self) -> DataFrame:
        """Cross-client billing summary view (one row per billed line)."""
        l, e, c, cc, k = self.line, self.encounter, self.cpt, self.charge_code, self.cost
        j = (l.join(e.select("encounter_id", "orgpin", "stratum_id"), "encounter_id")
             .join(c, "cpt_id")
             .join(cc.select("charge_code_id", "cost_driver"), "charge_code_id")
             .join(k.select("encounter_id", "rk_line", "rk_part", "rk_cents", "unit_cost"),
                   ["encounter_id", "rk_line", "rk_part", "rk_cents"], "left"))
        d = col("service_date")
        return j.select(
            col("encounter_id").alias("encounterid"), "orgpin", "stratum_id",
            d.alias("servicedate"),
            (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int").alias("servicedateid"),
            col("cpt_id").alias("billedcptid"), col("cpt_code").alias("billedcptcode"),
            col("cpt_name").alias("billedcptdescription"),
            col("cost_driver").alias("chargecodecostdriver"),
            col("units").alias("totalunitsofservice"),
            (col("units") * col("unit_cost")).cast("decimal(38,4)").alias("variabledirectcost"))

    @cached_property
    def donor(self) -> DataFrame:
        li = self.t.lineitem
        lp, ls, lo = col("l_partkey"), col("l_suppkey"), col("l_orderkey")
        null_s = lit(None).cast("string")
        return li.select(
            lo.alias("donor_key"), col("l_linenumber").alias("donor_line"),
            (lit(10) + lp % 70).cast("double").alias("age"),
            F.year("l_shipdate").cast("int").alias("tx_year"),
            F.when(col("l_linestatus") == "O", "").otherwise(null_s).alias("tx_hrt"),
            F.when(lp % 17 == 0, "Y").when(lp % 2 == 0, "").otherwise(null_s).alias("tx_kid"),
            F.when(ls % 19 == 0, "Y").otherwise("").alias("tx_lng"),
            null_s.alias("tx_int"),
            F.when(lo % 29 == 0, "Y").otherwise(null_s).alias("tx_pan"),
            F.when(ls % 23 == 0, "2000-01-01").otherwise(null_s).alias("tx_retxdate"),
            F.when(col("l_returnflag") == "R", "Y").otherwise("N").alias("prev_tx"),
            F.when(lo % 31 == 0, null_s).otherwise(col("l_shipdate").cast("date").cast("string")).alias("tx_date"),
            (col("l_quantity") + 10).cast("double").alias("age_don"),
            F.when(col("l_linenumber") == 7, lit(None).cast("double"))
             .otherwise(lit(15) + col("l_quantity") / 2).alias("bmi_don"),
            F.when(col("l_linenumber") == 1, "Y").otherwise("N").alias("cdc_risk_hiv_don"),
            (col("l_linenumber") % 4).cast("int").alias("cod_cad_don"),
            (col("l_discount") * 60).alias("creat_don"),
            (lp % 5).cast("int").alias("ethcat_don"),
            F.when(lp % 2 == 0, "F").otherwise("M").alias("gender_don"),
            F.when(ls % 3 == 0, "P").otherwise("N").alias("hbv_core_don"),
            F.when(ls % 4 == 0, "P").otherwise("N").alias("hep_c_anti_don"),
            (lit(140) + col("l_quantity")).alias("hgt_cm_don_calc"),
            F.when(col("l_linenumber") == 6, lit(None).cast("int"))
             .otherwise(col("l_linenumber") % 3 + 1).alias("hist_diabetes_don"),
            F.when(lp % 3 == 0, "Y").when(lp % 3 == 1, "N").otherwise(null_s).alias("hist_hypertens_don"),
            (col("l_extendedprice") / 150).alias("sgot_don"),
            (col("l_extendedprice") / 100).alias("sgpt_don"),
            (col("l_quantity") / 4).alias("tbili_don"),
            F.when(lo % 5 == 0, "Y").otherwise("N").alias("controlled_don"),
            (lit(10) + lp % 20).cast("int").alias("lityp"),
            (ls % 5 + 1).cast("int").alias("share_ty"),
            col("l_linestatus").alias("gstatus"),
        )
