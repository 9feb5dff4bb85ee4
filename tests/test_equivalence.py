"""The set-based forms against the reference's literal constructions, and
properties that must hold on any input (SURVEY 5, items 3 and 5)."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlens.operators import benchmark, cohort, entity_compare as ent, quality, redundancy
from wardlens.plans import registry as R

SF = "/root/testdata/sf0.001"
TIE = ("service_ts", "cpt_code", "unit_cost", "event_id")


def _random_usage(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        e = rnd.randint(1, 12)
        d = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 6))
        ts = dt.datetime.combine(d, dt.time(rnd.randint(0, 23), rnd.randint(0, 59)))
        uos = rnd.randint(1, 3)
        unit = Decimal(rnd.randint(1, 500)) / 10
        rows.append((e, f"R{e}", rnd.choice(["a", "b", "c"]), d, ts, uos, unit, unit * uos, i))
    return spark.createDataFrame(rows, "encounter_id long, record_number string, cpt_code string, service_date date, "
                                       "service_ts timestamp, uos int, unit_cost decimal(18,2), vdc decimal(18,2), "
                                       "event_id long")


def test_adjacency_equals_shifted_full_outer_join(spark):
    ranked = redundancy.rank_codes(_random_usage(spark), (("a", "A"), ("b", "B")))
    # the reference: global row number, row i joined to row i+1
    g = ranked.withColumn("row_num", F.row_number().over(
        Window.orderBy("encounter_id", "service_date", "cc_rank", *TIE)))
    a, b = g.alias("a"), g.alias("b")
    cat = a.join(b, F.col("b.row_num") == F.col("a.row_num") + 1, "full_outer").select(
        F.when((F.col("a.record_number") == F.col("b.record_number"))
               & (F.col("a.service_date") == F.col("b.service_date")), "same day").otherwise("NA").alias("same_day"),
        F.when(F.col("a.record_number") == F.col("b.record_number"),
               F.date_diff(F.col("b.service_date"), F.col("a.service_date"))).otherwise(99999).alias("date_diff"),
        F.col("b.event_id").alias("event_id")).where(F.col("event_id").isNotNull())
    literal = {(r.event_id, r.same_day, r.date_diff) for r in cat.collect()}
    ours = {(r.event_id, r.same_day, r.date_diff) for r in redundancy.adjacent_rows(ranked, TIE).collect()}
    assert ours == literal and len(ours) == 600


def test_excess_uos_nonnegative(spark):
    adj = redundancy.adjacent_rows(redundancy.rank_codes(_random_usage(spark, seed=5), ()), TIE, keep_null_time=True)
    assert redundancy.same_day_excess(adj).where(F.col("same_day_excess_uos") < 0).count() == 0


def test_set_based_comparison_equals_loop(spark):
    f = R.fx(spark, SF)
    enc = R._ent_enc(spark, SF)
    b = ent.bill(enc, f.line, f.cost, f.charge_code, R.ENT)
    usage = ent.code_usage(b, ent.group_volumes(enc))
    wl = ent.work_list(ent.bill_by_encounter(b), R.ENT)
    set_based = {tuple(r) for r in ent.comparison_pairs(usage, wl).collect()}
    looped = set()
    for g in wl.collect():  # the reference's WHILE loop, one pass per work-list group
        one = spark.createDataFrame([(g.entity, g.patient_setting, g.service_line)],
                                    "entity string, patient_setting string, service_line string")
        looped |= {tuple(r) for r in ent.comparison_pairs(usage, one).collect()}
    assert set_based == looped and len(set_based) > 0


def test_preaggregated_2x2_equals_many_to_many(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["VAP", "Control"]), rnd.choice("WXYZ"), rnd.randint(1, 40)) for _ in range(300)]
    g = spark.createDataFrame(rows, "qvi string, cost_driver string, encounter_id long")
    ours = {tuple(r) for r in quality.chi_base(g, "Control").collect()}
    g.where("qvi <> 'Control'").createOrReplaceTempView("qvi_g")
    g.where("qvi = 'Control'").createOrReplaceTempView("con_g")
    literal = spark.sql("""
        select coalesce(con.cost_driver, qvi.cost_driver) as cost_driver,
          count(distinct qvi.encounter_id) as qvi_trmt, (select count(distinct encounter_id) from qvi_g) as qvi_tot,
          count(distinct con.encounter_id) as con_trmt, (select count(distinct encounter_id) from con_g) as con_tot
        from qvi_g qvi full outer join con_g con on con.cost_driver = qvi.cost_driver
        group by coalesce(con.cost_driver, qvi.cost_driver)""")
    assert ours == {tuple(r) for r in literal.collect()}


def test_one_scan_dimensions_equal_separate_queries(spark):
    billing = R._peer_billing(spark, SF)
    together = {tuple(r) for r in benchmark.utilisation(billing, R.BM_CLIENT_DIMS + R.BM_ENTITY_DIMS).collect()}
    apart = set()
    for d in R.BM_CLIENT_DIMS + R.BM_ENTITY_DIMS:
        apart |= {tuple(r) for r in benchmark.utilisation(billing, [d]).collect()}
    assert together == apart


def test_utilisation_cases_within_volumes(spark):
    dims = R.BM_CLIENT_DIMS + R.BM_ENTITY_DIMS
    u = benchmark.utilisation(R._peer_billing(spark, SF), dims).select("dimension", "flag", "dim_value", "cases")
    v = benchmark.volumes(R._cohort(spark, SF), dims).withColumnRenamed("cases", "total")
    j = u.join(v, ["dimension", "flag", "dim_value"], "left")
    assert j.where(F.col("total").isNull() | (F.col("cases") > F.col("total"))).count() == 0


def test_bins_partition_rows(spark):
    donors = cohort.cohort_filter(R.fx(spark, SF).donor, R.DONOR)
    oh = cohort.one_hot(cohort.add_bins(donors))
    for _, label, spec in cohort.DONOR_BINS:
        s = sum(F.col(r[2]) for r in spec)
        bad = oh.where((s > 1) | ((s == 1) != F.col(label).isNotNull()))
        assert bad.count() == 0, label


def test_phase_labels_cover_lines(spark):
    pl = R.QUERIES["phase_label"](spark, SF)
    assert pl.count() == pl.groupBy("date_of_service").count().agg(F.sum("count")).first()[0]
    assert set(r.date_of_service for r in pl.select("date_of_service").distinct().collect()) <= {
        "Before Proc", "After Proc", "Day of Proc", "NA"}


def test_hot_group_row_number_spans_tasks(spark):
    from wardlens.functions.ranking import group_row_number
    rnd = random.Random(17)
    rows = [(0, rnd.random(), i) for i in range(3000)] + [(g, rnd.random(), 10000 + i)
                                                           for i in range(6000) for g in [1 + i % 50]]
    df = spark.createDataFrame(rows, "g long, v double, id long")
    got = group_row_number(df, ["g"], ["v", "id"], "rn", num_partitions=8)
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert {(r.id, r.rn) for r in got.collect()} == {(r.id, r.rn) for r in exp.collect()}
    tasks = (df.repartitionByRange(8, "g", "v", "id").withColumn("t", F.spark_partition_id())
             .where("g = 0").select("t").distinct().count())
    assert tasks > 1  # the hot group is spread over several tasks
