"""Hand-made fixtures, one per documented decision."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from wardlens.functions.exact import ratio
from wardlens.operators import cohort, contingency, drg, entity_compare, quality, redundancy
from wardlens.params import DonorCohortParams

D = dt.date


def _usage(spark, rows):
    return spark.createDataFrame(
        [(e, f"R{e}", code, d, dt.datetime.combine(d, dt.time(h)), uos, Decimal(unit), Decimal(vdc), i)
         for i, (e, code, d, h, uos, unit, vdc) in enumerate(rows)],
        "encounter_id long, record_number string, cpt_code string, service_date date, service_ts timestamp, "
        "uos int, unit_cost decimal(18,2), vdc decimal(18,2), event_id long")


TIE = ("service_ts", "cpt_code", "unit_cost", "event_id")


def test_adjacent_labels(spark):
    u = _usage(spark, [(1, "x", D(2024, 1, 1), 8, 1, "10", "10"), (1, "x", D(2024, 1, 1), 9, 1, "10", "10"),
                       (1, "x", D(2024, 1, 2), 8, 1, "10", "10"), (2, "x", D(2024, 1, 2), 8, 1, "10", "10")])
    a = redundancy.adjacent_rows(redundancy.rank_codes(u, ()), TIE)
    got = sorted((r.encounter_id, r.service_ts.hour, r.service_date.day, r.same_day, r.date_diff) for r in a.collect())
    assert got == [(1, 8, 1, "NA", 99999), (1, 8, 2, "NA", 1), (1, 9, 1, "same day", 0), (2, 8, 2, "NA", 99999)]


def test_same_day_excess_values(spark):
    u = _usage(spark, [(1, "x", D(2024, 1, 1), 8, 3, "10", "30"), (1, "x", D(2024, 1, 3), 8, 1, "10", "10"),
                       (1, "x", D(2024, 1, 5), 8, 2, "10", "20"), (1, "x", D(2024, 1, 5), 9, 2, "10", "20")])
    a = redundancy.adjacent_rows(redundancy.rank_codes(u, ()), TIE, keep_null_time=True)
    rows = sorted(redundancy.same_day_excess(a).collect(), key=lambda r: r.event_id)
    assert [r.same_day_excess_uos for r in rows] == [2, 0, 1, 2]
    assert [r.same_day_excess_vdc for r in rows] == [Decimal("20"), Decimal("0"), Decimal("10"), Decimal("20")]


def test_savings_null_when_no_scope(spark):
    u = _usage(spark, [(1, "x", D(2024, 1, 1), 8, 1, "10", "10"), (2, "x", D(2024, 1, 3), 8, 1, "10", "10")])
    a = redundancy.adjacent_rows(redundancy.rank_codes(u, ()), TIE, keep_null_time=True)
    r = redundancy.savings(a, 2024).collect()[0]
    assert r.same_day_excess_vdc is None and r.total_savings is None


def test_clean_usage_null_cost_passes(spark):
    df = spark.createDataFrame([(1, Decimal(1), None), (2, Decimal(1), Decimal(0)), (3, Decimal(1), Decimal(5))],
                               "encounter_id long, uos decimal(18,2), vdc decimal(18,2)")
    assert sorted(r.encounter_id for r in redundancy.clean_usage(df).collect()) == [1, 3]


def test_row_index_matches_row_number(spark):
    rows = [(e, "x", D(2024, 1, 1 + (i % 3)), i % 24, 1, "1", "1") for e in (1, 2) for i in range(20)]
    u = redundancy.rank_codes(_usage(spark, rows), ())
    got = {r.event_id: r.row_num for r in redundancy.row_index(u, TIE).collect()}
    exp = {r.event_id: r.rn for r in u.selectExpr(
        "event_id", "row_number() over (partition by encounter_id order by service_date, cc_rank, "
        "service_ts, cpt_code, unit_cost, event_id) rn").collect()}
    assert got == exp


def test_chi_square_2x2(spark):
    rows = ([("VAP", "X", i) for i in range(30)] + [("VAP", "Y", i) for i in range(30, 40)]
            + [("Control", "X", i) for i in range(100, 120)] + [("Control", "Y", i) for i in range(120, 160)])
    g = spark.createDataFrame(rows, "qvi string, cost_driver string, encounter_id long")
    r = quality.chi_rows(quality.chi_base(g, "Control"))
    lab = {x.cost_driver: x for x in quality.chi_label(r, quality.chi_diff(r, quality.chi_expected(r))).collect()}
    assert lab["X"].chi_square == Decimal("16.666666")
    assert lab["X"].significance == "Statistically Higher Utilization"


def test_driver_only_in_event_group(spark):
    g = spark.createDataFrame([("VAP", "X", 1), ("VAP", "Z", 2), ("Control", "X", 3)],
                              "qvi string, cost_driver string, encounter_id long")
    b = {r.cost_driver: r for r in quality.chi_base(g, "Control").collect()}
    assert b["Z"].qvi_trmt == 1 and b["Z"].con_trmt == 0 and b["Z"].con_tot == 1


def test_phase_calendar_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 59), dt.datetime(2024, 1, 2, 0, 1))], "p timestamp, c timestamp")
    assert df.select(quality.phase(F.col("p"), F.col("c")).alias("x")).first().x == "After Proc"


def test_contingency_matches_chisquaretest(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.stat import ChiSquareTest
    import random
    random.seed(7)
    data = [(random.choice("abc"), random.choice("uvwx")) for _ in range(400)]
    df = spark.createDataFrame(data, "x string, y string")
    t = contingency.contingency(df, "x", "y")
    p = contingency.with_pvalues(t, []).first()
    xi = {k: i for i, k in enumerate("abc")}
    yi = {k: float(i) for i, k in enumerate("uvwx")}
    ml = spark.createDataFrame([(Vectors.dense([float(xi[a])]), yi[b]) for a, b in data], ["features", "label"])
    ref = ChiSquareTest.test(ml, "features", "label").first()
    assert abs(float(p.chi_square) - ref.statistics[0]) < 1e-5
    assert p.dof == ref.degreesOfFreedom[0]
    assert abs(p.p_value - ref.pValues[0]) < 1e-6


def test_chi2_critical_values():
    from wardlens.functions.chisq import chi2_critical, chi2_sf
    assert abs(chi2_critical(1) - 3.841458820694124) < 1e-9
    assert abs(chi2_critical(2) - 5.991464547107979) < 1e-9
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12


def test_drg_edges(spark):
    codes = ["019", "020", "103", "104", "112", "113", "998", "999", "abc"]
    df = spark.createDataFrame([(c,) for c in codes], "msdrg_code string")
    got = [r.msdrg_groupings for r in drg.with_mdc_group(df).collect()]
    assert got[0].startswith("Solid Organ") and got[1] == got[2] == "Nervous System"
    assert got[3] == got[4] == "Ungroupable" and got[5] == "Eye"
    assert got[6] == "Principal Diagnosis Invalid as Discharge Diagnosis" and got[7] == got[8] == "Ungroupable"


def test_bins_and_indicators(spark):
    df = spark.createDataFrame([(14.0, 20.0), (15.0, 29.9), (30.0, 30.0), (31.0, 35.0), (75.0, None), (76.0, 36.0)],
                               "age_don double, bmi_don double")
    bins = [("age_don", "a", cohort.DONOR_BINS[0][2]), ("bmi_don", "b", cohort.DONOR_BINS[1][2])]
    rows = cohort.add_bins(df, bins).collect()
    assert [r.a for r in rows] == ["dAgeSub15", "dAge15_19", "dAge25_30", "dAge30_44ref", "dAge70_75", "dAge75plus"]
    assert [r.b for r in rows] == ["dBMIsub20", "dBMI20_29ref", "dBMI30_34", "dBMI35plus", None, "dBMI35plus"]
    oh = cohort.one_hot(cohort.add_bins(df, bins), bins).collect()
    assert all(sum(r[n] for n in ("dAgeSub15", "dAge15_19", "dAge25_30", "dAge30_44ref", "dAge70_75", "dAge75plus",
                                  "dAge20_24", "dAge45_54", "dAge55_59", "dAge60_64", "dAge65_69")) == 1 for r in oh)
    assert oh[4]["dBMI35plus"] == 0 and oh[4]["dBMIsub20"] == 0


def test_blank_and_flags(spark):
    base = dict(age=30.0, tx_year=2005, tx_kid=None, tx_lng=None, tx_int=None, tx_pan=None, tx_retxdate=None,
                prev_tx=None, tx_date="2005-01-01", age_don=30.0)
    rows = [dict(base, tx_hrt=v) for v in (None, "", "Y")]
    cols = list(rows[0])
    schema = ", ".join(f"{c} {'double' if c in ('age', 'age_don') else 'int' if c == 'tx_year' else 'string'}" for c in cols)
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)
    assert cohort.cohort_filter(df, DonorCohortParams()).count() == 2
    dm = spark.createDataFrame([(1,), (2,), (None,)], "hist_diabetes_don int")
    assert [r.hx_DM2 for r in cohort.flags(dm, [f for f in cohort.DONOR_FLAGS if f[0] == "hx_DM2"]).collect()] == [0, 1, 1]


def test_populated_pct(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,)], "v int")
    assert cohort.populated_pct(df, ["v"]).first().pct_populated == 75.0


def test_compat_first_setting(spark):
    wl = spark.createDataFrame([(e, s, "L", 10, 100.0 + i) for i, (e, s) in enumerate(
        [(e, s) for e in ("E1", "E2", "E3") for s in ("S1", "S2")])],
        "entity string, patient_setting string, service_line string, cases long, vdc double")
    assert wl.count() == 6 and entity_compare.first_setting_per_line(wl).count() == 3


def test_exact_ratio_half_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("1000.01"), 2), (Decimal("-1000.01"), 2), (Decimal("1"), 3)],
                               "a decimal(18,2), b long")
    got = [r.r for r in df.select(ratio(F.col("a"), 2, F.col("b"), 0, 2).alias("r")).collect()]
    assert got == [Decimal("500.01"), Decimal("-500.01"), Decimal("0.33")]


def _qa_inputs(spark):
    enc = spark.createDataFrame(
        [(1, "R1", "E", "IP", "CTF", 2020, 0, 1, "Yes", 40, 3, 0, 1, 5, 4)],
        "encounter_id long, record_number string, entity string, patient_setting string, service_line string, "
        "fiscal_year int, source_system_id int, attend_physician_id int, has_charge string, age int, los int, "
        "primary_qvi_id int, gender_id int, apr_drg_id int, age_cohort_id int")
    src = spark.createDataFrame([(0, 1, "Hospital Billing")], "source_system_id int, category_id int, category_name string")
    md = spark.createDataFrame([(1, "Dr A", 3, "Spec")], "physician_id long, full_name string, specialty_id int, specialty string")
    ind = spark.createDataFrame([(1, "CTF"), (1, "OTHER")], "encounter_id long, name string")
    gender = spark.createDataFrame([(1, "Female")], "gender_id int, description string")
    apr = spark.createDataFrame([(5, 3, 2)], "apr_drg_id int, aprrom int, aprsoi int")
    ages = spark.createDataFrame([(4, "40-49")], "age_cohort_id int, name string")
    return enc, src, md, ind, gender, apr, ages


def test_indicator_fanout_default_and_compat(spark):
    from wardlens.params import QualityParams
    dims = _qa_inputs(spark)
    p = QualityParams(fiscal_year=2020, qvi_names=("VAP",), population=("CTF",), inpatient_settings=("IP",))
    one = quality.quality_encounters(*dims, p).collect()
    assert [(r.gender, r.risk_of_mortality, r.severity_of_illness, r.age_cohort) for r in one] == [("Female", 3, 2, "40-49")]
    assert quality.quality_encounters(*dims, p, compat_fanout=True).count() == 2


def test_excluded_driver_is_found_in_any_spelling(spark):
    from wardlens.params import QualityParams
    p = QualityParams(fiscal_year=2020, qvi_names=("VAP",), population=("CTF",))
    enc = spark.createDataFrame([(1, 0)], "encounter_id long, primary_qvi_id int").selectExpr(
        "*", *[f"'x' as {a}" for a in quality.ATTRS if a != "encounter_id"])
    ts = dt.datetime(2020, 1, 1, 8)
    proc = spark.createDataFrame([(1, ts.date(), ts)], "encounter_id long, service_date date, service_ts timestamp")
    lines = spark.createDataFrame([(i, 1, 7, i, ts, Decimal(2)) for i in range(4)], "row_id long, encounter_id long, "
                                  "charge_code_id int, ub_revenue_code_id int, service_ts timestamp, units decimal(18,2)")
    costs = spark.createDataFrame([(i, Decimal(3)) for i in range(4)], "row_id long, unit_cost decimal(18,2)")
    cc = spark.createDataFrame([(7, "Code seven")], "charge_code_id int, description string")
    ub = spark.createDataFrame([(0, "Room"), (1, "excluded "), (2, " EXCLUDED"), (3, None)],
                               "ub_revenue_code_id int, cost_driver string")
    got = quality.control_group(enc, proc, lines, costs, cc, ub, p).collect()
    assert [(r.cost_driver, r.charge_code_desc, r.vdc) for r in got] == [("Room", "Code seven", Decimal("6.0000"))]


def test_driver_summary_pools_events(spark):
    g = spark.createDataFrame([("VAP", "X", 1, Decimal(2)), ("FALL", "X", 2, Decimal(4)), ("Control", "X", 3, Decimal(1))],
                              "qvi string, cost_driver string, encounter_id long, vdc decimal(18,4)")
    got = {r.event_group: (r.cases, r.totcases, r.vdc_per_case) for r in quality.driver_summary(g, "Control").collect()}
    assert got == {"Quality event": (2, 2, Decimal("3.000000")), "Control": (1, 1, Decimal("1.000000"))}


def test_single_procedure_two_times_one_day(spark):
    lines = spark.createDataFrame(
        [(1, 7, D(2024, 1, 1), dt.datetime(2024, 1, 1, 8)), (1, 7, D(2024, 1, 1), dt.datetime(2024, 1, 1, 15))],
        "encounter_id long, cpt_id int, service_date date, service_ts timestamp")
    enc = spark.createDataFrame([(1,)], "encounter_id long")
    cpt = spark.createDataFrame([(7, "C007")], "cpt_id int, cpt_code string")
    literal = quality.procedure_dates(lines, enc, cpt, ["C007"])
    by_day = quality.procedure_dates(lines, enc, cpt, ["C007"], by_date=True)
    assert quality.single_procedure(literal).count() == 0
    assert quality.single_procedure(by_day).count() == 1


def test_patient_days_use_the_pair_not_text(spark):
    from wardlens.operators import benchmark
    rows = [(1, 0, 0, 23, Decimal("1.00"), "T0", "1"), (12, 0, 0, 3, Decimal("1.00"), "T0", "1")]
    b = spark.createDataFrame(rows, "encounter_id long, orgpin int, stratum_id int, servicedateid int, "
                                    "units_of_service decimal(18,2), clienttype string, clientofinterest string")
    r = benchmark.utilisation(b, [("clienttype", "clientofinterest", None)]).first()
    assert r.patient_days == 2 and r.cases == 2


def test_chi2_tail_large_dof():
    from wardlens.functions.chisq import chi2_sf
    for dof in (101, 1_000, 10**6, 10**8):
        assert abs(chi2_sf(float(dof), dof) - 0.5) < 0.3 / dof ** 0.5 + 1e-4
    assert abs(chi2_sf(124.34211340400407, 101) - 0.057) < 1e-2


def test_contingency_counts_beyond_64_bit_products(spark):
    from wardlens.operators.contingency import contingency, significant_levels
    rows = spark.range(12_000_000).select((F.col("id") % 2).alias("x"), (F.floor(F.col("id") / 2) % 2).alias("y"))
    out = contingency(rows, "x", "y").collect()
    assert len(out) == 4 and all(r.n == 3_000_000 and r.chi_square == 0 and r.dof == 1 for r in out)
    assert [r.significant for r in significant_levels(rows, "x", "y").collect()] == [False, False]


def test_money_sum_equals_decimal_sum(spark):
    import random
    from wardlens.functions.exact import money_sum
    rnd = random.Random(5)
    rows = [(rnd.randint(1, 5), Decimal(rnd.randint(-10**6, 10**6)) / 100 if rnd.random() > 0.1 else None,
             Decimal(rnd.randint(1, 5000)) / 100) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g int, a decimal(18,2), b decimal(18,2)")
    got = {r.g: r.v for r in df.groupBy("g").agg(money_sum(F.col("a") * F.col("b")).alias("v")).collect()}
    exp = {r.g: r.v for r in df.groupBy("g").agg(F.sum(F.col("a") * F.col("b")).cast("decimal(38,4)").alias("v")).collect()}
    assert got == exp


def test_checkpoint_dir_from_session_is_kept(spark):
    from wardlens.session import ensure_checkpoint_dir
    before = spark.sparkContext.getCheckpointDir()
    assert ensure_checkpoint_dir(spark) == before and before


def test_adjacent_rows_keep_rows_without_a_date(spark):
    from wardlens.operators.redundancy import adjacent_rows
    rows = [(1, None, None, 1, 1), (1, "1996-01-02", "1996-01-02 01:00:00", 1, 2), (1, "1996-01-02", "1996-01-02 02:00:00", 1, 3), (2, None, None, 1, 4)]
    df = (spark.createDataFrame(rows, "encounter_id int, service_date string, service_ts string, cc_rank int, row_id int")
          .withColumn("service_date", F.to_date("service_date")).withColumn("service_ts", F.to_timestamp("service_ts")))
    out = {r.row_id: r for r in adjacent_rows(df, ["row_id"], keep_null_time=True).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert [out[i].same_day for i in (1, 2, 3, 4)] == ["NA", "NA", "same day", "NA"]
    assert [out[i].date_diff for i in (1, 2, 3, 4)] == [99999, 99999, 0, 99999]
    assert {r.row_id for r in adjacent_rows(df, ["row_id"]).collect()} == {2, 3}
