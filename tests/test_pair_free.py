"""Pair-free comparison, adjacency with ties and the one-derivation savings, against the forms with pairs and rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardlens.functions.ranking import previous_row, range_sorted
from wardlens.operators import entity_compare as ent
from wardlens.operators import redundancy as red
from wardlens.params import EntityCompareParams
from wardlens.plans import registry as R

SF = "/root/testdata/sf0.001"
USAGE = ("full_charge_code_description string, cost_driver string, cc_rollup string, entity string, patient_setting string, "
         "service_line string, cases long, vdc decimal(38,4), tot_cases long, vdc_per_case decimal(38,6)")


def _random_code_usage(spark, seed, n=700):
    """Unique (code, group) rows with ties in cost per case, several rollups of one code, and NULLs in every key."""
    rnd = random.Random(seed)
    rows = {}
    for _ in range(n):
        key = (rnd.choice(["c1", "c2", "c3", None]), rnd.choice(["d1", "d2", None]), rnd.choice(["r1", "r2", "r3"]),
               rnd.choice(["E%d" % i for i in range(9)] + [None]), rnd.choice(["IP", "OP"]), rnd.choice(["L1", "L2"]))
        per_case = rnd.choice([None, Decimal(rnd.randint(-3, 12)), Decimal(rnd.randint(1, 10**9)) / 10**6])
        rows[key] = (rnd.randint(1, 50), Decimal(rnd.randint(-5000, 50000)) / 100, rnd.choice([0, 60, 90]), per_case)
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], USAGE)


def _same(a, b):
    assert a.columns == b.columns and [t for _, t in a.dtypes] == [t for _, t in b.dtypes]
    got, exp = sorted(map(repr, a.collect())), sorted(map(repr, b.collect()))
    assert got == exp and got
    return len(got)


@pytest.mark.parametrize("seed", range(4))
def test_comparison_without_pairs(spark, seed):
    usage = _random_code_usage(spark, seed)
    groups = usage.select(*ent.GROUP).distinct().where(F.xxhash64(*ent.GROUP) % 3 != 0)
    pairs = ent.comparison_pairs(usage, groups)
    _same(ent.overlapping_usage(usage, groups), ent.overlapping_codes(pairs))
    _same(ent.unique_usage(usage, groups), ent.unique_codes(pairs))


def test_comparison_without_pairs_on_the_tables(spark):
    usage, groups = R._ent_compared(spark, SF)
    pairs = ent.comparison_pairs(usage, groups)
    assert _same(ent.overlapping_usage(usage, groups), ent.overlapping_codes(pairs)) > 20
    _same(ent.unique_usage(usage, groups), ent.unique_codes(pairs))
    bill = R._ent_bill(spark, SF)
    listed = ent.work_list(ent.bill_by_encounter(bill), EntityCompareParams(fiscal_years=(1996,)))
    _same(ent.work_groups(usage, R.ENT).select(*ent.GROUP), listed.select(*ent.GROUP))


def test_comparison_plan_has_no_self_join(spark):
    usage = _random_code_usage(spark, 9)
    plan = ent.overlapping_usage(usage, usage.select(*ent.GROUP).distinct())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "LeftSemi" in plan  # the work list


ROWS = ("encounter_id long, record_number string, cpt_code string, service_date date, service_ts timestamp_ntz, uos int, "
        "unit_cost decimal(18,2), vdc decimal(18,2), note string")
TIE = ("service_ts", "cpt_code")


def _tied_usage(spark, seed, n=500):
    """Usage whose ordering key ties often, with equal rows, rows without a date or time, and encounters to clean away."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        e = rnd.choice([1, 1, 1, *range(2, 30), None])
        d = rnd.choice([dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 9))] * 9 + [None])
        ts = None if d is None or rnd.random() < 0.1 else dt.datetime.combine(d, dt.time(rnd.choice([8, 9])))
        uos, unit = rnd.choice([1, 1, 1, 2, 3]), Decimal(rnd.choice([5, 10, 20]))
        if e in (7, 8) and rnd.random() < 0.3:
            uos = 0
        vdc = rnd.choice([unit * uos] * 12 + [None])
        rows.append((e, None if e is None or e == 9 else f"R{e // 2}", rnd.choice("ab"), d, ts, uos, unit, vdc, rnd.choice("xy")))
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("seed", range(3))
def test_adjacency_with_ties_brute_force(spark, seed):
    ranked = red.rank_codes(_tied_usage(spark, seed), (("a", "A"),))
    low = lambda v: (v is not None, v)  # noqa: E731  # NULL first
    rows = [r.asDict() for r in ranked.collect()]
    first = ("encounter_id", "service_date", "cc_rank", *TIE)
    order = (*first, *[c for c in ranked.columns if c not in first])
    rows.sort(key=lambda r: [low(r[c]) for c in order])
    expected = []
    for i, r in enumerate(rows):
        p = rows[i - 1] if i and rows[i - 1]["encounter_id"] == r["encounter_id"] else None
        if p and p["service_date"] == r["service_date"]:
            expected.append((*r.values(), "same day", 0))
        else:
            gap = (r["service_date"] - p["service_date"]).days if p and p["service_date"] and r["service_date"] else 99999
            expected.append((*r.values(), "NA", gap))
    got = red.adjacent_rows(ranked, TIE, keep_null_time=True)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    firsts = got.where("same_day = 'NA'").groupBy("encounter_id", "service_date").count()
    assert firsts.where("count <> 1").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_savings_in_one_derivation(spark, seed):
    usage = _tied_usage(spark, 10 + seed)
    ranks = (("b", "A"),)
    rows = red.adjacent_rows(red.rank_codes(red.clean_usage(usage), ranks), TIE, keep_null_time=True)
    _same(red.savings_from_usage(usage, ranks, TIE, 2024), red.savings(rows, 2024))


def test_savings_without_scope_or_rows(spark):
    usage = _tied_usage(spark, 1)
    for none in (usage.where("false"), usage.where("encounter_id = 9"), usage.where("service_ts is null").limit(1)):
        r = red.savings_from_usage(none, (), TIE, 2024).first()
        assert r.fiscalyear == 2024 and r.total_savings is None and r.total_excess_tests is None


def test_savings_plan_one_scan_three_exchanges(spark):
    plan = R.QUERIES["savings"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 3 and "Join" not in plan


def test_previous_row_over_tasks_without_rows(spark):
    df = spark.createDataFrame([(i // 40, i % 7) for i in range(200)], "g int, v int")
    got = previous_row(range_sorted(df, ["g", "v"], num_partitions=23), ["g", "v"]).orderBy("_mid").collect()
    assert [r._prev and tuple(r._prev) for r in got] == [None, *[(r.g, r.v) for r in got[:-1]]]
    assert [(r.g, r.v) for r in got] == sorted((i // 40, i % 7) for i in range(200))
    tied = range_sorted(spark.createDataFrame([(1, 1)] * 4000, "g int, v int"), ["g", "v"], num_partitions=8)
    assert tied.select("_task").distinct().count() > 1  # ties are spread


@pytest.mark.parametrize(("name", "amount", "rest"), [
    ("ent_report_sorted", "impact_dollars", ("overlapping_charge_codes", "entity_of_interest", "patient_setting", "service_line")),
    ("ent_report_unique_sorted", "eoi_vdc", ("charge_codes_unique_to_entity_of_interest", "entity_of_interest", "patient_setting", "service_line"))])
def test_reports_come_in_order(spark, name, amount, rest):
    rows = R.QUERIES[name](spark, SF).collect()
    keys = [(-r[amount], *(r[c] for c in rest)) for r in rows]
    assert len(rows) > 10 and keys == sorted(keys)
