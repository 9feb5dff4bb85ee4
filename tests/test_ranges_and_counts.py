"""Range lookup, mergeable distinct counts, co-located facts, the chi-squared tail and large tables."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardlens.functions.chisq import chi2_pvalue, chi2_sf
from wardlens.functions.distinct import distinct_counts, distinct_state, merged
from wardlens.functions.drg import category_ranges
from wardlens.functions.ranges import checked, overlaps, range_lookup
from wardlens.operators import contingency as ct
from wardlens.operators import drg, entity_compare as ent
from wardlens.plans import registry as R
from wardlens.sources.warehouse import co_located, drop_database

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_table_equals_case(spark):
    codes = [(str(i),) for i in range(-5, 1105)] + [("007",), ("x",), (None,), ("",)]
    df = spark.createDataFrame(codes, "msdrg_code string")
    ranges = spark.createDataFrame(category_ranges(), "lo int, hi int, label string")
    a, b = drg.with_range_group(df, ranges), drg.with_mdc_group(df)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert "NestedLoop" not in _plan(a) and "Cartesian" not in _plan(a)


def test_overlapping_ranges_are_rejected(spark):
    ok = [(1, 5, "a", 1), (6, 6, "b", 1), (3, 8, "c", 2)]
    schema = "lo int, hi int, label string, version int"
    assert overlaps(spark.createDataFrame(ok, schema), ("version",)).count() == 0
    for bad in ((5, 7, "x", 1), (2, 3, "x", 1), (0, 99, "x", 1), (9, 8, "x", 3)):
        with pytest.raises(ValueError, match="overlaps"):
            checked(spark.createDataFrame([*ok, bad], schema), ("version",))


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_range_lookup_brute_force(spark, width):
    rnd = random.Random(width)
    edges = sorted(rnd.sample(range(-500, 500), 40))
    ranges = [(a, b - rnd.randint(1, 2), f"r{a}") for a, b in zip(edges[::2], edges[1::2]) if b - 2 >= a]
    numbers = [(rnd.randint(-600, 600),) for _ in range(400)] + [(None,)]
    got = range_lookup(spark.createDataFrame(numbers, "n int"), F.col("n"), checked(spark.createDataFrame(ranges, "lo int, hi int, label string")), "label", "out", "none", width)
    expected = [(n, next((x for lo, hi, x in ranges if n is not None and lo <= n <= hi), "none")) for n, in numbers]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_distinct_counts_merge(spark):
    rnd = random.Random(4)
    ids = [rnd.choice([rnd.randint(-70_000, 70_000), rnd.randint(1, 50), 1 << 40, None]) for _ in range(3000)]
    df = spark.createDataFrame([(rnd.choice("abc"), rnd.choice(["x", "y", None]), i) for i in ids], "g string, s string, id long")
    first, second = (distinct_state(df.where(c), ["g", "s"], "id") for c in ("id % 2 = 0 or id is null", "id % 2 <> 0 or id < 100"))
    both = merged(first.union(second), ["g", "s"])  # new data is merged into the old state
    for keys in (["g", "s"], ["g"], ["s"], []):
        got = distinct_counts(both, keys, "n")
        exp = df.where("id is not null").groupBy(*keys).agg(F.count_distinct("id").alias("n"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, exp.collect())), keys


def test_co_located_facts_need_no_shuffle(spark):
    f = R.fx(spark, SF)
    facts = co_located(spark, f.encounter, f.line, f.cost, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        enc = ent.encounter_base(facts.table("encounter"), f.source_system, f.physician, R.ENT)
        bill = ent.bill(enc, facts.table("billing_line"), facts.table("line_cost"), f.charge_code, R.ENT)
        plain = R.QUERIES["ent_bill"](spark, SF)
        assert sorted(map(repr, bill.collect())) == sorted(map(repr, plain.collect()))
        # Only the dimensions are broadcast here; the facts are joined with each other by their buckets.
        bare = f.line.columns
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        lines, costs = facts.table("billing_line"), facts.table("line_cost")
        from wardlens.operators._keys import join_costs
        joined = join_costs(lines.where("fiscal_year = 1996").join(facts.table("encounter").where("fiscal_year = 1996").select("encounter_id", "entity"), "encounter_id"),
                            costs.where("fiscal_year = 1996"), "inner").groupBy("encounter_id", "entity", "charge_code_id").agg(F.sum("units").alias("u"))
        plan = _plan(joined)
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan, plan
        assert plan.count("PartitionFilters: [isnotnull(fiscal_year") == 3, plan
        assert "row_id" in bare
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        drop_database(spark, facts)


def test_buckets_of_the_facts_grow_with_the_lines(spark, monkeypatch):
    loaded = []

    def load(*args, **kwargs):
        loaded.append(co_located(*args, **kwargs))
        return loaded[-1]

    monkeypatch.setattr(R, "co_located", load)
    monkeypatch.setattr("wardlens.sources.warehouse.BUCKET_ROWS", 500, raising=False)
    try:
        bill = R.QUERIES["ent_bill_co_located"](spark, SF)
        n = R.fx(spark, SF).t.lineitem.count()
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {loaded[0].prefix}.billing_line").collect()}
        assert int(told["Num Buckets"]) == -(-n // 500) > 8
        assert sorted(map(repr, bill.collect())) == sorted(map(repr, R.QUERIES["ent_bill"](spark, SF).collect()))
    finally:
        drop_database(spark, loaded[0])


def test_tail_equals_the_gamma_function(spark):
    rows = [(float(x), k) for k in (1, 2, 3, 4, 5, 9, 10, 37, 100, 101, 999, 2000) for x in (1e-9, 0.004, 0.5, 1.0, 3.841458820694124, 4.9999, 5.0001, 20.0, 99.5, 950.0, 2000.0, 5000.0)]
    rows += [(0.0, 3), (-1.0, 2)]
    df = spark.createDataFrame(rows, "x double, k int").withColumn("p", chi2_pvalue(F.col("x"), F.col("k")))
    assert "Python" not in _plan(df) and "Arrow" not in _plan(df)
    for r in df.collect():
        assert abs(r.p - chi2_sf(r.x, r.k)) < 1e-11, r
    none = spark.createDataFrame([(None, 1), (1.0, None), (1.0, 0), (float("nan"), 2)], "x double, k int")
    assert [r.p for r in none.select(chi2_pvalue(F.col("x"), F.col("k")).alias("p")).collect()] == [None] * 4


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("size", [7, 10 ** 5, 10 ** 9, 10 ** 11])
def test_statistic_of_large_tables(spark, ansi, size):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rnd = random.Random(size)
        cells = [(rnd.randint(1, size), rnd.randint(size, 2 * size), rnd.randint(size, 3 * size), rnd.randint(3 * size, 9 * size)) for _ in range(50)]
        df = spark.createDataFrame(cells, "n long, r long, c long, t long")
        got = df.select("*", ct.chi_term(F.col("n"), F.col("r"), F.col("c"), F.col("t")).alias("x")).collect()
        for g in got:
            above, below = g.t * g.n * g.n * 10 ** 9, g.r * g.c
            assert g.x == Decimal((2 * above + below) // (2 * below)).scaleb(-9), g
        with pytest.raises(Exception, match="contingency table"):
            spark.createDataFrame([(1, 1, 1, 10 ** 12 + 1)], "n long, r long, c long, t long").select(ct.chi_term(F.col("n"), F.col("r"), F.col("c"), F.col("t"))).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
