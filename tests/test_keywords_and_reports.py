"""Keyword index, stored reports, CSV rejects, client databases and collation, each against a plain form."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.keywords import match_keywords
from wardlens.operators import cohort as co
from wardlens.operators import opportunity as opp
from wardlens.plans import registry as R
from wardlens.sources.clients import ClientDatabases, UnknownClient, publish_clients
from wardlens.sources.collation import WAREHOUSE, collated, plain
from wardlens.sources.reports import Conflict, ReportStore

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --------------------------------------------------------------- keywords
def dictionaries(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts = [(rng.choice("xy"), w) for w in words] + [("x", None), (None, "abc"), ("x", "A%B_c\\d"), ("y", "100% Cotton"), ("x", "ΣΊΣΥΦΟΣ")]
    keys = [(rng.choice("xy"), "".join(rng.choice("abcdeÉ%_") for _ in range(rng.randint(0, 5)))) for _ in range(400)]
    keys += [("x", None), (None, "a"), ("x", "\\%b"), ("y", "0\\%"), ("x", "%%"), ("y", ""), ("x", "σίσυφ"), ("x", "c\\\\d")]
    return spark.createDataFrame(texts, "grp string, txt string"), spark.createDataFrame(keys, "grp string, kw string")


def test_keyword_index_equals_like(spark):
    texts, keys = dictionaries(spark)
    got = match_keywords(texts, "txt", keys, "kw", by=["grp"])
    plainly = texts.distinct().join(keys.distinct(), "grp").where(F.ilike("txt", F.concat(F.lit("%"), "kw", F.lit("%")))).select("grp", "kw", "txt")
    assert rows(got) == rows(plainly) and got.count() > 400
    every = match_keywords(texts, "txt", keys, "kw")
    assert rows(every) == rows(texts.select("txt").distinct().crossJoin(keys.select("kw").distinct()).where(F.ilike("txt", F.concat(F.lit("%"), "kw", F.lit("%")))).select("kw", "txt"))


def test_keyword_index_compares_no_product(spark):
    texts, keys = dictionaries(spark)
    plan = match_keywords(texts, "txt", keys, "kw", by=["grp"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keyword_index_of_empty_tables(spark):
    texts, keys = dictionaries(spark)
    assert match_keywords(texts.limit(0), "txt", keys, "kw", by=["grp"]).count() == 0
    assert match_keywords(texts, "txt", keys.limit(0), "kw", by=["grp"]).count() == 0


def test_dictionary_report_equals_the_report_of_few_specs(spark):
    f = R.fx(spark, SF)
    specs = opp.specs_frame(spark, R.OPP_SPECS)
    got = opp.report_of_codes(f.line, f.cost, opp.pick_from_dictionary(f.charge_code, specs), R.OPP_YEARS)
    assert rows(got) == rows(opp.multi_opportunity_report(f.line, f.cost, f.charge_code, R.OPP_SPECS, R.OPP_YEARS))


def picked_lines(spark):
    """Lines, costs and picks with equal and null rows; descriptions whose specs pick the same codes, and others."""
    rng = random.Random(11)
    lines = [(rng.randint(1, 25), f"r{i % 180}", rng.choice([*range(1, 12), None]), rng.choice([1995, 1996, 1997]), Decimal(rng.randint(1, 9))) for i in range(400)]
    costs = [(f"r{i % 150}", None if i % 9 == 0 else Decimal(i % 13)) for i in range(170)]
    picks = [(c, d, s, t, g) for c, d, g in [(1, "bolt", "A"), (2, "bolt", "A"), (2, "gear", "A"), (3, "gear", None), (4, None, "B"), (5, "nut", "B"), (6, "nut", "B")]
             for s, t in [("s1", "t"), ("s2", "t"), (None, "t"), ("s1", None)]]
    picks += [(7, "even", "A", s, "t") for s in ("s1", "s2") for _ in range(2)]  # a code listed twice
    picks += [(8, "uneven", "A", "s1", "t"), (8, "uneven", "A", "s1", "t"), (8, "uneven", "A", "s2", "t"), (9, "uneven", "A", "s3", "t"), (9, "uneven", "A", "s2", "t")]
    picks += [(10, "nut", "B", "s1", "t"), (None, "bolt", "A", "s1", "t"), (None, "bolt", "A", "s9", "t")]
    return (spark.createDataFrame(lines, "encounter_id int, row_id string, charge_code_id int, line_year int, units decimal(18,2)"),
            spark.createDataFrame(costs, "row_id string, unit_cost decimal(18,2)"),
            spark.createDataFrame(picks, "charge_code_id int, full_description string, spec_name string, spec_type string, category string"))


def test_report_of_any_picks_equals_the_plain_sums(spark):
    lines, costs, picked = picked_lines(spark)
    j = lines.where("line_year in (1996, 1997)").join(picked, "charge_code_id").join(costs, "row_id", "left")
    by = ["line_year", "spec_name", "spec_type", "category", "full_description"]
    per = j.groupBy(*by, "encounter_id").agg(F.sum("units").alias("u"), F.sum(F.col("units") * F.col("unit_cost")).alias("v"))
    plainly = per.groupBy(*by).agg(F.count(F.lit(1)).cast("int"), F.sum("u").cast("decimal(20,2)"), F.sum("v").cast("decimal(20,2)"))
    got = opp.report_of_codes(lines, costs, picked, (1996, 1997))
    assert got.columns == opp.REPORT_COLUMNS and rows(got) == rows(plainly) and got.count() > 40


def test_report_does_not_repeat_a_line_for_each_spec(spark, monkeypatch):
    f = R.fx(spark, SF)
    codes = f.charge_code.select("charge_code_id", F.col("name").alias("full_description"), F.col("cost_driver").alias("category"))
    picked = codes.crossJoin(spark.range(40).select(F.concat(F.lit("s"), "id").alias("spec_name"), F.lit("t").alias("spec_type")))
    met = []
    join = opp._line_cost
    monkeypatch.setattr(opp, "_line_cost", lambda lines, costs: met.append(lines.count()) or join(lines, costs))
    got = opp.report_of_codes(f.line, f.cost, picked, R.OPP_YEARS)
    assert met == [f.line.where(F.col("line_year").isin(list(R.OPP_YEARS))).count()]
    assert got.select("opportunity_name").distinct().count() == 40


# ---------------------------------------------------------------- reports
SCHEMA = "opportunity_name string, n int"
NAMES = ["plain", "a/b=c %", "", None, "Ünïcode"]


@pytest.fixture
def store(spark, tmp_path):
    s = ReportStore(spark, str(tmp_path / "report"))
    s.write(spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)] + [("plain", 9)], SCHEMA))
    return s


def test_parts_are_replaced_and_deleted(spark, store):
    assert rows(store.read()) == rows(spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)] + [("plain", 9)], SCHEMA))
    store.replace(["plain"], spark.createDataFrame([("plain", 50)], SCHEMA))
    store.delete([None, "never was"])
    assert rows(store.read()) == rows(spark.createDataFrame([("plain", 50), ("a/b=c %", 1), ("", 2), ("Ünïcode", 4)], SCHEMA))
    store.delete(NAMES)
    assert store.read().count() == 0 and store.read().columns == ["opportunity_name", "n"]


def test_an_empty_redo_removes_its_part(spark, store):
    store.replace(["plain"], spark.createDataFrame([], SCHEMA))
    assert store.read().where("opportunity_name = 'plain'").count() == 0 and store.read().count() == 4


def test_a_failed_job_leaves_the_old_report(spark, store):
    before = rows(store.read())
    bad = spark.range(100).select(F.lit("plain").alias("opportunity_name"), F.when(F.col("id") > 90, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        store.replace(["plain"], bad)
    assert rows(store.read()) == before
    with pytest.raises(ValueError, match="not replaced"):
        store.replace(["plain"], spark.createDataFrame([("other", 1)], SCHEMA))
    assert rows(store.read()) == before


def test_two_writers_do_not_lose_a_change(spark, store):
    after, old = store._manifest()
    store.delete(["plain"])
    with pytest.raises(Conflict):
        store._commit(after, T.StructType.fromJson(old["schema"]), old["parts"])
    assert store.read().where("opportunity_name = 'plain'").count() == 0


def test_older_versions_stay_until_vacuum(spark, store):
    store.delete(["plain"])
    assert store.read(1).count() == 6 and store.read().count() == 4
    assert store.vacuum() == 1 and store.read().count() == 4
    with pytest.raises(Exception):
        store.read(1)
    with pytest.raises(ValueError):
        ReportStore(spark, store.path + "-none").read()


# -------------------------------------------------------------------- CSV
CSV = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])


def load(spark, tmp_path, text):
    path = tmp_path / "extract.csv"
    path.write_text(text)
    return co.load_registry_csv(spark, str(path), CSV)


def test_csv_keeps_blank_and_null_apart_and_rejects_records(spark, tmp_path):
    got = load(spark, tmp_path, 'id,name,x\n1,"",2.5\n2,,\n3," ",1\nfour,a,1\n5,b\n6,c,1,2\n7,"d,e",nan?\n8,"d,e",3\n')
    assert rows(got.rows) == [(1, "", 2.5), (2, None, None), (3, " ", 1.0), (8, "d,e", 3.0)]
    assert rows(got.rejects) == [("5,b",), ("6,c,1,2",), ('7,"d,e",nan?',), ("four,a,1",)]
    assert got.rejects.count() == 4 and co.preview(got.rows, 2).count() == 2


def test_csv_columns_can_be_read_alone(spark, tmp_path):
    # Spark's own reader checks only the columns a query reads; the load checks all.
    got = load(spark, tmp_path, "id,name,x\n1,a,bad\n2,b,3\n")
    assert rows(got.rows.select("id")) == [(2,)] and got.rejects.count() == 1


def test_csv_without_rows_or_with_another_header(spark, tmp_path):
    got = load(spark, tmp_path, "id,name,x\n")
    assert got.rows.count() == got.rejects.count() == 0
    with pytest.raises(Exception):
        load(spark, tmp_path, "id,title,x\n1,a,2\n").rows.count()


# ---------------------------------------------------------------- clients
@pytest.fixture
def clients(spark, tmp_path):
    tag = "".join(c for c in tmp_path.name if c.isalnum())
    table = spark.createDataFrame([(1, f"a-{tag}-1"), (2, f"b-{tag}"), (3, f"c-{tag}"), (4, None)], "orgpin int, DatabaseGUID string")
    found = ClientDatabases(spark, table)
    publish_clients(found, spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "orgpin int, unit string"), "unit_table", str(tmp_path / "clients"))
    return found


def test_tables_of_several_clients_in_one_frame(clients):
    got = clients.table([1, 2], "unit_table")
    assert rows(got.select("orgpin", "unit")) == [(1, "x"), (1, "y"), (2, "z")]
    assert rows(clients.table([2], "unit_table", ["unit"]).select("unit")) == [("z",)]


@pytest.mark.parametrize("pins", [[1, 3], [4], [99]])
def test_clients_without_database_or_table_are_errors(clients, pins):
    with pytest.raises(UnknownClient):
        clients.table(pins, "unit_table")


# -------------------------------------------------------------- collation
def test_collation_in_filter_group_and_join(spark, tmp_path):
    raw = spark.createDataFrame([("Excluded", 1), ("EXCLUDED  ", 2), ("excluded", 3), (" excluded", 4), ("Drug ", 5), (None, 6)], "driver string, n int")
    raw.write.parquet(str(tmp_path / "t"))
    df = collated(spark.read.parquet(str(tmp_path / "t")))
    assert WAREHOUSE in df.schema["driver"].dataType.simpleString() or "collate" in df.schema["driver"].dataType.simpleString()
    assert rows(df.where(F.col("driver") == "excluded").select("n")) == [(1,), (2,), (3,)]
    assert rows(df.where(F.col("driver").isin("DRUG", "x")).select("n")) == [(5,)]
    grouped = df.groupBy("driver").agg(F.sum("n").alias("n"))
    assert rows(grouped.select(plain(F.col("driver")), "n")) == rows(raw.groupBy(F.lower(F.rtrim("driver"))).agg(F.sum("n")))
    dim = collated(spark.createDataFrame([("EXCLUDED", "no"), ("drug", "yes")], "driver string, kept string"))
    assert rows(df.join(dim, "driver").select("n", "kept")) == [(1, "no"), (2, "no"), (3, "no"), (5, "yes")]
    assert rows(raw.select("n")) == rows(df.select("n"))
