"""Sources, sinks and the streaming adapter."""

from pyspark.sql import functions as F

from wardlens.operators import opportunity as opp
from wardlens.plans import registry as R
from wardlens.streaming import refresh_report_per_batch

SF = "/root/testdata/sf0.001"


def test_report_partition_overwrite(spark, tmp_path):
    f = R.fx(spark, SF)
    report = opp.multi_opportunity_report(f.line, f.cost, f.charge_code, R.OPP_SPECS, R.OPP_YEARS)
    path = str(tmp_path / "report")
    opp.write_report(report, path)
    redo = opp.multi_opportunity_report(f.line, f.cost, f.charge_code, R.OPP_SPECS[:1], (1996,))
    opp.write_report(redo, path)  # rewrites only that opportunity's partition
    back = spark.read.parquet(path)
    exp = opp.replace_opportunity(report, R.OPP_SPECS[0].name, redo)
    key = ["opportunity_name", "fiscalyear", "additional_info"]
    assert sorted(map(tuple, back.select(*key, "total_cases").collect())) == \
        sorted(map(tuple, exp.select(*key, "total_cases").collect()))


def test_stream_refresh_equals_batch(spark, tmp_path):
    lines = R.fx(spark, SF).line.select("encounter_id", "units", "line_year")
    src = tmp_path / "incoming"
    lines.where("line_year <= 1997").write.parquet(str(src / "b1"))
    lines.where("line_year > 1997").write.parquet(str(src / "b2"))
    stream = spark.readStream.schema(lines.schema).parquet(str(src / "*"))

    def report(df):
        return df.groupBy("encounter_id").agg(F.sum("units").alias("uos"))

    q = refresh_report_per_batch(stream, str(tmp_path / "lines"), str(tmp_path / "out"), report,
                                 name=f"t{tmp_path.name}")
    q.awaitTermination(120)
    got = {r.encounter_id: r.uos for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    exp = {r.encounter_id: r.uos for r in report(lines).collect()}
    assert got == exp


def test_catalog_tables(spark):
    import uuid
    from wardlens.sources.tables import CatalogTables
    name = f"dim_{uuid.uuid4().hex[:10]}"  # managed folders outlive the in-memory catalog
    spark.sql("create database if not exists wl_client_db")
    spark.range(3).write.saveAsTable(f"wl_client_db.{name}")
    assert CatalogTables(spark, "wl_client_db").table(name).count() == 3
