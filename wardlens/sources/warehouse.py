"""Warehouse layout for the production tables.

The analyses join the encounter, billing-line and line-cost facts on the
encounter and aggregate per encounter.  Writing all three facts bucketed
(and sorted) by ``encounter_id`` into the same number of buckets lets Spark
join and aggregate them without a shuffle; partitioning the line facts by
fiscal year lets year filters prune whole directories.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession

from wardlens.session import ensure_checkpoint_dir
from wardlens.sources.tables import CatalogTables

ENCOUNTER_KEY = "encounter_id"
#: Rows of a fact that a bucket holds, about: what one task reads while the facts are loaded.
BUCKET_ROWS = 1 << 20

# Settings a session reading bucketed facts should carry: joins on
# (encounter_id, line identity) may then reuse the encounter bucketing.
BUCKETED_READ_CONF = {
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def write_fact(df: DataFrame, table: str, buckets: int, key: str = ENCOUNTER_KEY,
               partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Save a fact as a catalog table bucketed and sorted by ``key``."""
    w = df.write.mode(mode).bucketBy(buckets, key).sortBy(key)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(table)


def bucket_count(rows: int, least: int = 1) -> int:
    """Buckets for facts of up to so many rows: their number grows with the rows, so a task's share does not."""
    return max(least, -(-rows // BUCKET_ROWS))


def configure_bucketed_reads(spark: SparkSession) -> None:
    for k, v in BUCKETED_READ_CONF.items():
        spark.conf.set(k, v)


def co_located(spark: SparkSession, encounter: DataFrame, line: DataFrame, cost: DataFrame, buckets: int,
               database: str | None = None) -> CatalogTables:
    """Load the three facts as catalog tables bucketed by encounter, lines and costs partitioned by fiscal year.

    The year is the encounter's; it is added to the lines and the costs here,
    at load, so that a report of one year reads that year's folders of all
    three, and joins and aggregates by encounter need no shuffle.  Lines of
    unknown encounters are left out, as no report joins them.  The tables lie
    in the shared checkpoint folder, in ``database`` (a new one by default).
    """
    database = database or f"facts_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{database}"
    spark.sql(f"CREATE DATABASE `{database}` LOCATION '{folder}'")
    year = encounter.select(ENCOUNTER_KEY, "fiscal_year")
    for name, fact in (("encounter", encounter), ("billing_line", line.join(year, ENCOUNTER_KEY)), ("line_cost", cost.join(year, ENCOUNTER_KEY))):
        # A task writes the buckets it holds; dealt by encounter, a bucket of a year is one file.
        write_fact(fact.repartition(buckets, ENCOUNTER_KEY), f"`{database}`.`{name}`", buckets, partition_by=("fiscal_year",))
    configure_bucketed_reads(spark)
    return CatalogTables(spark, database)


def drop_database(spark: SparkSession, tables: CatalogTables) -> None:
    """Remove the tables of :func:`co_located` with their files."""
    spark.sql(f"DROP DATABASE {tables.prefix} CASCADE")
