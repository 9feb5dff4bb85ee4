"""Tables of client databases that are found at run time.

A client's database is named after the client and looked up by org pin; its
tables are read by identifier through the session catalog, so no name is
pasted into SQL text.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators.drg import client_database_name


class UnknownClient(LookupError):
    """An org pin that has no client row, more than one, or no such table."""


class ClientDatabases:
    """``clients`` has one row per client: its org pin and the id its database is named after."""

    def __init__(self, spark: SparkSession, clients: DataFrame, orgpin_col: str = "orgpin", id_col: str = "DatabaseGUID",
                 separator: str = "-", catalog: str | None = None):
        self.spark, self.catalog = spark, catalog
        self.names = client_database_name(clients.select(F.col(orgpin_col).alias("orgpin"), F.col(id_col).alias("_id")), "_id", separator).select("orgpin", "db_name")

    def identifier(self, database: str, table: str = "") -> str:
        """The quoted name of a database or of one of its tables."""
        return ".".join("`" + part.replace("`", "``") + "`" for part in (self.catalog, database, table) if part)

    def databases(self, orgpins: Iterable[int]) -> dict[int, str]:
        """Database by org pin, of the clients asked for only."""
        asked = sorted(set(orgpins))
        found = self.names.where(F.col("orgpin").isin(asked)).distinct().limit(len(asked) + 1).collect()  # one row a client asked for
        by_pin = {r["orgpin"]: r["db_name"] for r in found if r["db_name"]}
        if sorted(by_pin) != asked or len(found) != len(asked):
            raise UnknownClient(f"not one database each for org pins {asked}: {[tuple(r) for r in found]}")
        return by_pin

    def table(self, orgpins: Iterable[int], name: str, columns: Iterable[str] | None = None) -> DataFrame:
        """The table ``name`` of several clients as one frame, with their ``orgpin``; one scan a client, in one plan."""
        parts = []
        for pin, database in self.databases(orgpins).items():
            identifier = self.identifier(database, name)
            if not self.spark.catalog.tableExists(identifier):
                raise UnknownClient(f"client {pin} has no table {identifier}")
            part = self.spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": identifier})
            part = part.select(*columns) if columns else part.drop("orgpin")
            parts.append(part.withColumn("orgpin", F.lit(pin).cast(self.names.schema["orgpin"].dataType)))
        return reduce(DataFrame.unionByName, parts)


def publish_clients(databases: ClientDatabases, rows: DataFrame, table: str, folder: str, orgpin_col: str = "orgpin") -> None:
    """Lay ``rows`` out by client below ``folder`` and name each client's folder as the table of its database."""
    spark = databases.spark
    rows.write.partitionBy(orgpin_col).parquet(f"{folder}/{table}")
    schema = rows.drop(orgpin_col).schema
    with_rows = {r[0] for r in spark.read.parquet(f"{folder}/{table}").select(orgpin_col).distinct().collect()}  # one row a client
    for r in databases.names.where("db_name IS NOT NULL").collect():  # one row a client
        if r["orgpin"] in with_rows:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS IDENTIFIER(:name) LOCATION '{folder}/databases'", args={"name": databases.identifier(r["db_name"])})
            identifier = databases.identifier(r["db_name"], table)
            spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": identifier})
            spark.catalog.createTable(identifier, path=f"{folder}/{table}/{orgpin_col}={r['orgpin']}", source="parquet", schema=schema)
