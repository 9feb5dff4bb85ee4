"""Readers for the parquet tables under one directory.

Reads are lazy; Catalyst prunes columns and pushes filters into the scan,
so an adapter that touches three columns of ``lineitem`` reads three.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class ParquetTables:
    """``tables.orders`` -> DataFrame over ``<root>/orders.parquet``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def fixtures(self):
        from wardlens.sources.fixtures import Fixtures
        return Fixtures(self)


class CatalogTables:
    """Warehouse tables from a catalog: ``catalog.schema.table`` names.

    The reference reads a client database chosen at run time (a database
    placeholder in three-part names); here the client database is an
    argument, and names are quoted identifiers, never pasted SQL text.
    """

    def __init__(self, spark: SparkSession, schema: str, catalog: str | None = None):
        self.spark = spark
        self.prefix = ".".join(f"`{p}`" for p in (catalog, schema) if p)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}.`{name}`" if self.prefix else f"`{name}`")


def client_database(spark: SparkSession, clients: DataFrame, orgpin: int, guid_col: str = "DatabaseGUID",
                    orgpin_col: str = "orgpin", separator: str = "-") -> DataFrame:
    """The client database name for one client (a one-row lookup; the
    caller passes the value on to :class:`CatalogTables`)."""
    from pyspark.sql import functions as F
    return (clients.where(F.col(orgpin_col) == orgpin)
            .select(F.concat(F.lit("P_"), F.replace(F.col(guid_col), F.lit(separator), F.lit(""))).alias("db_name")))
