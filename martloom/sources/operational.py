"""Typed operational tables: from a database over JDBC, in ranges of a column, or from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables that a refresh reads, with a number or date column of each that spreads its rows.
TABLES = {
    "tenants": None, "items": "id", "contacts": "id", "sellers": None, "warehouses": None, "invoices": "id", "invoice_lines": "id", "credit_notes": "id", "credit_note_lines": "id",
    "bills": "id", "bill_lines": "id", "payments": "id", "snapshot_rows": "id", "adjustment_lines": "id", "transfer_lines": "id", "opening_report": None,
}


def read_table(spark: SparkSession, url: str, name: str, column: str | None, partitions: int, where: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A table in partitions by ranges of a number, date or timestamp column; the least and the largest value are asked for first.

    where is SQL of the database that every partition applies. Rows without a value are in
    the first range. An empty table, and one without a column to go by, is one partition.
    """
    some = f"{name} WHERE {where}" if where else name
    given = {"url": url, **(properties or {})}
    load = lambda query, **more: spark.read.format("jdbc").options(**given, dbtable=query, **more).load()
    if column is None:
        return load(f"(SELECT * FROM {some}) t")
    low, high = load(f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {some}) b").first()
    if low is None:
        return load(f"(SELECT * FROM {some}) t")
    # Ranges are half open and the last has no end, so that the largest value is in it.
    return load(f"(SELECT * FROM {some}) t", partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=partitions)


def read_database(spark: SparkSession, url: str, partitions: int, tables: dict[str, str | None] | None = None, tenant_id: str | None = None, properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All tables of a database, of one tenant or of all. The database's role needs to read only."""
    where = None if tenant_id is None else "tenant_id = '{}'".format(tenant_id.replace("'", "''"))
    return {name: read_table(spark, url, name, column, partitions, where, properties) for name, column in (tables or TABLES).items()}


def read_folder(spark: SparkSession, path: str, tables: dict[str, str | None] | None = None) -> dict[str, DataFrame]:
    """All tables from Parquet, one folder each."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables or TABLES}
