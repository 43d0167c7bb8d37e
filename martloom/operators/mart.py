"""Star schema: dimensions with stable keys, and facts from typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions.cols import DEFAULT_CURRENCY, NO_FAMILY, blank_to_null
from martloom.sources.sinks import stored


def upsert_dim(old: DataFrame, source: DataFrame, key: str, natural: list[str] | None = None) -> DataFrame:
    """A dimension with its source's rows: known ones keep their key, new ones follow the highest; rows gone from the source stay.

    New rows are numbered in ranges of the natural key: a range starts after the rows of
    those before it, so that no task sorts a whole first load.
    """
    natural = natural or ["tenant_id", "external_id"]
    known = source.join(old.select(*natural, key), natural, "left")
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    new = stored(known.filter(F.col(key).isNull()).drop(key).repartitionByRange(*natural).withColumn("_range", F.spark_partition_id()))
    ranges = new.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.select("_r", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first")).crossJoin(top)
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*natural))
    new = new.withColumn("_nth", nth).join(starts, F.col("_range") == F.col("_r"))
    new = new.withColumn(key, (F.col("_top") + F.col("_first") + F.col("_nth")).cast("long"))
    kept = known.filter(F.col(key).isNotNull())
    gone = old.join(source.select(*natural), natural, "left_anti")
    columns = old.columns
    return kept.select(*columns).unionByName(new.select(*columns)).unionByName(gone.select(*columns))


def hashed_key(*natural: str):
    """A key without state."""
    return F.xxhash64(*natural)


def dim_tenant(tenants: DataFrame) -> DataFrame:
    """Tenants with slug and name."""
    return tenants.select("tenant_id", "slug", "name")


def dim_product(items: DataFrame) -> DataFrame:
    """Items as product rows: a blank family is SIN FAMILIA, a blank supplier none."""
    return items.withColumn("family_name", F.coalesce(blank_to_null(F.col("family_name")), F.lit(NO_FAMILY))).withColumn("preferred_supplier_name", blank_to_null(F.col("preferred_supplier_name")))


def dim_date(*dates: DataFrame) -> DataFrame:
    """Different dates of all columns named date, with calendar parts. ISO weeks; weekdays 1 (Monday) to 7."""
    days = reduce(DataFrame.union, [d.select("date").distinct() for d in dates]).filter("date is not null").distinct()
    weekday = (F.weekday("date") + 1).cast("int")
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"),
        F.weekofyear("date").alias("iso_week"), weekday.alias("iso_weekday"), (weekday >= 6).alias("is_weekend"))


def keyed(rows: DataFrame, dim: DataFrame, source: str, key: str, out: str) -> DataFrame:
    found = dim.select(F.col("tenant_id").alias("_t"), F.col("external_id").alias("_e"), F.col(key).alias(out))
    return rows.join(found, (F.col("tenant_id") == F.col("_t")) & (F.col(source) == F.col("_e")), "left").drop("_t", "_e")


def fact_sales(invoices: DataFrame, invoice_lines: DataFrame, notes: DataFrame, note_lines: DataFrame, products: DataFrame, contacts: DataFrame, sellers: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Invoice lines, and credit-note lines with quantity and amount below 0. Deleted documents stay, marked; unknown references have a null key.

    Documents get the keys of their client, seller and warehouse before their lines join them, since lines are more.
    """
    key = ["tenant_id", "document_id"]
    nothing = F.lit(None).cast("long")

    def headed(heads: DataFrame, lines: DataFrame, kind: str, dim: DataFrame, source: str, out: str, other: str, sign: int) -> DataFrame:
        heads = keyed(keyed(heads, contacts, "client_id", "contact_key", "contact_key"), dim, source, out, out)
        heads = heads.select(*key, "date", F.col("status").alias("document_status"), F.coalesce("currency_code", F.lit(DEFAULT_CURRENCY)).alias("currency_code"), F.col("is_deleted").alias("_d"), "contact_key", out)
        quantity, total = (F.col("quantity"), F.col("total")) if sign > 0 else ((-F.col("quantity")).cast("decimal(18,4)"), (-F.col("total")).cast("decimal(18,2)"))
        return lines.join(heads, key).select(*key, F.lit(kind).alias("document_type"), "line_number", "date", "document_status", "currency_code", quantity.alias("quantity"), total.alias("net_sales"), F.col("_d").alias("is_deleted"), "item_id", "contact_key", out, nothing.alias(other))

    one = headed(invoices, invoice_lines, "invoice", sellers, "seller_id", "seller_key", "warehouse_key", 1)
    two = headed(notes, note_lines, "credit_note", warehouses, "warehouse_id", "warehouse_key", "seller_key", -1)
    rows = keyed(one.unionByName(two), products, "item_id", "product_key", "product_key")
    return rows.select(*key, "document_type", "line_number", "date", "document_status", "currency_code", "quantity", "net_sales", "is_deleted", "product_key", "contact_key", "seller_key", "warehouse_key")


def fact_purchases(bills: DataFrame, lines: DataFrame, products: DataFrame, contacts: DataFrame) -> DataFrame:
    """Bill lines with their provider, whose key bills get before their lines join them; purchases have no warehouse."""
    key = ["tenant_id", "document_id"]
    heads = keyed(bills, contacts, "provider_id", "contact_key", "provider_key").withColumnRenamed("is_deleted", "_d")
    rows = lines.join(heads, key).select(*key, "line_number", "date", F.col("status").alias("document_status"), "item_id", F.coalesce("currency_code", F.lit(DEFAULT_CURRENCY)).alias("currency_code"), F.coalesce("quantity", F.lit(0)).cast("decimal(18,4)").alias("quantity"), F.col("price").alias("unit_cost"), F.coalesce("total", F.lit(0)).cast("decimal(18,2)").alias("amount"), F.col("_d").alias("is_deleted"), "provider_key")
    rows = keyed(rows, products, "item_id", "product_key", "product_key").drop("item_id")
    return rows.select(*[c for c in rows.columns if c != "provider_key"], "provider_key").withColumn("warehouse_key", F.lit(None).cast("long"))


def fact_payments(payments: DataFrame, contacts: DataFrame) -> DataFrame:
    rows = payments.withColumn("amount", F.coalesce("amount", F.lit(0)).cast("decimal(18,2)")).withColumn("currency_code", F.coalesce("currency_code", F.lit(DEFAULT_CURRENCY)))
    return keyed(rows, contacts, "contact_id", "contact_key", "contact_key").drop("contact_id")


def fact_snapshots(rows: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Snapshot rows with their value, null without a cost."""
    rows = keyed(rows, products, "item_id", "product_key", "product_key")
    rows = keyed(rows, warehouses, "warehouse_id", "warehouse_key", "warehouse_key").drop("item_id", "warehouse_id")
    return rows.withColumn("value", F.round(F.col("quantity") * F.col("unit_cost"), 2).cast("decimal(18,2)"))
