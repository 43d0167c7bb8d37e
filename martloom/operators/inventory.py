"""Inventory reports: movements, snapshots, coverage, alerts and replenishment opportunities.

fact_movements: tenant_id, document_type, document_id, line_number, direction, date, product_key, warehouse_key, quantity, is_deleted.
fact_snapshots: tenant_id, run_id, product_key, warehouse_key, quantity, unit_cost, value.
Every report on stock takes the newest succeeded run; without one it has no rows.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions.cols import NO_FAMILY, label, total
from martloom.operators.sales import first, named
from martloom.plans.filters import ReportFilter, filter_fact, latest_snapshot

MOVEMENTS = frozenset({"product", "warehouse", "family"})
DEMAND = frozenset({"currency", "product", "seller", "status", "family"})
LOW_DAYS, EXCESS_DAYS = 14, 120


def fact_movements(adjustments: DataFrame, transfers: DataFrame) -> DataFrame:
    """Adjustments with their sign, and each transfer line as one row out of its source and one into its destination, from one scan."""
    same = ["tenant_id", "document_id", "line_number", "date", "product_key", "is_deleted"]
    one = adjustments.select(*same, F.lit("adjustment").alias("document_type"), F.lit("adjustment").alias("direction"), "warehouse_key", "quantity")
    out = F.struct(F.lit("transfer_out").alias("direction"), F.col("source_key").alias("warehouse_key"), (-F.col("quantity")).alias("quantity"))
    into = F.struct(F.lit("transfer_in").alias("direction"), F.col("destination_key").alias("warehouse_key"), F.col("quantity").alias("quantity"))
    two = transfers.select(*same, F.lit("transfer").alias("document_type"), F.explode(F.array(out, into)).alias("x")).select(*same, "document_type", "x.direction", "x.warehouse_key", "x.quantity")
    return one.unionByName(two)


def movements_by(marts, f: ReportFilter, kind: str, top: int | None = 20) -> DataFrame:
    """Summed quantity by direction, product (top, by absolute sum) or warehouse. The currency filter doesn't apply."""
    rows = filter_fact(fact_movements(marts.adjustment_lines, marts.transfer_lines), f, marts.dim_product, MOVEMENTS)
    if kind == "direction":
        return rows.groupBy(F.col("direction").alias("label")).agg(total(F.col("quantity")).alias("quantity"))
    dim, key, default = (marts.dim_product, "product_key", "Sin producto") if kind == "product" else (marts.dim_warehouse, "warehouse_key", "Sin bodega")
    g = named(rows, dim, key, "name", default).groupBy("label").agg(total(F.col("quantity")).alias("quantity"))
    return first(g, top if kind == "product" else None, F.desc(F.abs("quantity")), "label")


def movements_recent(marts, f: ReportFilter, top: int | None = 100) -> DataFrame:
    rows = filter_fact(fact_movements(marts.adjustment_lines, marts.transfer_lines), f, marts.dim_product, MOVEMENTS)
    rows = named(rows, marts.dim_product, "product_key", "name", "Sin producto").withColumnRenamed("label", "product")
    rows = named(rows, marts.dim_warehouse, "warehouse_key", "name", "Sin bodega").withColumnRenamed("label", "warehouse")
    rows = rows.select("date", "document_type", "document_id", "line_number", "direction", "product", "warehouse", F.col("quantity").cast("double").alias("quantity"))
    return first(rows, top, F.desc("date"), F.desc("document_id"), F.desc("line_number"), "direction")


def _stock(marts) -> DataFrame:
    return latest_snapshot(marts.fact_snapshots, marts.snapshot_runs)


def snapshot_summary(marts) -> DataFrame:
    return _stock(marts).agg(F.count("*").alias("rows"), total(F.col("quantity")).alias("units"), total(F.col("value")).alias("value")).filter("rows > 0")


def snapshot_by(marts, kind: str, top: int | None = 50) -> DataFrame:
    dim, key, default = (marts.dim_product, "product_key", "Sin producto") if kind == "product" else (marts.dim_warehouse, "warehouse_key", "Sin bodega")
    g = named(_stock(marts), dim, key, "name", default).groupBy("label").agg(total(F.col("quantity")).alias("quantity"), total(F.col("value")).alias("value"))
    return first(g, top if kind == "product" else None, F.desc("value"), "label")


def snapshot_items(marts, top: int | None = 100) -> DataFrame:
    """The rows of least quantity."""
    rows = named(_stock(marts), marts.dim_product, "product_key", "name", "Sin producto").withColumnRenamed("label", "product")
    rows = named(rows, marts.dim_warehouse, "warehouse_key", "name", "Sin bodega").withColumnRenamed("label", "warehouse")
    rows = rows.select("product_key", "warehouse_key", "product", "warehouse", F.col("quantity").cast("double").alias("quantity"), F.col("unit_cost").cast("double").alias("unit_cost"), F.col("value").cast("double").alias("value"))
    return first(rows, top, "quantity", "product_key", "warehouse_key")


def _sold(fact: DataFrame, since: date) -> DataFrame:
    return fact.filter(~F.col("is_deleted") & (F.col("date") >= F.lit(since)) & F.col("product_key").isNotNull())


def stock_coverage(marts, as_of: date, days: int = 30, top: int | None = 30) -> DataFrame:
    """Days that stock lasts at the last days' sales, shortest first."""
    stock = _stock(marts).groupBy("product_key").agg(F.sum("quantity").alias("quantity")).filter("quantity > 0")
    sales = _sold(marts.fact_sales, as_of - timedelta(days=days)).groupBy(F.col("product_key").alias("_pk")).agg(F.sum("quantity").alias("_sold"))
    g = named(stock.join(sales, F.col("product_key") == F.col("_pk")), marts.dim_product, "product_key", "name", "Sin producto")
    cover = F.round(F.try_divide(F.col("quantity").cast("double") * days, F.col("_sold").cast("double")), 1)
    g = g.select("product_key", "label", F.col("quantity").cast("double").alias("quantity"), cover.alias("coverage_days"))
    return first(g, top, F.asc_nulls_last("coverage_days"), "product_key")


def coverage(marts, f: ReportFilter) -> DataFrame:
    """Stock, its value, the period's demand and days of coverage (null without demand) of each product in stock."""
    rows = _stock(marts).filter("product_key is not null")
    for column, value in (("product_key", f.product_key), ("warehouse_key", f.warehouse_key)):
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    stock = rows.groupBy("product_key").agg(F.sum("quantity").alias("_q"), F.sum("value").alias("_v"))
    demand = filter_fact(marts.fact_sales, f, marts.dim_product, DEMAND).filter("product_key is not null").groupBy(F.col("product_key").alias("_pk")).agg(F.sum("quantity").alias("_d"))
    quantity, sold = F.col("_q").cast("double"), F.coalesce("_d", F.lit(0)).cast("double")
    days = F.when(sold > 0, F.round(quantity * f.days / sold, 1))
    return stock.join(demand, F.col("product_key") == F.col("_pk"), "left").select("product_key", quantity.alias("quantity"), F.col("_v").cast("double").alias("value"), sold.alias("period_units"), days.alias("coverage_days"))


def inventory_kpis(marts, f: ReportFilter) -> DataFrame:
    c = coverage(marts, f)
    n = lambda test: F.count(F.when(test, 1))
    idle = (F.col("quantity") > 0) & (F.col("period_units") <= 0)
    days = F.col("coverage_days")
    return c.agg(
        F.count("*").alias("products"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("units"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("value"),
        n(F.col("quantity") <= 0).alias("unavailable_products"), n(F.col("quantity") < 0).alias("negative_products"), n((days > 0) & (days < LOW_DAYS)).alias("low_coverage_products"),
        n(days >= EXCESS_DAYS).alias("excess_coverage_products"), n(idle).alias("no_demand_products"), F.round(F.coalesce(F.sum(F.when(idle, F.col("value"))), F.lit(0.0)), 2).alias("no_demand_value"))


def coverage_list(marts, f: ReportFilter, kind: str, top: int | None = 30) -> DataFrame:
    """low (under 14 days), excess (120 days or more) or slow (stock without demand) products."""
    c = named(coverage(marts, f), marts.dim_product, "product_key", "name", "Sin producto")
    days, value = F.col("coverage_days"), F.desc_nulls_last("value")
    test, order = {
        "low": ((days > 0) & (days < LOW_DAYS), [F.asc("coverage_days"), F.desc("period_units")]),
        "excess": (days >= EXCESS_DAYS, [value]),
        "slow": ((F.col("quantity") > 0) & (F.col("period_units") <= 0), [value]),
    }[kind]
    return first(c.filter(test), top, *order, "product_key")


def alert_recent_stockout_count(marts, as_of: date, days: int = 90) -> DataFrame:
    """How many sales lines, not products, the last days have for products out of stock."""
    out = _stock(marts).groupBy(F.col("product_key").alias("_pk")).agg(F.sum("quantity").alias("_q")).filter("_q <= 0")
    return _sold(marts.fact_sales, as_of - timedelta(days=days)).join(out, F.col("product_key") == F.col("_pk"), "left_semi").agg(F.count("*").alias("count")).select(F.lit("Agotados con venta reciente").alias("label"), "count")


def alert_stock(marts, negative: bool, top: int | None = 50) -> DataFrame:
    """Product names whose stock is 0 or less, or below 0."""
    g = named(_stock(marts), marts.dim_product, "product_key", "name", "Sin producto").groupBy("label").agg(total(F.col("quantity")).alias("quantity"))
    return first(g.filter(F.col("quantity") < 0 if negative else F.col("quantity") <= 0), top, "quantity", "label")


def alert_slow_stock(marts, as_of: date, days: int = 90, top: int | None = 30) -> DataFrame:
    """Product names with stock whose products weren't sold in the last days."""
    sold = _sold(marts.fact_sales, as_of - timedelta(days=days)).select(F.col("product_key").alias("_pk")).distinct()
    rows = _stock(marts).join(sold, F.col("product_key") == F.col("_pk"), "left_anti")
    g = named(rows, marts.dim_product, "product_key", "name", "Sin producto").groupBy("label").agg(total(F.col("quantity")).alias("quantity"))
    return first(g.filter("quantity > 0"), top, F.desc("quantity"), "label")


def replenishment_opportunities(marts, f: ReportFilter, top: int | None = 200) -> DataFrame:
    """Stock that doesn't sell (slow) or lasts 120 days or more (excess). The demand window can be longer than the 90 days it is divided by; that is kept."""
    window = replace(f, from_date=min(f.from_date, f.to_date - timedelta(days=89)))
    stock = _stock(marts).filter("product_key is not null").groupBy("product_key").agg(F.sum("quantity").alias("_q"), F.sum("value").alias("_v")).filter("_q > 0")
    demand = filter_fact(marts.fact_sales, window, marts.dim_product, DEMAND).filter("product_key is not null").groupBy(F.col("product_key").alias("_dk")).agg(F.sum("quantity").alias("_d"))
    products = marts.dim_product.filter("not is_deleted").select(F.col("product_key").alias("_pk"), "name", "reference", label(F.col("family_name"), NO_FAMILY).alias("family"), F.col("current_cost").cast("double").alias("current_cost"))
    rows = stock.join(products, F.col("product_key") == F.col("_pk")).join(demand, F.col("product_key") == F.col("_dk"), "left")
    units = F.greatest(F.coalesce("_d", F.lit(0)), F.lit(0)).cast("double")
    quantity = F.col("_q").cast("double")
    rows = rows.select("product_key", "name", "reference", "family", quantity.alias("quantity"), units.alias("units_90d"), F.when(units > 0, F.round(quantity * 90 / units, 6)).alias("coverage_days"), F.col("_v").cast("double").alias("value"), "current_cost", F.when(units > 0, "excess").otherwise("slow").alias("category"))
    return first(rows.filter((F.col("units_90d") <= 0) | (F.col("coverage_days") >= EXCESS_DAYS)), top, F.desc("category"), F.desc_nulls_last("value"), "product_key")
