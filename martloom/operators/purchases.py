"""Purchase, supplier and payment reports, and the supplier tables derived from purchases.

fact_purchases: tenant_id, document_id, line_number, date, document_status, product_key,
provider_key, warehouse_key, currency_code, quantity, unit_cost, amount, is_deleted.
fact_payments: tenant_id, payment_id, date, contact_key, payment_type, currency_code, amount, is_deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions.cols import DEFAULT_CURRENCY, NO_FAMILY, label, safe_ratio, total
from martloom.operators.sales import first, named, with_share
from martloom.plans.filters import PAYMENTS, PURCHASES, ReportFilter, filter_fact



def _rows(marts, f: ReportFilter) -> DataFrame:
    return filter_fact(marts.fact_purchases, f, marts.dim_product, PURCHASES)


def _in_currency(rows: DataFrame) -> DataFrame:
    return rows.withColumn("currency_code", label(F.col("currency_code"), DEFAULT_CURRENCY))


def _amount() -> Column:
    return total(F.col("amount"))


def _by(rows: DataFrame, *keys: str) -> DataFrame:
    """Lines summed by keys, before anything is joined to them; sums stay exact."""
    return rows.groupBy(*keys).agg(F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def purchases_summary(marts, f: ReportFilter) -> DataFrame:
    return _rows(marts, f).groupBy("currency_code").agg(_amount().alias("purchase_amount"), total(F.col("quantity")).alias("quantity"), F.count_distinct("document_id").alias("documents"))


def purchases_series(marts, f: ReportFilter) -> DataFrame:
    return _rows(marts, f).groupBy(F.trunc("date", "MM").alias("period"), "currency_code").agg(_amount().alias("amount"))


def purchases_by_supplier(marts, f: ReportFilter, top: int | None = 15) -> DataFrame:
    rows = named(_by(_rows(marts, f), "provider_key", "currency_code"), marts.dim_contact, "provider_key", "name", "Sin proveedor", "contact_key")
    return first(rows.groupBy("label", "currency_code").agg(_amount().alias("amount")), top, F.desc("amount"), "label", "currency_code")


def purchases_by_product(marts, f: ReportFilter, top: int | None = 15) -> DataFrame:
    rows = named(_by(_rows(marts, f), "product_key", "currency_code"), marts.dim_product, "product_key", "name", "Sin producto")
    return first(rows.groupBy("label", "currency_code").agg(_amount().alias("amount")), top, F.desc("amount"), "label", "currency_code")


def _averages(g: DataFrame) -> DataFrame:
    return g.withColumn("average_purchase_ticket", safe_ratio(F.col("purchase_amount"), F.col("documents"))).withColumn("average_unit_cost", safe_ratio(F.col("purchase_amount"), F.col("units")))


def suppliers_summary(marts, f: ReportFilter) -> DataFrame:
    g = _in_currency(_rows(marts, f)).groupBy("currency_code").agg(_amount().alias("purchase_amount"), total(F.col("quantity")).alias("units"), F.count_distinct("document_id").alias("documents"), F.count_distinct("provider_key").alias("suppliers"))
    return _averages(g)


def suppliers_series(marts, f: ReportFilter) -> DataFrame:
    return _in_currency(_rows(marts, f)).groupBy(F.trunc("date", "MM").alias("period"), "currency_code").agg(_amount().alias("amount"), total(F.col("quantity")).alias("units"))


def suppliers_ranking(marts, f: ReportFilter, top: int | None = 100) -> DataFrame:
    """Suppliers by key with their share of all purchases in the currency."""
    g = _in_currency(_rows(marts, f)).groupBy("provider_key", "currency_code").agg(
        _amount().alias("purchase_amount"), total(F.col("quantity")).alias("units"), F.count_distinct("document_id").alias("documents"), F.count_distinct("product_key").alias("skus"), F.min("date").alias("first_purchase_date"), F.max("date").alias("last_purchase_date"))
    g = named(g, marts.dim_contact, "provider_key", "name", "Sin proveedor", "contact_key").withColumnsRenamed({"provider_key": "supplier_key", "label": "supplier"})
    return first(with_share(_averages(g), "purchase_amount"), top, F.desc("purchase_amount"), "supplier_key", "currency_code")


def _with_names(marts, rows: DataFrame) -> DataFrame:
    """Summed rows with the names of their product and supplier."""
    products = marts.dim_product.select(F.col("product_key").alias("_pk"), F.col("name").alias("_product"), F.col("family_name").alias("_family"))
    rows = rows.join(products, F.col("product_key") == F.col("_pk"), "left")
    rows = named(rows, marts.dim_contact, "provider_key", "name", "Sin proveedor", "contact_key").withColumnRenamed("label", "supplier")
    return rows.withColumn("product", label(F.col("_product"), "Sin producto")).withColumn("family", label(F.col("_family"), NO_FAMILY))


PAIR = ("product_key", "provider_key", "currency_code")


def purchases_by_family(marts, f: ReportFilter, top: int | None = 100) -> DataFrame:
    rows = _with_names(marts, _by(_in_currency(_rows(marts, f)), *PAIR))
    g = rows.groupBy("family", "currency_code").agg(_amount().alias("purchase_amount"), total(F.col("quantity")).alias("units"), F.count_distinct("provider_key").alias("suppliers"), F.count_distinct("product_key").alias("skus"))
    return first(g, top, F.desc("purchase_amount"), "family", "currency_code")


def product_supplier_matrix(marts, f: ReportFilter, top: int | None = 200) -> DataFrame:
    rows = _with_names(marts, _by(_in_currency(_rows(marts, f)), *PAIR, "document_id"))
    g = rows.groupBy("product", "family", "supplier", "currency_code").agg(_amount().alias("purchase_amount"), total(F.col("quantity")).alias("units"), F.count_distinct("document_id").alias("documents"), F.max("last_date").alias("last_purchase_date"))
    g = g.withColumn("average_unit_cost", safe_ratio(F.col("purchase_amount"), F.col("units")))
    return first(g, top, F.desc("purchase_amount"), "product", "family", "supplier", "currency_code")


def price_variations(marts, f: ReportFilter, top: int | None = 100) -> DataFrame:
    """Products bought twice or more from a supplier, by the range of their positive costs over their average."""
    rows = _in_currency(_rows(marts, f)).filter("unit_cost > 0").groupBy(*PAIR).agg(F.min("unit_cost").alias("least"), F.max("unit_cost").alias("most"), F.sum("unit_cost").alias("sum"), F.count("*").alias("n"))
    g = _with_names(marts, rows).groupBy("product", "family", "supplier", "currency_code").agg(
        F.min("least").cast("double").alias("minimum_cost"), F.max("most").cast("double").alias("maximum_cost"), (F.sum("sum").cast("double") / F.sum("n")).alias("average_unit_cost"), F.sum("n").alias("purchase_lines")).filter("purchase_lines >= 2")
    g = g.withColumn("cost_range_pct", F.round(safe_ratio(F.col("maximum_cost") - F.col("minimum_cost"), F.col("average_unit_cost"), 100), 6))
    return first(g, top, F.desc("cost_range_pct"), "product", "family", "supplier", "currency_code")


def purchase_kpis(marts, f: ReportFilter, top: int = 5) -> DataFrame:
    """Totals and averages of each currency, and the top suppliers' share."""
    rows = _rows(marts, f)
    g = rows.groupBy("currency_code").agg(_amount().alias("purchase_amount"), total(F.col("quantity")).alias("units"), F.count_distinct("document_id").alias("documents"), F.count_distinct("provider_key").alias("suppliers"))
    spend = rows.filter("provider_key is not null").groupBy("currency_code", "provider_key").agg(F.sum("amount").alias("spent"))
    nth = F.row_number().over(Window.partitionBy("currency_code").orderBy(F.desc("spent"), "provider_key"))
    best = spend.withColumn("nth", nth).filter(F.col("nth") <= top).groupBy(F.col("currency_code").alias("_c")).agg(F.sum("spent").alias("_top"))
    return _averages(g).join(best, F.col("currency_code") == F.col("_c"), "left").withColumn("top_supplier_concentration", safe_ratio(F.col("_top"), F.col("purchase_amount"), 100)).drop("_c", "_top")


def payments(marts, f: ReportFilter, kind: str, top: int | None = 15) -> DataFrame:
    """Payments: summary, series (months), by_type or by_contact (top). Only period, tenant and currency filter them."""
    rows = filter_fact(marts.fact_payments, f, allow=PAYMENTS)
    if kind == "summary":
        return rows.groupBy("currency_code").agg(_amount().alias("amount"), F.count("*").alias("payments"))
    if kind == "series":
        return rows.groupBy(F.trunc("date", "MM").alias("period"), "currency_code").agg(_amount().alias("amount"))
    if kind == "by_type":
        return rows.groupBy(label(F.col("payment_type"), "Sin tipo").alias("label"), "currency_code").agg(_amount().alias("amount"))
    rows = named(rows.groupBy("contact_key", "currency_code").agg(F.sum("amount").alias("amount")), marts.dim_contact, "contact_key", "name", "Sin contacto")
    return first(rows.groupBy("label", "currency_code").agg(_amount().alias("amount")), top, F.desc("amount"), "label", "currency_code")


def product_supplier_mode(purchases: DataFrame) -> DataFrame:
    """Each product's supplier with most purchase lines; ties by units, amount, latest date and key. With line counts and confidence."""
    g = purchases.filter("not is_deleted and product_key is not null and provider_key is not null").groupBy("tenant_id", "product_key", F.col("provider_key").alias("supplier_key")).agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("units"), F.sum(F.coalesce("amount", F.lit(0))).alias("amount"), F.max("date").alias("last_purchase_date"))
    w = Window.partitionBy("tenant_id", "product_key")
    order = w.orderBy(F.desc("line_count"), F.desc("units"), F.desc("amount"), F.desc_nulls_last("last_purchase_date"), "supplier_key")
    ranked = g.withColumn("nth", F.row_number().over(order)).withColumn("total_lines", F.sum("line_count").over(w)).withColumn("supplier_count", F.count("*").over(w)).filter("nth = 1")
    return ranked.select("tenant_id", "product_key", "supplier_key", "line_count", "total_lines", "supplier_count", F.round(safe_ratio(F.col("line_count"), F.col("total_lines")), 6).alias("confidence"), "last_purchase_date")


def supplier_product_stats(purchases: DataFrame, approximate_median: bool = False) -> DataFrame:
    """Each product, supplier and currency of lines with a quantity above 0: counts, costs (average, median, least, most, last), shares and two ranks."""
    rows = purchases.filter("not is_deleted and product_key is not null and provider_key is not null and quantity > 0")
    rows = rows.withColumn("currency_code", label(F.col("currency_code"), DEFAULT_CURRENCY)).withColumn("_cost", F.when(F.col("unit_cost") > 0, F.col("unit_cost").cast("double")))
    median = F.percentile_approx("_cost", 0.5) if approximate_median else F.percentile("_cost", 0.5)
    latest = F.max_by("unit_cost", F.when(F.col("unit_cost").isNotNull(), F.struct("date", "document_id", "line_number")))
    g = rows.groupBy("tenant_id", "product_key", F.col("provider_key").alias("supplier_key"), "currency_code").agg(
        F.count("*").alias("line_count"), total(F.col("quantity")).alias("units"), _amount().alias("amount"), median.alias("median_cost"), F.min("_cost").alias("min_cost"), F.max("_cost").alias("max_cost"),
        latest.cast("double").alias("last_cost"), F.max("date").alias("last_purchase_date"))
    g = g.withColumn("average_cost", safe_ratio(F.col("amount"), F.col("units")))
    w = Window.partitionBy("tenant_id", "product_key", "currency_code")
    return (
        g.withColumn("line_share_pct", F.round(safe_ratio(F.col("line_count"), F.sum("line_count").over(w), 100), 6))
        .withColumn("unit_share_pct", F.round(safe_ratio(F.col("units"), F.sum("units").over(w), 100), 6))
        .withColumn("frequency_rank", F.row_number().over(w.orderBy(F.desc("line_count"), F.desc("units"), F.desc("amount"), F.desc_nulls_last("last_purchase_date"), "supplier_key")))
        .withColumn("cost_rank", F.row_number().over(w.orderBy("average_cost", F.desc("units"), F.desc_nulls_last("last_purchase_date"), "supplier_key")))
    )
