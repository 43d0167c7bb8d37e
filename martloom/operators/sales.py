"""Sales reports over fact_sales.

fact_sales: tenant_id, document_type (invoice or credit_note), document_id, line_number,
date, document_status, product_key, contact_key, seller_key, warehouse_key, currency_code,
quantity, net_sales, is_deleted, cost_status, cogs, margin. Credit notes are negative.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions.cols import DEFAULT_CURRENCY, NO_FAMILY, NO_SUPPLIER, is_costed, label, ratio, safe_ratio, total
from martloom.plans.filters import ReportFilter, filter_fact

DOCUMENT = ("document_type", "document_id")
MONTHLY_FROM_DAYS = 92


def documents() -> Column:
    return F.count_distinct(F.struct(*DOCUMENT))


def _of(kind: str) -> Column:
    return F.col("document_type") == kind


def measures() -> dict[str, Column]:
    """Aggregates that most sales reports share; raw sums end in _raw."""
    costed = is_costed()
    return {
        "net_sales": total(F.col("net_sales")),
        "units": total(F.col("quantity")),
        "documents": documents(),
        "cogs": total(F.col("cogs"), costed),
        "gross_margin": total(F.col("margin"), costed),
        "costed_sales": total(F.col("net_sales"), costed),
        "total_lines": F.count("*"),
        "costed_lines": F.count(F.when(costed, 1)),
        "partial_lines": F.count(F.when(F.col("cost_status") == "partial", 1)),
        "unavailable_lines": F.count(F.when(F.col("cost_status") == "unavailable", 1)),
        "invoice_sales": total(F.col("net_sales"), _of("invoice")),
        "credit_note_amount": F.abs(total(F.col("net_sales"), _of("credit_note"))),
        "product_count": F.count_distinct("product_key"),
        "last_sale_date": F.max("date"),
    }


def pick(*names: str) -> list[Column]:
    every = measures()
    return [every[n].alias(n) for n in names]


def margin_pct() -> Column:
    return safe_ratio(F.col("gross_margin"), F.col("costed_sales"), 100).alias("gross_margin_pct")


def coverage_pct() -> Column:
    return safe_ratio(F.col("costed_lines"), F.col("total_lines"), 100).alias("cost_coverage_pct")


def sales_metrics(fact: DataFrame, f: ReportFilter, products: DataFrame | None = None) -> DataFrame:
    """Sales, units, documents, ticket, cost, margin and cost coverage of each currency."""
    g = filter_fact(fact, f, products).groupBy("currency_code").agg(*pick("net_sales", "units", "documents", "cogs", "gross_margin", "costed_sales", "total_lines", "costed_lines", "partial_lines", "unavailable_lines"))
    return g.select("currency_code", "net_sales", "units", "documents", safe_ratio(F.col("net_sales"), F.col("documents")).alias("average_ticket"), "cogs", "gross_margin", margin_pct(), "costed_lines", "partial_lines", "unavailable_lines", coverage_pct())


def sales_overview(fact: DataFrame, f: ReportFilter) -> DataFrame:
    """sales_metrics of the period beside net sales, units and documents of the period before, with the change in percent (null from 0)."""
    now = sales_metrics(fact, f)
    before = sales_metrics(fact, f.previous()).select(F.col("currency_code").alias("_c"), *[F.col(c).alias(f"previous_{c}") for c in ("net_sales", "units", "documents")])
    both = now.join(before, F.col("currency_code").eqNullSafe(F.col("_c")), "full")
    change = [ratio(F.col(c) - F.col(f"previous_{c}"), F.abs(F.col(f"previous_{c}")), 100).alias(f"{c}_change_pct") for c in ("net_sales", "units", "documents")]
    return both.select(F.coalesce("currency_code", "_c").alias("currency_code"), "net_sales", "units", "documents", "previous_net_sales", "previous_units", "previous_documents", *change)


def sales_series(fact: DataFrame, f: ReportFilter) -> DataFrame:
    """Amount, cost and margin by day, or by month when the period is longer than 92 days."""
    monthly = (f.to_date - f.from_date).days > MONTHLY_FROM_DAYS
    period = F.trunc("date", "MM") if monthly else F.col("date")
    g = filter_fact(fact, f).groupBy(period.alias("period"), "currency_code")
    return g.agg(total(F.col("net_sales")).alias("amount"), *pick("cogs", "gross_margin"))


def named(fact: DataFrame, dim: DataFrame | None, key: str, column: str, default: str, dim_key: str | None = None) -> DataFrame:
    """fact with label: a column of the dimension that key points to, or of the fact itself. Labels that are alike merge."""
    if dim is None:
        return fact.withColumn("label", label(F.col(column), default))
    names = dim.select(F.col(dim_key or key).alias("_k"), F.col(column).alias("_name"))
    return fact.join(names, F.col(key) == F.col("_k"), "left").withColumn("label", label(F.col("_name"), default)).drop("_k", "_name")


def _part(column: Column, when: Column | None = None) -> Column:
    return F.sum(column if when is None else F.when(when, column))


def parts() -> dict[str, Column]:
    """The sums of measures() as they add up from parts of a group: exact numbers, and no counts of different values."""
    costed, one = is_costed(), F.lit(1)
    return {
        "net_sales": _part(F.col("net_sales")), "units": _part(F.col("quantity")), "cogs": _part(F.col("cogs"), costed), "gross_margin": _part(F.col("margin"), costed),
        "costed_sales": _part(F.col("net_sales"), costed), "total_lines": F.count("*"), "costed_lines": _part(one, costed),
        "unavailable_lines": _part(one, F.col("cost_status") == "unavailable"), "invoice_sales": _part(F.col("net_sales"), _of("invoice")),
        "credit_note_amount": _part(F.col("net_sales"), _of("credit_note")), "last_sale_date": F.max("date"),
    }


def by_parts(rows: DataFrame, *keys: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Rows summed by keys, before anything is joined to them."""
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in parts().items() if only is None or n in only])


def of_parts(*names: str) -> list[Column]:
    """Measures of groups of by_parts rows."""
    counts = {n: F.coalesce(F.sum(n), F.lit(0)) for n in ("total_lines", "costed_lines", "unavailable_lines")}
    other = {"documents": documents(), "product_count": F.count_distinct("product_key"), "last_sale_date": F.max("last_sale_date"), "credit_note_amount": F.abs(total(F.col("credit_note_amount")))}
    known = counts | other
    return [(known[n] if n in known else total(F.col(n))).alias(n) for n in names]


BREAKDOWNS = {"product": ("dim_product", "product_key", "name"), "seller": ("dim_seller", "seller_key", "name"), "warehouse": ("dim_warehouse", "warehouse_key", "name"), "customer": ("dim_contact", "contact_key", "name"), "status": (None, None, "document_status")}


ADDED = ("net_sales", "units", "cogs", "gross_margin")


def _broken_down(named_parts: DataFrame, *keys: str) -> DataFrame:
    return named_parts.groupBy(*keys, "label", "currency_code").agg(total(F.col("net_sales")).alias("amount"), total(F.col("units")).alias("quantity"), *of_parts("cogs", "gross_margin"))


def sales_breakdown(marts, f: ReportFilter, kind: str, top: int | None = 15) -> DataFrame:
    """Amount, quantity, cost and margin of the largest groups of a kind. Lines are summed by key before keys get their names."""
    dim, key, column = BREAKDOWNS[kind]
    rows = by_parts(filter_fact(marts.fact_sales, f), key or column, "currency_code", only=ADDED)
    g = _broken_down(named(rows, getattr(marts, dim) if dim else None, key, column, "Sin dato"))
    return first(g, top, F.desc("amount"), "label", "currency_code")


def sales_breakdowns(marts, f: ReportFilter, top: int = 15) -> DataFrame:
    """sales_breakdown of every kind, told by kind, from one pass over the fact."""
    keys = {kind: key or column for kind, (_, key, column) in BREAKDOWNS.items()}
    ids = [F.col(k).cast("string").alias(k) for k in keys.values()]
    rows = filter_fact(marts.fact_sales, f).select(*ids, *[c for c in marts.fact_sales.columns if c not in keys.values()])
    is_of = F.coalesce(*[F.when(F.grouping(k) == 0, kind) for kind, k in keys.items()])
    sums = [c.alias(n) for n, c in parts().items() if n in ADDED]
    g = rows.groupingSets([[F.col(k), F.col("currency_code")] for k in keys.values()], *keys.values(), "currency_code").agg(is_of.alias("kind"), *sums)
    g = g.withColumn("_key", F.coalesce(*[F.when(F.col("kind") == kind, F.col(k)) for kind, k in keys.items()]))
    names = reduce(DataFrame.unionByName, [getattr(marts, d).select(F.lit(kind).alias("_kind"), F.col(key).cast("string").alias("_k"), F.col(column).alias("_name")) for kind, (d, key, column) in BREAKDOWNS.items() if d])
    g = g.join(names, (F.col("kind") == F.col("_kind")) & (F.col("_key") == F.col("_k")), "left")
    own = F.coalesce(*[F.when(F.col("kind") == kind, F.col("_key")) for kind, (d, _, _) in BREAKDOWNS.items() if d is None])
    g = _broken_down(g.withColumn("label", label(F.coalesce("_name", own), "Sin dato")), "kind")
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("amount"), "label", "currency_code"))
    return g.withColumn("nth", nth).filter(F.col("nth") <= top)


def first(df: DataFrame, top: int | None, *order) -> DataFrame:
    """The first rows in an order that has no ties; all rows with None."""
    return df if top is None else df.orderBy(*order).limit(top)


def with_share(g: DataFrame, amount: str = "net_sales") -> DataFrame:
    """Share of a currency's total, over all groups."""
    totals = g.groupBy(F.col("currency_code").alias("_c")).agg(F.sum(amount).alias("_all"))
    return g.join(totals, F.col("currency_code") == F.col("_c")).withColumn("share_pct", F.round(safe_ratio(F.col(amount), F.col("_all"), 100), 6)).drop("_c", "_all")


DETAILS = {
    "family": ("dim_product", "product_key", "family_name", NO_FAMILY),
    "catalog_supplier": ("dim_product", "product_key", "preferred_supplier_name", NO_SUPPLIER),
    "product": ("dim_product", "product_key", "name", "Sin producto"),
    "seller": ("dim_seller", "seller_key", "name", "Sin vendedor"),
    "customer": ("dim_contact", "contact_key", "name", "Sin cliente"),
    "status": (None, None, "document_status", "Sin estado"),
}
DETAIL_MEASURES = ("net_sales", "units", "documents", "invoice_sales", "credit_note_amount", "cogs", "gross_margin", "costed_sales", "total_lines", "costed_lines", "unavailable_lines", "product_count", "last_sale_date")


def detail(rows: DataFrame, top: int | None, *more: Column) -> DataFrame:
    """Measures of by_parts rows with a label."""
    g = rows.withColumn("currency_code", label(F.col("currency_code"), DEFAULT_CURRENCY)).groupBy("label", "currency_code").agg(*of_parts(*DETAIL_MEASURES), *more)
    g = g.withColumn("average_unit_sale", safe_ratio(F.col("net_sales"), F.col("units"))).withColumn("gross_margin_pct", margin_pct()).withColumn("cost_coverage_pct", coverage_pct())
    return first(with_share(g), top, F.desc("net_sales"), "label", "currency_code")


def sales_detail(marts, f: ReportFilter, kind: str, top: int | None = 200) -> DataFrame:
    """Fifteen measures and three percentages of each group of a kind. Shares are of all groups, also those below the top.

    Lines are summed by key, document and product, which tell the different ones apart, before keys get their names.
    """
    dim, key, column, default = DETAILS[kind]
    keys = dict.fromkeys([key or column, "currency_code", *DOCUMENT, "product_key"])
    return detail(named(by_parts(filter_fact(marts.fact_sales, f), *keys), getattr(marts, dim) if dim else None, key, column, default), top)


def sales_modal_supplier(marts, modes: DataFrame, f: ReportFilter, top: int | None = 100) -> DataFrame:
    """sales_detail by the supplier who most often delivered the product, with the confidence of that, weighted by absolute sales."""
    known = modes.select(F.col("product_key").alias("_pk"), F.col("supplier_key").alias("_sk"), F.col("confidence").alias("_conf"))
    keys = ["product_key", "currency_code", *DOCUMENT]
    rows = filter_fact(marts.fact_sales, f).groupBy(*keys).agg(*[c.alias(n) for n, c in parts().items()], F.sum(F.abs("net_sales")).alias("_size"))
    rows = named(rows.join(known, F.col("product_key") == F.col("_pk"), "left"), marts.dim_contact, "_sk", "name", "SIN HISTORIAL DE PROVEEDOR", "contact_key")
    size = F.col("_size").cast("double")
    confidence = F.round(safe_ratio(F.sum(size * F.coalesce("_conf", F.lit(0.0))), F.sum(size), 100), 6).alias("supplier_confidence_pct")
    return detail(rows, top, confidence)


def sales_cost_supplier(marts, allocations: DataFrame, f: ReportFilter, top: int | None = 100) -> DataFrame:
    """Costed sales by the supplier of the consumed cost layer.

    A line's net sales are split by the allocated quantities. Opening and return layers
    have no purchase and count for 'Sin proveedor/costo de apertura'.
    """
    line = ["document_type", "document_id", "line_number"]
    parts = allocations.filter("cost_amount is not null and allocation_type <> 'unavailable'")
    parts = parts.withColumn("_line", F.sum("quantity_allocated").over(Window.partitionBy(*line)))
    sales = filter_fact(marts.fact_sales, f).select(*line, "currency_code", "net_sales")
    suppliers = marts.fact_purchases.filter("not is_deleted").select(F.col("document_id").alias("_doc"), F.col("line_number").alias("_n"), "provider_key")
    rows = parts.join(sales, line).join(suppliers, (F.col("source_document_id") == F.col("_doc")) & (F.col("source_line_number") == F.col("_n")), "left")
    rows = named(rows, marts.dim_contact, "provider_key", "name", "Sin proveedor/costo de apertura", "contact_key")
    share = F.col("net_sales").cast("double") * F.col("quantity_allocated").cast("double") / F.col("_line").cast("double")
    g = rows.groupBy(F.col("label").alias("supplier"), label(F.col("currency_code"), DEFAULT_CURRENCY).alias("currency_code")).agg(
        F.round(F.sum(share), 4).alias("attributed_net_sales"), F.round(total(F.col("cost_amount")), 4).alias("cogs"), total(F.col("quantity_allocated")).alias("allocated_units"), documents().alias("documents"), F.count_distinct("product_key").alias("products"), F.count("*").alias("allocation_rows"))
    g = g.withColumn("gross_margin", F.round(F.col("attributed_net_sales") - F.col("cogs"), 4)).withColumn("gross_margin_pct", F.round(safe_ratio(F.col("gross_margin"), F.col("attributed_net_sales"), 100), 4))
    return first(with_share(g, "attributed_net_sales"), top, F.desc("attributed_net_sales"), "supplier", "currency_code")


def monthly_net_sales(fact: DataFrame, start: date, end: date) -> DataFrame:
    """Net sales by year and month, from start to before end."""
    rows = filter_fact(fact, ReportFilter(start, end - timedelta(days=1)))
    return rows.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(*pick("net_sales"))


def sales_kpis(fact: DataFrame, f: ReportFilter, monthly_target: float | None = None, target_currency: str = DEFAULT_CURRENCY) -> DataFrame:
    """sales_metrics with rates, daily averages and the pace against a monthly target of one currency."""
    g = filter_fact(fact, f).groupBy("currency_code").agg(*pick("net_sales", "units", "documents", "cogs", "gross_margin", "costed_sales", "total_lines", "costed_lines", "partial_lines", "unavailable_lines", "invoice_sales", "credit_note_amount"))
    target = F.when(F.col("currency_code") == target_currency, F.lit(monthly_target).cast("double"))
    days = F.dayofmonth(F.last_day(F.lit(f.to_date)))
    return g.select(
        "currency_code", "net_sales", "units", "documents",
        safe_ratio(F.col("units"), F.col("documents")).alias("units_per_transaction"),
        safe_ratio(F.col("net_sales"), F.col("documents")).alias("average_ticket"),
        safe_ratio(F.col("net_sales"), F.col("units")).alias("average_unit_sale"),
        "cogs", "gross_margin", margin_pct(), coverage_pct(), "partial_lines", "unavailable_lines", "invoice_sales", "credit_note_amount",
        safe_ratio(F.col("credit_note_amount"), F.col("invoice_sales"), 100).alias("credit_note_rate"),
        target.alias("monthly_sales_target"),
        (F.col("net_sales") / f.days).alias("average_daily_sales"),
        (target / days).alias("target_daily_sales"),
        ratio(F.col("net_sales") / f.days, target / days, 100).alias("sales_pace_vs_target_pct"),
    )


def customer_kpis(fact: DataFrame, f: ReportFilter, top: int = 5) -> DataFrame:
    """Active, repeating (two documents or more) and new customers, and the top customers' share of sales, of each currency.

    New: the first invoice in all of history, in this currency, lies in the period.
    """
    docs = filter_fact(fact, f).filter("contact_key is not null").groupBy("currency_code", "contact_key", *DOCUMENT).agg(F.sum("net_sales").alias("amount"))
    period = docs.groupBy("currency_code", "contact_key").agg(F.count("*").alias("documents"), F.sum("amount").alias("amount"))
    history = fact.filter("not is_deleted and document_type = 'invoice' and contact_key is not null and date is not null")
    if f.tenant_id is not None:
        history = history.filter(F.col("tenant_id") == f.tenant_id)
    firsts = history.groupBy(F.col("currency_code").alias("_c"), F.col("contact_key").alias("_k")).agg(F.min("date").alias("first_date"))
    rows = period.join(firsts, (F.col("currency_code") == F.col("_c")) & (F.col("contact_key") == F.col("_k")), "left")
    nth = F.row_number().over(Window.partitionBy("currency_code").orderBy(F.desc("amount"), "contact_key"))
    best = period.withColumn("nth", nth).filter(F.col("nth") <= top).groupBy(F.col("currency_code").alias("_b")).agg(F.sum("amount").alias("_top"))
    g = rows.groupBy("currency_code").agg(
        F.count("*").alias("active_customers"), F.count(F.when(F.col("documents") >= 2, 1)).alias("repeat_customers"),
        F.count(F.when(F.col("first_date").between(F.lit(f.from_date), F.lit(f.to_date)), 1)).alias("new_customers"), F.sum("amount").alias("_all"))
    return g.join(best, F.col("currency_code") == F.col("_b")).select(
        "currency_code", "active_customers", "repeat_customers", safe_ratio(F.col("repeat_customers"), F.col("active_customers"), 100).alias("repeat_customer_rate"), "new_customers",
        safe_ratio(F.col("_top"), F.col("_all"), 100).alias("top_customer_concentration"))


def customers_summary(fact: DataFrame, f: ReportFilter) -> DataFrame:
    return filter_fact(fact, f).groupBy("currency_code").agg(F.count_distinct("contact_key").alias("customers"), documents().alias("documents"), total(F.col("net_sales")).alias("amount"))


def customers_top(marts, f: ReportFilter, top: int | None = 20) -> DataFrame:
    """The customers who bought most; documents counts different document ids only."""
    rows = by_parts(filter_fact(marts.fact_sales, f), "contact_key", "currency_code", "document_id", only=("net_sales",))
    rows = named(rows, marts.dim_contact, "contact_key", "name", "Sin cliente")
    return first(rows.groupBy("label", "currency_code").agg(total(F.col("net_sales")).alias("amount"), F.count_distinct("document_id").alias("documents")), top, F.desc("amount"), "label", "currency_code")


def customers_recent(marts, f: ReportFilter, top: int | None = 20) -> DataFrame:
    rows = by_parts(filter_fact(marts.fact_sales, f), "contact_key", only=("net_sales", "last_sale_date"))
    rows = named(rows, marts.dim_contact, "contact_key", "name", "Sin cliente")
    return first(rows.groupBy("label").agg(F.max("last_sale_date").alias("last_purchase"), total(F.col("net_sales")).alias("amount")), top, F.desc("last_purchase"), F.desc("amount"), "label")


def products_summary(fact: DataFrame, f: ReportFilter) -> DataFrame:
    return filter_fact(fact, f).groupBy("currency_code").agg(F.count_distinct("product_key").alias("products"), total(F.col("quantity")).alias("units"), total(F.col("net_sales")).alias("amount"))


def products_by(marts, f: ReportFilter, column: str, default: str, top: int | None) -> DataFrame:
    rows = by_parts(filter_fact(marts.fact_sales, f), "product_key", "currency_code", only=("net_sales", "units"))
    rows = named(rows, marts.dim_product, "product_key", column, default)
    return first(rows.groupBy("label", "currency_code").agg(total(F.col("net_sales")).alias("amount"), total(F.col("units")).alias("quantity")), top, F.desc("amount"), "label", "currency_code")


def products_best_sellers(marts, f: ReportFilter, top: int | None = 25) -> DataFrame:
    return products_by(marts, f, "name", "Sin producto", top)


def products_by_type(marts, f: ReportFilter) -> DataFrame:
    return products_by(marts, f, "item_type", "Sin tipo", None)
