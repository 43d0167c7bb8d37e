"""Report queries over the test tables, and their SQL."""

from __future__ import annotations

from datetime import date

from martloom.operators import inventory as inv
from martloom.operators import lookups as look
from martloom.operators import purchases as buy
from martloom.operators import sales
from martloom.plans.filters import ReportFilter
from martloom.plans.fixtures import Marts, with_fixtures

TENANT = "t1"
AS_OF = date(2001, 7, 31)
QUARTER = ReportFilter(date(2001, 5, 1), AS_OF, TENANT)
YEAR = ReportFilter(date(2000, 8, 1), AS_OF, TENANT)
#: The payments' and movements' table begins in 2024.
EVENT_MONTH = ReportFilter(date(2024, 1, 1), date(2024, 1, 31), TENANT)
FAMILY = ReportFilter(date(2000, 8, 1), AS_OF, TENANT, currency="COP", family="SIN FAMILIA")


def on(make):
    return lambda spark, sf_dir: make(Marts(spark, sf_dir))


def _modes(m: Marts):
    return buy.product_supplier_mode(m.fact_purchases)


QUERIES = {
    "sales_metrics": on(lambda m: sales.sales_metrics(m.fact_sales, QUARTER)),
    "fact_filter": on(lambda m: sales.sales_metrics(m.fact_sales, FAMILY, m.dim_product)),
    "sales_overview": on(lambda m: sales.sales_overview(m.fact_sales, QUARTER)),
    "sales_series": on(lambda m: sales.sales_series(m.fact_sales, QUARTER)),
    "sales_series_monthly": on(lambda m: sales.sales_series(m.fact_sales, YEAR)),
    **{f"sales_breakdown_{k}": on(lambda m, k=k: sales.sales_breakdown(m, YEAR, k)) for k in sales.BREAKDOWNS},
    "sales_breakdowns": on(lambda m: sales.sales_breakdowns(m, YEAR)),
    **{f"sales_detail_{k}": on(lambda m, k=k: sales.sales_detail(m, YEAR, k)) for k in sales.DETAILS},
    "sales_modal_supplier": on(lambda m: sales.sales_modal_supplier(m, _modes(m), YEAR)),
    "monthly_net_sales": on(lambda m: sales.monthly_net_sales(m.fact_sales, date(2000, 8, 1), date(2001, 8, 1))),
    "sales_kpis": on(lambda m: sales.sales_kpis(m.fact_sales, QUARTER, 50_000_000.0)),
    "customer_kpis": on(lambda m: sales.customer_kpis(m.fact_sales, QUARTER)),
    "customers_summary": on(lambda m: sales.customers_summary(m.fact_sales, YEAR)),
    "customers_top": on(lambda m: sales.customers_top(m, YEAR)),
    "customers_recent": on(lambda m: sales.customers_recent(m, YEAR)),
    "products_summary": on(lambda m: sales.products_summary(m.fact_sales, YEAR)),
    "products_best_sellers": on(lambda m: sales.products_best_sellers(m, YEAR)),
    "products_by_type": on(lambda m: sales.products_by_type(m, YEAR)),
    "purchases_summary": on(lambda m: buy.purchases_summary(m, YEAR)),
    "purchases_series": on(lambda m: buy.purchases_series(m, YEAR)),
    "purchases_by_supplier": on(lambda m: buy.purchases_by_supplier(m, YEAR)),
    "purchases_by_product": on(lambda m: buy.purchases_by_product(m, YEAR)),
    "suppliers_summary": on(lambda m: buy.suppliers_summary(m, YEAR)),
    "suppliers_series": on(lambda m: buy.suppliers_series(m, YEAR)),
    "suppliers_ranking": on(lambda m: buy.suppliers_ranking(m, YEAR)),
    "purchases_by_family": on(lambda m: buy.purchases_by_family(m, YEAR)),
    "product_supplier_matrix": on(lambda m: buy.product_supplier_matrix(m, YEAR)),
    "price_variations": on(lambda m: buy.price_variations(m, YEAR)),
    "purchase_kpis": on(lambda m: buy.purchase_kpis(m, YEAR)),
    **{f"payments_{k}": on(lambda m, k=k: buy.payments(m, EVENT_MONTH, k)) for k in ("summary", "series", "by_type", "by_contact")},
    "product_supplier_mode": on(_modes),
    "supplier_product_stats": on(lambda m: buy.supplier_product_stats(m.fact_purchases)),
    "fact_inventory_movement": on(lambda m: inv.fact_movements(m.adjustment_lines, m.transfer_lines).selectExpr("document_type", "document_id", "line_number", "direction", "date", "product_key", "warehouse_key", "cast(quantity as double) as quantity", "is_deleted")),
    **{f"movements_by_{k}": on(lambda m, k=k: inv.movements_by(m, EVENT_MONTH, k)) for k in ("direction", "product", "warehouse")},
    "movements_recent": on(lambda m: inv.movements_recent(m, EVENT_MONTH)),
    "snapshot_summary": on(inv.snapshot_summary),
    "snapshot_by_product": on(lambda m: inv.snapshot_by(m, "product")),
    "snapshot_by_warehouse": on(lambda m: inv.snapshot_by(m, "warehouse")),
    "snapshot_items": on(inv.snapshot_items),
    "stock_coverage_30d": on(lambda m: inv.stock_coverage(m, AS_OF)),
    "inventory_kpis": on(lambda m: inv.inventory_kpis(m, QUARTER)),
    "low_coverage": on(lambda m: inv.coverage_list(m, QUARTER, "low")),
    "excess_coverage": on(lambda m: inv.coverage_list(m, QUARTER, "excess")),
    "slow_inventory": on(lambda m: inv.coverage_list(m, QUARTER, "slow")),
    "alert_recent_stockout_count": on(lambda m: inv.alert_recent_stockout_count(m, AS_OF)),
    "alert_stockouts": on(lambda m: inv.alert_stock(m, False)),
    "alert_negative_stock": on(lambda m: inv.alert_stock(m, True)),
    "alert_slow_stock": on(lambda m: inv.alert_slow_stock(m, AS_OF)),
    "replenishment_opportunities": on(lambda m: inv.replenishment_opportunities(m, QUARTER)),
    "filter_date_range": on(lambda m: look.date_range(m.fact_sales)),
    "filter_currencies": on(lambda m: look.currencies(m.fact_sales, m.fact_purchases, m.fact_payments)),
    "filter_statuses": on(lambda m: look.statuses(m.fact_sales)),
    "filter_families": on(lambda m: look.families(m.dim_product)),
    "filter_suppliers": on(lambda m: look.suppliers(m.fact_purchases, m.dim_contact)),
    "filter_products": on(lambda m: look.members(m.dim_product, "product_key")),
    "filter_sellers": on(lambda m: look.members(m.dim_seller, "seller_key")),
    "filter_warehouses": on(lambda m: look.members(m.dim_warehouse, "warehouse_key")),
}


def period(f: ReportFilter, a: str = "f") -> str:
    return f"{a}.date BETWEEN DATE '{f.from_date}' AND DATE '{f.to_date}' AND NOT {a}.is_deleted AND {a}.tenant_id = '{f.tenant_id}'"


COSTED = "cost_status IN ('costed', 'estimated')"


def s(column: str, test: str | None = None) -> str:
    return f"CAST(coalesce(sum({column}){f' FILTER (WHERE {test})' if test else ''}, 0) AS DOUBLE)"


DOCS = "count(DISTINCT (document_type, document_id))"


def div(a: str, b: str, times: int = 1) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * {times}, 0)"


METRICS = f"""{s('net_sales')} AS net_sales, {s('quantity')} AS units, {DOCS} AS documents, {div(s('net_sales'), DOCS)} AS average_ticket,
  {s('cogs', COSTED)} AS cogs, {s('margin', COSTED)} AS gross_margin, {div(s('margin', COSTED), s('net_sales', COSTED), 100)} AS gross_margin_pct,
  count(*) FILTER (WHERE {COSTED}) AS costed_lines, count(*) FILTER (WHERE cost_status = 'partial') AS partial_lines,
  count(*) FILTER (WHERE cost_status = 'unavailable') AS unavailable_lines, {div(f'count(*) FILTER (WHERE {COSTED})', 'count(*)', 100)} AS cost_coverage_pct"""


def _series(f: ReportFilter, period_sql: str) -> str:
    return f"SELECT {period_sql} AS period, currency_code, {s('net_sales')} AS amount, {s('cogs', COSTED)} AS cogs, {s('margin', COSTED)} AS gross_margin FROM fact_sales f WHERE {period(f)} GROUP BY 1, 2"


def _breakdown(kind: str) -> str:
    dim, key, column = sales.BREAKDOWNS[kind]
    join = f"LEFT JOIN {dim} d ON f.{key} = d.{key}" if dim else ""
    return f"""SELECT coalesce({'d.' if dim else 'f.'}{column}, 'Sin dato') AS label, currency_code, {s('net_sales')} AS amount, {s('quantity')} AS quantity, {s('cogs', COSTED)} AS cogs, {s('margin', COSTED)} AS gross_margin
      FROM fact_sales f {join} WHERE {period(YEAR)} GROUP BY 1, 2 ORDER BY amount DESC, label, currency_code LIMIT 15"""


def _detail(label: str, join: str, top: int, more: str = "", more_out: str = "") -> str:
    return f"""SELECT *, round({div('net_sales', 'sum(net_sales) OVER (PARTITION BY currency_code)', 100)}, 6) AS share_pct FROM (
      SELECT {label} AS label, coalesce(currency_code, 'COP') AS currency_code, {s('net_sales')} AS net_sales, {s('f.quantity')} AS units, {DOCS} AS documents,
        {s('net_sales', "document_type = 'invoice'")} AS invoice_sales, abs({s('net_sales', "document_type = 'credit_note'")}) AS credit_note_amount,
        {s('cogs', COSTED)} AS cogs, {s('margin', COSTED)} AS gross_margin, {s('net_sales', COSTED)} AS costed_sales, count(*) AS total_lines,
        count(*) FILTER (WHERE {COSTED}) AS costed_lines, count(*) FILTER (WHERE cost_status = 'unavailable') AS unavailable_lines,
        count(DISTINCT f.product_key) AS product_count, max(f.date) AS last_sale_date, {more}
        {div(s('net_sales'), s('f.quantity'))} AS average_unit_sale, {div(s('margin', COSTED), s('net_sales', COSTED), 100)} AS gross_margin_pct,
        {div(f'count(*) FILTER (WHERE {COSTED})', 'count(*)', 100)} AS cost_coverage_pct
      FROM fact_sales f {join} WHERE {period(YEAR)} GROUP BY 1, 2) ORDER BY net_sales DESC, label, currency_code LIMIT {top}"""


def _detail_of(kind: str) -> str:
    dim, key, column, default = sales.DETAILS[kind]
    return _detail(f"coalesce({'d.' if dim else 'f.'}{column}, '{default}')", f"LEFT JOIN {dim} d ON f.{key} = d.{key}" if dim else "", 200)


MODES = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY line_count DESC, units DESC, amount DESC, last_purchase_date DESC NULLS LAST, supplier_key) AS nth,
    CAST(sum(line_count) OVER (PARTITION BY product_key) AS BIGINT) AS total_lines, count(*) OVER (PARTITION BY product_key) AS supplier_count FROM (
    SELECT tenant_id, product_key, provider_key AS supplier_key, count(*) AS line_count, sum(quantity) AS units, sum(coalesce(amount, 0)) AS amount, max(date) AS last_purchase_date
    FROM fact_purchases WHERE NOT is_deleted AND product_key IS NOT NULL AND provider_key IS NOT NULL GROUP BY 1, 2, 3) g) r WHERE nth = 1"""


def _bought(select: str, tail: str, join: str = "", where: str = "") -> str:
    return f"SELECT {select} FROM fact_purchases f {join} WHERE {period(YEAR)} {where} {tail}"


NAMES = "LEFT JOIN dim_product p ON f.product_key = p.product_key LEFT JOIN dim_contact c ON f.provider_key = c.contact_key"
PRODUCT, FAMILY_OF, SUPPLIER = "coalesce(p.name, 'Sin producto')", "coalesce(p.family_name, 'SIN FAMILIA')", "coalesce(c.name, 'Sin proveedor')"
CUR = "coalesce(currency_code, 'COP')"
PAID = f"FROM fact_payments f LEFT JOIN dim_contact c ON f.contact_key = c.contact_key WHERE {period(EVENT_MONTH)}"
MOVES = """
  SELECT tenant_id, 'adjustment' AS document_type, document_id, line_number, 'adjustment' AS direction, date, product_key, warehouse_key, quantity, is_deleted FROM adjustment_lines
  UNION ALL SELECT tenant_id, 'transfer', document_id, line_number, 'transfer_out', date, product_key, source_key, -quantity, is_deleted FROM transfer_lines
  UNION ALL SELECT tenant_id, 'transfer', document_id, line_number, 'transfer_in', date, product_key, destination_key, quantity, is_deleted FROM transfer_lines"""
STOCK = "(SELECT * FROM fact_snapshots WHERE run_id = (SELECT run_id FROM snapshot_runs WHERE status = 'succeeded' ORDER BY finished_at DESC LIMIT 1))"
COVER = f"""SELECT st.product_key, q AS quantity, v AS value, coalesce(d, 0) AS period_units, CASE WHEN coalesce(d, 0) > 0 THEN round(q * {QUARTER.days} / d, 1) END AS coverage_days
  FROM (SELECT product_key, CAST(sum(quantity) AS DOUBLE) AS q, CAST(sum(value) AS DOUBLE) AS v FROM {STOCK} x GROUP BY 1) st
  LEFT JOIN (SELECT product_key, CAST(sum(quantity) AS DOUBLE) AS d FROM fact_sales f WHERE {period(QUARTER)} AND product_key IS NOT NULL GROUP BY 1) dm ON st.product_key = dm.product_key"""


def _cover_list(test: str, order: str) -> str:
    return f"SELECT v.*, coalesce(p.name, 'Sin producto') AS label FROM ({COVER}) v LEFT JOIN dim_product p ON v.product_key = p.product_key WHERE {test} ORDER BY {order}, v.product_key LIMIT 30"


def _alert(having: str, order: str, top: int, where: str = "") -> str:
    return f"SELECT coalesce(p.name, 'Sin producto') AS label, {s('f.quantity')} AS quantity FROM {STOCK} f LEFT JOIN dim_product p ON f.product_key = p.product_key {where} GROUP BY 1 HAVING {having} ORDER BY {order} LIMIT {top}"


RAW_SQL = {
    "sales_metrics": f"SELECT currency_code, {METRICS} FROM fact_sales f WHERE {period(QUARTER)} GROUP BY 1",
    "fact_filter": f"SELECT currency_code, {METRICS} FROM fact_sales f WHERE {period(FAMILY)} AND currency_code = 'COP' AND product_key IN (SELECT product_key FROM dim_product WHERE family_name = 'SIN FAMILIA') GROUP BY 1",
    "sales_overview": f"""WITH n AS (SELECT currency_code, {METRICS} FROM fact_sales f WHERE {period(QUARTER)} GROUP BY 1), b AS (SELECT currency_code, {METRICS} FROM fact_sales f WHERE {period(QUARTER.previous())} GROUP BY 1)
        SELECT coalesce(n.currency_code, b.currency_code) AS currency_code, n.net_sales, n.units, n.documents, b.net_sales AS previous_net_sales, b.units AS previous_units, b.documents AS previous_documents,
          (n.net_sales - b.net_sales) / nullif(abs(b.net_sales), 0) * 100 AS net_sales_change_pct, (n.units - b.units) / nullif(abs(b.units), 0) * 100 AS units_change_pct,
          CAST(n.documents - b.documents AS DOUBLE) / nullif(CAST(abs(b.documents) AS DOUBLE), 0) * 100 AS documents_change_pct FROM n FULL JOIN b ON n.currency_code = b.currency_code""",
    "sales_series": _series(QUARTER, "date"),
    "sales_series_monthly": _series(YEAR, "CAST(date_trunc('month', date) AS DATE)"),
    **{f"sales_breakdown_{k}": _breakdown(k) for k in sales.BREAKDOWNS},
    "sales_breakdowns": " UNION ALL ".join(f"SELECT '{k}' AS kind, *, CAST(row_number() OVER (ORDER BY amount DESC, label, currency_code) AS INT) AS nth FROM ({_breakdown(k)})" for k in sales.BREAKDOWNS),
    **{f"sales_detail_{k}": _detail_of(k) for k in sales.DETAILS},
    "sales_modal_supplier": f"WITH modes AS ({MODES}) " + _detail("coalesce(c.name, 'SIN HISTORIAL DE PROVEEDOR')", "LEFT JOIN modes m ON f.product_key = m.product_key LEFT JOIN dim_contact c ON m.supplier_key = c.contact_key", 100,
        f"round({div('sum(CAST(abs(net_sales) AS DOUBLE) * coalesce(round(CAST(m.line_count AS DOUBLE) / m.total_lines, 6), 0))', 'sum(CAST(abs(net_sales) AS DOUBLE))', 100)}, 6) AS supplier_confidence_pct,"),
    "monthly_net_sales": f"SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, {s('net_sales')} AS net_sales FROM fact_sales f WHERE NOT is_deleted AND date >= DATE '2000-08-01' AND date < DATE '2001-08-01' GROUP BY 1, 2",
    "sales_kpis": f"""SELECT *, average_daily_sales / target_daily_sales * 100 AS sales_pace_vs_target_pct FROM (SELECT *, net_sales / {QUARTER.days} AS average_daily_sales, monthly_sales_target / 31 AS target_daily_sales FROM (
        SELECT currency_code, {s('net_sales')} AS net_sales, {s('quantity')} AS units, {DOCS} AS documents, {div(s('quantity'), DOCS)} AS units_per_transaction, {div(s('net_sales'), DOCS)} AS average_ticket,
          {div(s('net_sales'), s('quantity'))} AS average_unit_sale, {s('cogs', COSTED)} AS cogs, {s('margin', COSTED)} AS gross_margin, {div(s('margin', COSTED), s('net_sales', COSTED), 100)} AS gross_margin_pct,
          {div(f'count(*) FILTER (WHERE {COSTED})', 'count(*)', 100)} AS cost_coverage_pct, count(*) FILTER (WHERE cost_status = 'partial') AS partial_lines, count(*) FILTER (WHERE cost_status = 'unavailable') AS unavailable_lines,
          {s('net_sales', "document_type = 'invoice'")} AS invoice_sales, abs({s('net_sales', "document_type = 'credit_note'")}) AS credit_note_amount,
          {div("abs(" + s('net_sales', "document_type = 'credit_note'") + ")", s('net_sales', "document_type = 'invoice'"), 100)} AS credit_note_rate,
          CASE WHEN currency_code = 'COP' THEN CAST(50000000 AS DOUBLE) END AS monthly_sales_target FROM fact_sales f WHERE {period(QUARTER)} GROUP BY 1))""",
    "customer_kpis": f"""WITH d AS (SELECT currency_code, contact_key, document_type, document_id, sum(net_sales) AS amount FROM fact_sales f WHERE {period(QUARTER)} AND contact_key IS NOT NULL GROUP BY 1, 2, 3, 4),
        p AS (SELECT currency_code, contact_key, count(*) AS documents, sum(amount) AS amount FROM d GROUP BY 1, 2),
        fi AS (SELECT currency_code, contact_key, min(date) AS first_date FROM fact_sales WHERE NOT is_deleted AND document_type = 'invoice' AND contact_key IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT p.*, first_date, row_number() OVER (PARTITION BY p.currency_code ORDER BY amount DESC, p.contact_key) AS nth FROM p LEFT JOIN fi ON p.currency_code = fi.currency_code AND p.contact_key = fi.contact_key)
        SELECT currency_code, count(*) AS active_customers, count(*) FILTER (WHERE documents >= 2) AS repeat_customers, {div('count(*) FILTER (WHERE documents >= 2)', 'count(*)', 100)} AS repeat_customer_rate,
          count(*) FILTER (WHERE first_date BETWEEN DATE '{QUARTER.from_date}' AND DATE '{QUARTER.to_date}') AS new_customers, {div('sum(amount) FILTER (WHERE nth <= 5)', 'sum(amount)', 100)} AS top_customer_concentration FROM r GROUP BY 1""",
    "customers_summary": f"SELECT currency_code, count(DISTINCT contact_key) AS customers, {DOCS} AS documents, {s('net_sales')} AS amount FROM fact_sales f WHERE {period(YEAR)} GROUP BY 1",
    "customers_top": f"SELECT coalesce(c.name, 'Sin cliente') AS label, currency_code, {s('net_sales')} AS amount, count(DISTINCT document_id) AS documents FROM fact_sales f LEFT JOIN dim_contact c ON f.contact_key = c.contact_key WHERE {period(YEAR)} GROUP BY 1, 2 ORDER BY amount DESC, label, currency_code LIMIT 20",
    "customers_recent": f"SELECT coalesce(c.name, 'Sin cliente') AS label, max(date) AS last_purchase, {s('net_sales')} AS amount FROM fact_sales f LEFT JOIN dim_contact c ON f.contact_key = c.contact_key WHERE {period(YEAR)} GROUP BY 1 ORDER BY last_purchase DESC, amount DESC, label LIMIT 20",
    "products_summary": f"SELECT currency_code, count(DISTINCT product_key) AS products, {s('quantity')} AS units, {s('net_sales')} AS amount FROM fact_sales f WHERE {period(YEAR)} GROUP BY 1",
    "products_best_sellers": f"SELECT coalesce(p.name, 'Sin producto') AS label, currency_code, {s('net_sales')} AS amount, {s('quantity')} AS quantity FROM fact_sales f LEFT JOIN dim_product p ON f.product_key = p.product_key WHERE {period(YEAR)} GROUP BY 1, 2 ORDER BY amount DESC, label, currency_code LIMIT 25",
    "products_by_type": f"SELECT coalesce(p.item_type, 'Sin tipo') AS label, currency_code, {s('net_sales')} AS amount, {s('quantity')} AS quantity FROM fact_sales f LEFT JOIN dim_product p ON f.product_key = p.product_key WHERE {period(YEAR)} GROUP BY 1, 2",
    "purchases_summary": _bought(f"currency_code, {s('amount')} AS purchase_amount, {s('quantity')} AS quantity, count(DISTINCT document_id) AS documents", "GROUP BY 1"),
    "purchases_series": _bought(f"CAST(date_trunc('month', date) AS DATE) AS period, currency_code, {s('amount')} AS amount", "GROUP BY 1, 2"),
    "purchases_by_supplier": _bought(f"{SUPPLIER} AS label, currency_code, {s('amount')} AS amount", "GROUP BY 1, 2 ORDER BY amount DESC, label, currency_code LIMIT 15", NAMES),
    "purchases_by_product": _bought(f"{PRODUCT} AS label, currency_code, {s('amount')} AS amount", "GROUP BY 1, 2 ORDER BY amount DESC, label, currency_code LIMIT 15", NAMES),
    "suppliers_summary": _bought(f"{CUR} AS currency_code, {s('amount')} AS purchase_amount, {s('quantity')} AS units, count(DISTINCT document_id) AS documents, count(DISTINCT provider_key) AS suppliers, {div(s('amount'), 'count(DISTINCT document_id)')} AS average_purchase_ticket, {div(s('amount'), s('quantity'))} AS average_unit_cost", "GROUP BY 1"),
    "suppliers_series": _bought(f"CAST(date_trunc('month', date) AS DATE) AS period, {CUR} AS currency_code, {s('amount')} AS amount, {s('quantity')} AS units", "GROUP BY 1, 2"),
    "suppliers_ranking": f"SELECT *, round({div('purchase_amount', 'sum(purchase_amount) OVER (PARTITION BY currency_code)', 100)}, 6) AS share_pct FROM (" + _bought(f"provider_key AS supplier_key, {SUPPLIER} AS supplier, {CUR} AS currency_code, {s('amount')} AS purchase_amount, {s('quantity')} AS units, count(DISTINCT document_id) AS documents, count(DISTINCT f.product_key) AS skus, min(date) AS first_purchase_date, max(date) AS last_purchase_date, {div(s('amount'), 'count(DISTINCT document_id)')} AS average_purchase_ticket, {div(s('amount'), s('quantity'))} AS average_unit_cost", "GROUP BY 1, 2, 3", NAMES) + ") ORDER BY purchase_amount DESC, supplier_key, currency_code LIMIT 100",
    "purchases_by_family": _bought(f"{FAMILY_OF} AS family, {CUR} AS currency_code, {s('amount')} AS purchase_amount, {s('quantity')} AS units, count(DISTINCT provider_key) AS suppliers, count(DISTINCT f.product_key) AS skus", "GROUP BY 1, 2 ORDER BY purchase_amount DESC, family, currency_code LIMIT 100", NAMES),
    "product_supplier_matrix": _bought(f"{PRODUCT} AS product, {FAMILY_OF} AS family, {SUPPLIER} AS supplier, {CUR} AS currency_code, {s('amount')} AS purchase_amount, {s('quantity')} AS units, count(DISTINCT document_id) AS documents, max(date) AS last_purchase_date, {div(s('amount'), s('quantity'))} AS average_unit_cost", "GROUP BY 1, 2, 3, 4 ORDER BY purchase_amount DESC, product, family, supplier, currency_code LIMIT 200", NAMES),
    "price_variations": f"SELECT *, round({div('maximum_cost - minimum_cost', 'average_unit_cost', 100)}, 6) AS cost_range_pct FROM (" + _bought(f"{PRODUCT} AS product, {FAMILY_OF} AS family, {SUPPLIER} AS supplier, {CUR} AS currency_code, CAST(min(unit_cost) AS DOUBLE) AS minimum_cost, CAST(max(unit_cost) AS DOUBLE) AS maximum_cost, CAST(sum(unit_cost) AS DOUBLE) / count(*) AS average_unit_cost, count(*) AS purchase_lines", "GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2", NAMES, "AND unit_cost > 0") + ") ORDER BY cost_range_pct DESC, product, family, supplier, currency_code LIMIT 100",
    "purchase_kpis": f"""WITH f AS (SELECT * FROM fact_purchases f WHERE {period(YEAR)}), g AS (SELECT currency_code, {s('amount')} AS purchase_amount, {s('quantity')} AS units, count(DISTINCT document_id) AS documents, count(DISTINCT provider_key) AS suppliers FROM f GROUP BY 1),
        t AS (SELECT currency_code, sum(spent) AS top FROM (SELECT *, row_number() OVER (PARTITION BY currency_code ORDER BY spent DESC, provider_key) AS nth FROM (SELECT currency_code, provider_key, sum(amount) AS spent FROM f WHERE provider_key IS NOT NULL GROUP BY 1, 2)) WHERE nth <= 5 GROUP BY 1)
        SELECT g.*, {div('purchase_amount', 'documents')} AS average_purchase_ticket, {div('purchase_amount', 'units')} AS average_unit_cost, {div('top', 'purchase_amount', 100)} AS top_supplier_concentration FROM g LEFT JOIN t ON g.currency_code = t.currency_code""",
    "payments_summary": f"SELECT currency_code, {s('amount')} AS amount, count(*) AS payments {PAID} GROUP BY 1",
    "payments_series": f"SELECT CAST(date_trunc('month', date) AS DATE) AS period, currency_code, {s('amount')} AS amount {PAID} GROUP BY 1, 2",
    "payments_by_type": f"SELECT coalesce(payment_type, 'Sin tipo') AS label, currency_code, {s('amount')} AS amount {PAID} GROUP BY 1, 2",
    "payments_by_contact": f"SELECT coalesce(c.name, 'Sin contacto') AS label, currency_code, {s('amount')} AS amount {PAID} GROUP BY 1, 2 ORDER BY amount DESC, label, currency_code LIMIT 15",
    "product_supplier_mode": f"SELECT tenant_id, product_key, supplier_key, line_count, total_lines, supplier_count, round(CAST(line_count AS DOUBLE) / total_lines, 6) AS confidence, last_purchase_date FROM ({MODES})",
    "supplier_product_stats": f"""SELECT tenant_id, product_key, supplier_key, currency_code, line_count, units, amount, median_cost, min_cost, max_cost, last_cost, last_purchase_date, average_cost,
          round(CAST(line_count AS DOUBLE) / sum(line_count) OVER w * 100, 6) AS line_share_pct, round({div('units', 'sum(units) OVER w', 100)}, 6) AS unit_share_pct,
          CAST(row_number() OVER (w ORDER BY line_count DESC, units DESC, amount DESC, last_purchase_date DESC NULLS LAST, supplier_key) AS INT) AS frequency_rank,
          CAST(row_number() OVER (w ORDER BY average_cost, units DESC, last_purchase_date DESC NULLS LAST, supplier_key) AS INT) AS cost_rank FROM (
        SELECT tenant_id, product_key, provider_key AS supplier_key, {CUR} AS currency_code, count(*) AS line_count, {s('quantity')} AS units, {s('amount')} AS amount,
          quantile_cont(CAST(unit_cost AS DOUBLE), 0.5) FILTER (WHERE unit_cost > 0) AS median_cost, CAST(min(unit_cost) FILTER (WHERE unit_cost > 0) AS DOUBLE) AS min_cost, CAST(max(unit_cost) FILTER (WHERE unit_cost > 0) AS DOUBLE) AS max_cost,
          CAST(arg_max(unit_cost, (date, document_id, line_number)) FILTER (WHERE unit_cost IS NOT NULL) AS DOUBLE) AS last_cost, max(date) AS last_purchase_date, {div(s('amount'), s('quantity'))} AS average_cost
        FROM fact_purchases WHERE NOT is_deleted AND product_key IS NOT NULL AND provider_key IS NOT NULL AND quantity > 0 GROUP BY 1, 2, 3, 4) WINDOW w AS (PARTITION BY tenant_id, product_key, currency_code)""",
    "fact_inventory_movement": f"SELECT document_type, document_id, line_number, direction, date, product_key, warehouse_key, CAST(quantity AS DOUBLE) AS quantity, is_deleted FROM ({MOVES})",
    "movements_by_direction": f"SELECT direction AS label, {s('quantity')} AS quantity FROM ({MOVES}) f WHERE {period(EVENT_MONTH)} GROUP BY 1",
    "movements_by_product": f"SELECT {PRODUCT} AS label, {s('quantity')} AS quantity FROM ({MOVES}) f LEFT JOIN dim_product p ON f.product_key = p.product_key WHERE {period(EVENT_MONTH)} GROUP BY 1 ORDER BY abs(sum(quantity)) DESC, label LIMIT 20",
    "movements_by_warehouse": f"SELECT coalesce(w.name, 'Sin bodega') AS label, {s('quantity')} AS quantity FROM ({MOVES}) f LEFT JOIN dim_warehouse w ON f.warehouse_key = w.warehouse_key WHERE {period(EVENT_MONTH)} GROUP BY 1",
    "movements_recent": f"SELECT date, document_type, document_id, line_number, direction, {PRODUCT} AS product, coalesce(w.name, 'Sin bodega') AS warehouse, CAST(quantity AS DOUBLE) AS quantity FROM ({MOVES}) f LEFT JOIN dim_product p ON f.product_key = p.product_key LEFT JOIN dim_warehouse w ON f.warehouse_key = w.warehouse_key WHERE {period(EVENT_MONTH)} ORDER BY date DESC, document_id DESC, line_number DESC, direction LIMIT 100",
    "snapshot_summary": f"SELECT count(*) AS rows, {s('quantity')} AS units, {s('value')} AS value FROM {STOCK} f HAVING count(*) > 0",
    "snapshot_by_product": f"SELECT {PRODUCT} AS label, {s('quantity')} AS quantity, {s('value')} AS value FROM {STOCK} f LEFT JOIN dim_product p ON f.product_key = p.product_key GROUP BY 1 ORDER BY value DESC, label LIMIT 50",
    "snapshot_by_warehouse": f"SELECT coalesce(w.name, 'Sin bodega') AS label, {s('quantity')} AS quantity, {s('value')} AS value FROM {STOCK} f LEFT JOIN dim_warehouse w ON f.warehouse_key = w.warehouse_key GROUP BY 1",
    "snapshot_items": f"SELECT f.product_key, f.warehouse_key, {PRODUCT} AS product, coalesce(w.name, 'Sin bodega') AS warehouse, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(value AS DOUBLE) AS value FROM {STOCK} f LEFT JOIN dim_product p ON f.product_key = p.product_key LEFT JOIN dim_warehouse w ON f.warehouse_key = w.warehouse_key ORDER BY quantity, f.product_key, f.warehouse_key LIMIT 100",
    "stock_coverage_30d": f"SELECT st.product_key, {PRODUCT} AS label, q AS quantity, round(q * 30 / nullif(sold, 0), 1) AS coverage_days FROM (SELECT product_key, CAST(sum(quantity) AS DOUBLE) AS q FROM {STOCK} x GROUP BY 1 HAVING sum(quantity) > 0) st JOIN (SELECT product_key, CAST(sum(quantity) AS DOUBLE) AS sold FROM fact_sales WHERE NOT is_deleted AND date >= DATE '2001-07-01' GROUP BY 1) sl ON st.product_key = sl.product_key LEFT JOIN dim_product p ON st.product_key = p.product_key ORDER BY coverage_days ASC NULLS LAST, st.product_key LIMIT 30",
    "inventory_kpis": f"SELECT count(*) AS products, coalesce(sum(quantity), 0) AS units, round(coalesce(sum(value), 0), 2) AS value, count(*) FILTER (WHERE quantity <= 0) AS unavailable_products, count(*) FILTER (WHERE quantity < 0) AS negative_products, count(*) FILTER (WHERE coverage_days > 0 AND coverage_days < 14) AS low_coverage_products, count(*) FILTER (WHERE coverage_days >= 120) AS excess_coverage_products, count(*) FILTER (WHERE quantity > 0 AND period_units <= 0) AS no_demand_products, round(coalesce(sum(value) FILTER (WHERE quantity > 0 AND period_units <= 0), 0), 2) AS no_demand_value FROM ({COVER})",
    "low_coverage": _cover_list("coverage_days > 0 AND coverage_days < 14", "coverage_days, period_units DESC"),
    "excess_coverage": _cover_list("coverage_days >= 120", "value DESC NULLS LAST"),
    "slow_inventory": _cover_list("quantity > 0 AND period_units <= 0", "value DESC NULLS LAST"),
    "alert_recent_stockout_count": f"SELECT 'Agotados con venta reciente' AS label, count(*) AS count FROM (SELECT product_key FROM {STOCK} x GROUP BY 1 HAVING sum(quantity) <= 0) o JOIN fact_sales f ON f.product_key = o.product_key WHERE NOT is_deleted AND date >= DATE '2001-05-02'",
    "alert_stockouts": _alert("sum(f.quantity) <= 0", "quantity, label", 50),
    "alert_negative_stock": _alert("sum(f.quantity) < 0", "quantity, label", 50),
    "alert_slow_stock": _alert("sum(f.quantity) > 0", "quantity DESC, label", 30, "WHERE NOT EXISTS (SELECT 1 FROM fact_sales s WHERE s.product_key = f.product_key AND NOT s.is_deleted AND s.date >= DATE '2001-05-02')"),
    "replenishment_opportunities": f"""SELECT * FROM (SELECT st.product_key, name, reference, family_name AS family, q AS quantity, u AS units_90d, CASE WHEN u > 0 THEN round(q * 90 / u, 6) END AS coverage_days, v AS value, CAST(current_cost AS DOUBLE) AS current_cost, CASE WHEN u > 0 THEN 'excess' ELSE 'slow' END AS category
        FROM (SELECT product_key, CAST(sum(quantity) AS DOUBLE) AS q, CAST(sum(value) AS DOUBLE) AS v FROM {STOCK} x GROUP BY 1 HAVING sum(quantity) > 0) st
        LEFT JOIN (SELECT product_key AS dk, CAST(sum(quantity) AS DOUBLE) AS d FROM fact_sales f WHERE {period(QUARTER)} GROUP BY 1) dm ON st.product_key = dk CROSS JOIN LATERAL (SELECT greatest(coalesce(d, 0), 0) AS u) z
        JOIN dim_product p ON st.product_key = p.product_key WHERE NOT p.is_deleted) WHERE units_90d <= 0 OR coverage_days >= 120 ORDER BY category DESC, value DESC NULLS LAST, product_key LIMIT 200""",
    "filter_date_range": "SELECT min(date) AS from_date, max(date) AS to_date FROM fact_sales WHERE NOT is_deleted",
    "filter_currencies": "SELECT currency_code FROM fact_sales WHERE NOT is_deleted UNION SELECT currency_code FROM fact_purchases WHERE NOT is_deleted UNION SELECT currency_code FROM fact_payments WHERE NOT is_deleted",
    "filter_statuses": "SELECT DISTINCT document_status FROM fact_sales WHERE NOT is_deleted",
    "filter_families": "SELECT DISTINCT family_name AS family FROM dim_product WHERE NOT is_deleted",
    "filter_suppliers": "SELECT contact_key AS key, name FROM dim_contact WHERE contact_key IN (SELECT provider_key FROM fact_purchases WHERE NOT is_deleted)",
    "filter_products": "SELECT product_key AS key, name FROM dim_product WHERE NOT is_deleted ORDER BY name, key LIMIT 500",
    "filter_sellers": "SELECT seller_key AS key, name FROM dim_seller WHERE NOT is_deleted ORDER BY name, key LIMIT 500",
    "filter_warehouses": "SELECT warehouse_key AS key, name FROM dim_warehouse WHERE NOT is_deleted ORDER BY name, key LIMIT 500",
}
SQL = {k: with_fixtures(v) for k, v in RAW_SQL.items()}
