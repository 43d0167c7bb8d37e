"""Reading, coercing and importing over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.cols import code_of, date_of, decimal_of, flag_of
from martloom.operators import costing, sales
from martloom.operators import replenish as r
from martloom.plans import flow_queries, reports
from martloom.plans.filters import default_period
from martloom.plans.fixtures import with_fixtures
from martloom.plans.reports import AS_OF, QUARTER, on
from martloom.sources import documents as docs
from martloom.sources.opening import opening_report
from martloom.sources.sinks import shared_folder


def _report(m) -> DataFrame:
    """The opening report as a sheet exports it: headers with accents, thousands with commas, blanks."""
    path = shared_folder(m.spark, "opening")
    text = lambda c: F.col(c).cast("string")
    number = lambda c: F.format_number(F.col(c), 4)
    sheet = m.opening_report.select(
        F.lit("c").alias("Categoría"), F.col("item").alias("Ítem"), F.col("reference").alias("Referencia"), F.lit("").alias("Descripción"), F.lit("1").alias("Cantidad mínima"), number("quantity").alias("Cantidad"),
        F.lit(" ").alias("Cantidad en remisiones"), F.lit("u").alias("Unidad"), F.lit("activo").alias("Estado"), number("average_cost").alias("Costo promedio"), text("quantity").alias("Total"))
    sheet.write.option("header", True).csv(path)
    rows = opening_report(m.spark.read.option("header", True).csv(path))
    return rows.select("item", "reference", "description", *[F.col(c).cast("double").alias(c) for c in ("quantity", "reserved", "average_cost")])


def _shapes(m) -> DataFrame:
    """Events as documents whose fields come in all the shapes that are taken, and some that aren't."""
    i, v = F.col("event_id"), F.col("event_id").cast("string")

    def one_of(*shapes) -> Column:
        n = len(shapes)
        return F.coalesce(*[F.when(i % n == k, s) for k, s in enumerate(shapes)])

    lit = F.lit
    amount = one_of(v, F.concat(lit('"'), v, lit('.5"')), F.concat(lit('{"amount": '), v, lit("}")), F.concat(lit('{"value": "'), v, lit('"}')), lit("true"), lit('"abc"'), lit("[1]"))
    day = one_of(F.concat(lit('"'), F.to_date("ts").cast("string"), lit('T10:00:00Z"')), F.concat(lit('" '), F.to_date("ts").cast("string"), lit('"')), lit('"05/01/2024"'), lit('"2024-13-45"'), lit('""'))
    flag = one_of(*[lit(x) for x in ("true", '"1"', '"Yes"', "0", '"no"', '"maybe"', "null")])
    code = one_of(lit('{"code": "COP", "name": "peso"}'), lit('{"name": "USD"}'), lit('" EUR "'), lit("null"))
    payload = F.concat(lit('{"amount": '), amount, lit(', "date": '), day, lit(', "on": '), flag, lit(', "currency": '), code, lit("}"))
    p = F.col("payload")
    return m.events.select("event_id", payload.alias("payload")).select("event_id", decimal_of(p, "amount").cast("double").alias("amount"), date_of(p, "date").alias("day"), flag_of(p, "on").alias("is_on"), code_of(p, "currency").alias("currency"))


def _hashes(m) -> DataFrame:
    """Hashes of payloads with keys in any order and blanks."""
    v = F.col("event_id").cast("string")
    payload = F.concat(F.lit('{ "b" : [1, {"y":'), v, F.lit(', "x": "é"}],\n "a": null, "B": "'), F.col("event_type"), F.lit('"}'))
    return m.events.select("event_id", docs.canonical_hash(payload).alias("hash"))


def _decisions(m) -> DataFrame:
    """Opening imports of users, one for every odd event, against runs, one for every even one."""
    e = m.events.select(F.col("user_id").cast("string").alias("tenant_id"), F.to_date("ts").alias("cutoff"), (F.col("event_id") % 10).cast("string").alias("content_hash"), "event_id")
    runs = e.filter("event_id % 2 = 0").withColumn("status", F.when(F.col("event_id") % 3 == 0, "failed").when(F.col("event_id") % 7 == 0, "succeeded_with_exceptions").otherwise("running"))
    return costing.opening_decisions(e.filter("event_id % 2 = 1").withColumn("content_hash", (F.col("event_id") % 6 * 2).cast("string")), runs).select("event_id", "decision")


QUERIES = {
    "read_opening_report": on(_report),
    "scalar_coercions": on(_shapes),
    "canonical_hash": on(_hashes),
    "opening_decisions": on(_decisions),
    "default_period_sales": on(lambda m: sales.sales_metrics(m.fact_sales, default_period(AS_OF))),
    "export_replenishment": on(lambda m: r.export_rows(flow_queries._items(m, 100), r.purchase_plans(flow_queries._items(m, 100), AS_OF))),
}

_THIS = default_period(AS_OF)
_FIRST = flow_queries.PLANS.replace("FROM que q LEFT JOIN pref w", "FROM (SELECT * FROM que ORDER BY queue_rank, queue_value DESC NULLS LAST, product_key LIMIT 100) q LEFT JOIN pref w")
RAW_SQL = {
    "read_opening_report": "SELECT trim(item) AS item, reference, CAST(NULL AS VARCHAR) AS description, CAST(quantity AS DOUBLE) AS quantity, CAST(0 AS DOUBLE) AS reserved, CAST(average_cost AS DOUBLE) AS average_cost FROM opening_report",
    "scalar_coercions": """SELECT event_id, CASE event_id % 7 WHEN 1 THEN event_id + 0.5 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS amount, CASE WHEN event_id % 5 < 2 THEN CAST(ts AS DATE) END AS day,
        CASE WHEN event_id % 7 < 3 THEN true WHEN event_id % 7 < 5 THEN false END AS is_on, CASE event_id % 4 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS currency FROM events""",
    "canonical_hash": """SELECT event_id, sha256('{"B":"' || event_type || '","a":null,"b":[1,{"x":"é","y":' || event_id || '}]}') AS hash FROM events""",
    "opening_decisions": """WITH e AS (SELECT user_id AS t, CAST(ts AS DATE) AS c, event_id FROM events), r AS (SELECT t, c, event_id % 10 AS h, CASE WHEN event_id % 3 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'succeeded' ELSE 'running' END AS s FROM e WHERE event_id % 2 = 0)
        SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.t = e.t AND r.c = e.c AND r.h = e.event_id % 6 * 2 AND s <> 'failed') THEN 'reuse' WHEN EXISTS (SELECT 1 FROM r WHERE r.t = e.t AND r.c = e.c AND s = 'succeeded') THEN 'reject' ELSE 'import' END AS decision FROM e WHERE event_id % 2 = 1""",
    "export_replenishment": f"""WITH {_FIRST}, said AS (SELECT *, CASE WHEN supplier_key IS NULL THEN 'No hay un proveedor identificado con suficiente evidencia.' WHEN critical_lines > 0 THEN 'Hay productos agotados o criticos con demanda reciente.'
        WHEN coalesce(minimum_order_amount, 0) > 0 AND estimated_value >= minimum_order_amount THEN 'El pedido alcanza el minimo del proveedor.' WHEN free_shipping_threshold > 0 AND estimated_value >= free_shipping_threshold THEN 'El pedido alcanza el umbral de envio gratis.'
        WHEN NOT policy_configured THEN 'Configura minimo, plazo y transporte para decidir con precision.' ELSE 'Acumular hasta completar el minimo o la proxima ventana.' END AS reason FROM plans)
        SELECT i.product_key, q.reference, q.name, q.family, i.priority, q.reason, q.quantity_on_hand, q.units_sold, q.daily_velocity, q.coverage_days, i.recommended_quantity, i.unit_cost, i.estimated_purchase_value, 'COP' AS currency_code, i.preferred_supplier, i.supplier_source,
          o.decision AS order_decision, o.reason AS order_decision_reason, o.lines AS order_lines, o.units AS order_units, o.estimated_value AS order_estimated_value, o.amount_to_minimum AS order_amount_to_minimum, o.next_review_date AS order_next_review_date, o.estimated_total_with_shipping AS order_estimated_total_with_shipping
        FROM items i JOIN que q ON i.product_key = q.product_key LEFT JOIN said o ON i.supplier_key IS NOT DISTINCT FROM o.supplier_key""",
}
SQL = {k: with_fixtures(v) for k, v in RAW_SQL.items()} | {
    "default_period_sales": reports.SQL["sales_metrics"].replace(f"DATE '{QUARTER.from_date}'", f"DATE '{_THIS.from_date}'").replace(f"DATE '{QUARTER.to_date}'", f"DATE '{_THIS.to_date}'"),
}
