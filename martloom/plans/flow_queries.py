"""Replenishment, landing, star-schema and change-stream queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from martloom.operators import landing, mart
from martloom.operators import purchases as buy
from martloom.operators import replenish as r
from martloom.plans.fixtures import with_fixtures
from martloom.plans.reports import AS_OF, MODES, YEAR, on, period
from martloom.sources import documents as docs
from martloom.sources.sinks import shared_folder, stored
from martloom.streaming import changes


#: Days that an order is to last; long enough that the test tables' stock runs short.
TARGET = 240


def _once(m, name: str, make):
    """A table that several steps use, written once for these marts."""
    if name not in m.made:
        m.made[name] = stored(make(m.fact_purchases))
    return m.made[name]


def _stats(m):
    return _once(m, "stats", buy.supplier_product_stats)


def _modes(m):
    return _once(m, "modes", buy.product_supplier_mode)


def _candidates(m):
    return r.candidates(m, _stats(m), _modes(m), YEAR, TARGET)


def _queue(m, limit=100):
    return r.queue(_candidates(m), m.review_actions, limit=limit)


def _items(m, limit=None):
    return r.apply_policies(_queue(m, limit), m.supplier_policies, m.product_policies, _stats(m), m.dim_contact, TARGET)


def _plans(m):
    return r.purchase_plans(_items(m), AS_OF)


CANDIDATE = ("product_key", "name", "reference", "family", "quantity_on_hand", "units_sold", "units_7d", "units_30d", "units_90d", "daily_velocity", "coverage_days", "unit_cost", "supplier_key", "preferred_supplier", "supplier_source", "recommended_quantity")
ITEM = ("product_key", "priority", "supplier_key", "preferred_supplier", "supplier_source", "unit_cost", "minimum_order_quantity", "pack_size", "effective_lead_time_days", "effective_max_wait_days", "minimum_order_amount", "shipping_cost", "free_shipping_threshold", "policy_configured", "policy_source", "supplier_score", "order_up_to_days", "recommended_quantity", "estimated_purchase_value")
PLAN = ("supplier_key", "supplier", "lines", "units", "estimated_value", "critical_lines", "high_lines", "policy_configured", "minimum_order_amount", "shipping_cost", "free_shipping_threshold", "decision", "amount_to_minimum", "next_review_date", "estimated_total_with_shipping", "supplier_score")

OPTION = (
    "product_key", "position", "supplier_key", "supplier", "is_modal", "confidence_pct", "purchase_lines", "average_unit_cost", "last_unit_cost", "last_purchase_date", "supplier_score",
    "is_preferred", "policy_source", "minimum_order_quantity", "pack_size", "lead_time_days", "max_wait_days", "minimum_order_amount", "shipping_cost", "free_shipping_threshold",
)


# Documents made of the typed rows, to be read back.


def _invoices_json(m) -> DataFrame:
    line = F.struct("line_number", F.struct((F.col("product_key") - 1).cast("string").alias("id"), F.lit("x").alias("name"), F.round(F.col("net_sales") / F.col("quantity"), 2).cast("string").alias("price"), F.col("quantity").cast("string").alias("quantity"), F.col("net_sales").cast("string").alias("total")).alias("i"))
    g = m.sales_lines.filter("document_type = 'invoice'").groupBy("tenant_id", "document_id").agg(F.min("date").alias("date"), F.min("document_status").alias("status"), F.min("contact_key").alias("c"), F.min("currency_code").alias("cur"), F.transform(F.sort_array(F.collect_list(line)), lambda x: x["i"]).alias("items"))
    return g.select("tenant_id", F.to_json(F.struct(F.col("document_id").alias("id"), F.col("date").cast("string").alias("date"), "status", F.struct(F.col("c").cast("string").alias("id"), F.lit("n").alias("name")).alias("client"), F.struct(F.col("cur").alias("code")).alias("currency"), "items")).alias("payload"))


def _bills_json(m) -> DataFrame:
    line = F.struct("line_number", F.struct((F.col("product_key") - 1).cast("string").alias("id"), F.lit("x").alias("name"), F.coalesce(F.col("unit_cost"), F.lit(0)).cast("string").alias("price"), F.col("quantity").cast("string").alias("quantity")).alias("i"))
    g = m.fact_purchases.groupBy("tenant_id", "document_id").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["i"]).alias("items"))
    return g.select("tenant_id", F.to_json(F.struct(F.col("document_id").alias("id"), F.struct("items").alias("purchases"))).alias("payload"))


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("double").alias(n) if n in names else F.col(n) for n in df.columns])


def _batch(m) -> DataFrame:
    """Events as versions of user documents, in order of event_id."""
    return m.events.select(F.lit("t1").alias("tenant_id"), F.lit("user").alias("resource"), F.col("user_id").cast("string").alias("external_id"), F.col("props").alias("payload"), F.sha2("props", 256).alias("payload_hash"), F.col("event_id").alias("seq"), F.col("ts").alias("received_at"))


def _current(m) -> DataFrame:
    empty = _batch(m).limit(0).select(*landing.KEY, "payload", "payload_hash", F.col("received_at").alias("first_seen_at"), F.col("received_at").alias("last_seen_at"), F.lit(False).alias("is_deleted"))
    return landing.upsert_current(landing.upsert_current(empty, _batch(m).filter("seq % 2 = 0")), _batch(m).filter("seq % 2 = 1"))


def _typed(m):
    """Typed tables as an import leaves them: documents, lines and natural keys."""
    lines = m.sales_lines.withColumn("item_id", (F.col("product_key") - 1).cast("string")).withColumn("total", F.abs("net_sales").cast("decimal(18,2)")).withColumn("quantity", F.abs("quantity").cast("decimal(18,4)"))
    head = lambda kind: lines.filter(F.col("document_type") == kind).groupBy("tenant_id", "document_id").agg(F.min("date").alias("date"), F.min("document_status").alias("status"), F.min("contact_key").cast("string").alias("client_id"), F.min("seller_key").cast("string").alias("seller_id"), F.min("warehouse_key").cast("string").alias("warehouse_id"), F.min(F.when(F.col("currency_code") != "COP", F.col("currency_code"))).alias("currency_code"), F.max("is_deleted").alias("is_deleted"))
    body = lambda kind: lines.filter(F.col("document_type") == kind).select("tenant_id", "document_id", "line_number", "item_id", "quantity", "total")
    keyed = lambda dim, key: dim.select("tenant_id", F.col(key).cast("string").alias("external_id"), key)
    return head("invoice").drop("warehouse_id"), body("invoice"), head("credit_note").drop("seller_id"), body("credit_note"), m.dim_product, keyed(m.dim_contact, "contact_key"), keyed(m.dim_seller, "seller_key"), keyed(m.dim_warehouse, "warehouse_key")


def _dim_upsert(m) -> DataFrame:
    """Two loads of the product dimension: every third product first, then all."""
    p = m.dim_product.select("tenant_id", "external_id", "name", F.col("product_key").alias("_k"))
    empty = p.limit(0).select("tenant_id", "external_id", "name", F.lit(0).cast("long").alias("product_key"))
    first = mart.upsert_dim(empty, p.filter("_k % 3 = 0").drop("_k"), "product_key")
    return mart.upsert_dim(first, p.drop("_k"), "product_key")


def _events(m) -> DataFrame:
    subject = F.expr("CASE event_type WHEN 'signup' THEN 'new-client' WHEN 'click' THEN 'edit-item' WHEN 'view' THEN 'edit-invoice' WHEN 'error' THEN 'delete-item' ELSE 'new-payment' END")
    entity = F.expr("CASE event_type WHEN 'signup' THEN 'client' WHEN 'click' THEN 'item' WHEN 'view' THEN 'invoice' WHEN 'error' THEN 'item' ELSE 'payment' END")
    message = F.concat(F.lit('{"'), entity, F.lit('":{"id":"'), F.col("user_id").cast("string"), F.lit('"}}'))
    rows = m.events.select(F.lit("t1").alias("tenant_id"), subject.alias("subject"), message.alias("message"), F.col("ts").alias("available_at"), F.timestamp_seconds(F.unix_timestamp("ts") + F.col("event_id") % 7).alias("created_at"), "event_id")
    return rows.unionByName(rows.filter("event_id % 20 = 0")).drop("event_id")


def stream_changes(m) -> DataFrame:
    """Events written as JSON files, read as a stream, and logged once each, batch by batch: rows of the event log."""
    spark, path = m.spark, shared_folder(m.spark, "changes")
    _events(m).repartition(4).write.json(f"{path}/in")
    log = f"{path}/log"
    changes.run_dedup(changes.read_events(spark, f"{path}/in", 2), log, f"{path}/checkpoint")
    return spark.read.option("basePath", log).parquet(f"{log}/epoch=*").select("tenant_id", "subject", "entity_type", "action", "external_id")


QUERIES = {
    "demand_windows": on(lambda m: r.demand_windows(m, YEAR)),
    "period_purchase_cost": on(lambda m: r.period_purchase_cost(m, YEAR)),
    "supplier_choices": on(lambda m: r.supplier_choices(_stats(m), _modes(m), m.dim_contact).select("product_key", "currency_code", F.explode("supplier_options").alias("o")).select("product_key", "currency_code", "o.choice_rank", "o.supplier_key", "o.supplier", "o.is_modal", "o.purchase_lines", "o.last_purchase_date")),
    "replenishment_candidates": on(lambda m: _candidates(m).select(*CANDIDATE)),
    "replenishment_queue": on(lambda m: _queue(m).select(*CANDIDATE[:1], "recommended_quantity", "unit_cost", "priority", "reason", "review_status")),
    "apply_policies": on(lambda m: _items(m).select(*ITEM)),
    "supplier_purchase_plans": on(lambda m: _plans(m).select(*PLAN)),
    "supplier_plan_lines": on(lambda m: r.plan_lines(_items(m)).select("supplier_key", "product_key", "name", "reference", "family", "quantity", "unit_cost", "estimated_value", "priority", "coverage_days", "supplier_source")),
    "supplier_options": on(lambda m: r.supplier_options(_items(m), m.supplier_policies, m.product_policies).select(*OPTION)),
    "replenishment_summary": on(lambda m: r.replenishment_summary(_items(m), _plans(m))),
    "queue_summary_by_priority": on(lambda m: r.queue_by_priority(_items(m))),
    "queue_by_supplier": on(lambda m: r.queue_by_supplier(_items(m))),
    "policies_supplier": on(lambda m: r.policy_overview(_stats(m), m.supplier_policies, m.dim_contact)),
    "policies_product": on(lambda m: r.product_policy_overview(m.product_policies, m.dim_product, m.dim_contact).select("product_key", "supplier_key", "product", "supplier", "minimum_order_quantity", "pack_size", "is_preferred")),
    "norm_invoice_header": on(lambda m: docs.invoice_headers(_invoices_json(m)).select("document_id", "date", "status", "client_id", "client_name", "currency_code")),
    "norm_invoice_lines": on(lambda m: _doubles(docs.invoice_lines(_invoices_json(m)).select("document_id", "line_number", "item_id", "name", "quantity", "total"), "quantity", "total")),
    "norm_document_lines": on(lambda m: _doubles(docs.document_lines(_bills_json(m)).select("document_id", "line_number", "item_id", "price", "quantity", "total"), "price", "quantity", "total")),
    "dedup_batch_last_wins": on(lambda m: landing.last_of_batch(_batch(m)).select("external_id", "payload", "seq")),
    "raw_versions": on(lambda m: landing.new_versions(_batch(m).filter("seq % 2 = 1"), landing.last_of_batch(_batch(m).filter("seq % 2 = 0"))).select("external_id", "payload", "seq")),
    "upsert_current": on(lambda m: _current(m).select("external_id", "payload", "first_seen_at", "last_seen_at", "is_deleted")),
    "soft_delete": on(lambda m: landing.soft_delete(_current(m), _batch(m).filter("seq % 9 = 0")).groupBy("is_deleted").agg(F.count("*").alias("documents"))),
    "retry_schedule": on(lambda m: landing.retry_schedule(m.events.filter("event_type = 'error'").select("event_id", (F.col("event_id") % 10).cast("int").alias("attempts"), F.col("ts").alias("failed_at"))).select("event_id", "attempts", "status", "available_at")),
    "sync_state": on(lambda m: landing.sync_state(m.events.select(F.lit("t1").alias("tenant_id"), F.col("event_type").alias("resource"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("succeeded").alias("status"), F.col("ts").alias("finished_at"), F.col("event_id").cast("string").alias("error"))).drop("last_error")),
    "dim_date": on(lambda m: mart.dim_date(m.sales_lines, m.fact_purchases, m.fact_payments, m.adjustment_lines, m.transfer_lines)),
    "dim_product_upsert": on(_dim_upsert),
    "fact_sales_line": on(lambda m: _doubles(mart.fact_sales(*_typed(m)), "quantity", "net_sales")),
    "parse_change_events": on(lambda m: changes.first_seen(changes.parse_events(_events(m))).select("tenant_id", "subject", "entity_type", "action", "external_id")),
    "dedup_change_events": on(stream_changes),
}

STATS = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY product_key, currency_code ORDER BY average_cost, units DESC, last_purchase_date DESC NULLS LAST, supplier_key) AS INT) AS cost_rank,
    round(CAST(line_count AS DOUBLE) / sum(line_count) OVER (PARTITION BY product_key, currency_code) * 100, 6) AS line_share_pct FROM (
  SELECT product_key, provider_key AS supplier_key, currency_code, count(*) AS line_count, CAST(sum(quantity) AS DOUBLE) AS units, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount, max(date) AS last_purchase_date,
    CAST(arg_max(unit_cost, (date, document_id, line_number)) FILTER (WHERE unit_cost IS NOT NULL) AS DOUBLE) AS last_cost, coalesce(CAST(coalesce(sum(amount), 0) AS DOUBLE) / nullif(CAST(sum(quantity) AS DOUBLE), 0), 0) AS average_cost
  FROM fact_purchases WHERE NOT is_deleted AND product_key IS NOT NULL AND quantity > 0 GROUP BY 1, 2, 3) x)"""
CHOICES = f"""stats AS {STATS}, modes AS ({MODES}),
  choices AS (SELECT * FROM (SELECT s.*, c.name AS supplier, coalesce(s.supplier_key = m.supplier_key, false) AS is_modal, CAST(row_number() OVER (PARTITION BY s.product_key, s.currency_code ORDER BY coalesce(s.supplier_key = m.supplier_key, false) DESC, s.last_purchase_date DESC NULLS LAST, cost_rank, s.supplier_key) AS INT) AS choice_rank
    FROM stats s LEFT JOIN modes m ON s.product_key = m.product_key LEFT JOIN dim_contact c ON s.supplier_key = c.contact_key) x WHERE choice_rank <= 3)"""
WINDOWS = f"SELECT product_key, CAST(sum(quantity) AS DOUBLE) AS units_selected, CAST(coalesce(sum(quantity) FILTER (WHERE date >= DATE '2001-07-25'), 0) AS DOUBLE) AS units_7d, CAST(coalesce(sum(quantity) FILTER (WHERE date >= DATE '2001-07-02'), 0) AS DOUBLE) AS units_30d, CAST(coalesce(sum(quantity) FILTER (WHERE date >= DATE '2001-05-03'), 0) AS DOUBLE) AS units_90d FROM fact_sales f WHERE {period(YEAR)} AND product_key IS NOT NULL GROUP BY 1"
PERIOD_COST = f"SELECT product_key, CAST(sum(amount) AS DOUBLE) / nullif(CAST(sum(quantity) AS DOUBLE), 0) AS average_unit_cost FROM fact_purchases f WHERE {period(YEAR)} AND currency_code = 'COP' AND product_key IS NOT NULL AND quantity > 0 GROUP BY 1"
D = YEAR.days
CAND = f"""{CHOICES}, demand AS ({WINDOWS}), pc AS ({PERIOD_COST}),
  stock AS (SELECT product_key, CAST(sum(quantity) AS DOUBLE) AS q FROM fact_snapshots WHERE run_id = '2' GROUP BY 1),
  cand AS (SELECT p.product_key, p.name, reference, family_name AS family, coalesce(q, 0) AS quantity_on_hand, greatest(units_selected, 0) AS units_sold, greatest(units_7d, 0) AS units_7d, greatest(units_30d, 0) AS units_30d, greatest(units_90d, 0) AS units_90d,
    greatest(units_selected, 0) / {D} AS daily_velocity, CASE WHEN units_selected > 0 THEN coalesce(q, 0) * {D} / units_selected END AS coverage_days, coalesce(pc.average_unit_cost, c.average_cost, CAST(current_cost AS DOUBLE), 0) AS unit_cost, c.supplier_key, coalesce(c.supplier, preferred_supplier_name) AS preferred_supplier,
    CASE WHEN c.supplier IS NOT NULL THEN 'historial_modal' WHEN preferred_supplier_name IS NOT NULL THEN 'catalogo_actual' ELSE 'sin_historial' END AS supplier_source, ceil(greatest(greatest(units_selected, 0) * {TARGET} / {D} - coalesce(q, 0), 0)) AS recommended_quantity, coalesce(c.line_share_pct, 0) AS conf
    FROM dim_product p JOIN demand d ON p.product_key = d.product_key LEFT JOIN stock s ON p.product_key = s.product_key LEFT JOIN pc ON p.product_key = pc.product_key LEFT JOIN choices c ON p.product_key = c.product_key AND c.currency_code = 'COP' AND choice_rank = 1
    WHERE NOT p.is_deleted AND (s.product_key IS NOT NULL OR inventory_enabled)),
  que AS (SELECT c.*, CASE WHEN quantity_on_hand <= 0 THEN 'critical' WHEN coverage_days < 14 THEN 'high' ELSE 'medium' END AS priority, CASE WHEN quantity_on_hand <= 0 THEN 1 WHEN coverage_days < 14 THEN 2 ELSE 3 END AS queue_rank,
    CASE WHEN quantity_on_hand <= 0 THEN 'Agotado con demanda reciente' WHEN preferred_supplier IS NULL THEN 'Reponer y validar proveedor antes de comprar' WHEN coverage_days < 14 THEN 'La cobertura no alcanza el plazo de compra y seguridad' ELSE 'La cobertura está por debajo del objetivo' END AS reason,
    coalesce(a.status, 'pending') AS review_status, round(recommended_quantity * unit_cost, 4) AS queue_value FROM cand c LEFT JOIN review_actions a ON c.product_key = a.product_key WHERE recommended_quantity > 0)"""
ITEMS = f"""{CAND},
  pref AS (SELECT w.product_key, w.supplier_key, c.name, s.line_share_pct, s.last_cost, s.average_cost FROM product_policies w JOIN stats s ON w.product_key = s.product_key AND w.supplier_key = s.supplier_key AND w.currency_code = s.currency_code JOIN dim_contact c ON w.supplier_key = c.contact_key WHERE is_preferred AND w.currency_code = 'COP'),
  sw AS (SELECT q.product_key, priority, queue_rank, queue_value, daily_velocity, quantity_on_hand, review_status, w.supplier_key IS NOT NULL AS chosen, coalesce(w.supplier_key, q.supplier_key) AS supplier_key, CASE WHEN w.supplier_key IS NOT NULL THEN w.name ELSE preferred_supplier END AS preferred_supplier, CASE WHEN w.supplier_key IS NOT NULL THEN 'politica_producto' ELSE supplier_source END AS supplier_source,
    CASE WHEN w.supplier_key IS NOT NULL THEN coalesce(nullif(w.last_cost, 0), nullif(w.average_cost, 0), nullif(unit_cost, 0), 0) ELSE unit_cost END AS unit_cost, conf FROM que q LEFT JOIN pref w ON q.product_key = w.product_key),
  trm AS (SELECT sw.*, p.minimum_order_quantity, CASE WHEN p.supplier_key IS NOT NULL THEN p.pack_size ELSE 1 END AS pack_size, CAST(coalesce(nullif(coalesce(p.lead_time_days, s.default_lead_time_days), 0), 7) AS INT) AS effective_lead_time_days, CAST(coalesce(nullif(coalesce(p.max_wait_days, s.max_wait_days), 0), 7) AS INT) AS effective_max_wait_days,
    s.minimum_order_amount, coalesce(s.shipping_cost, 0) AS shipping_cost, s.free_shipping_threshold, s.supplier_key IS NOT NULL OR p.supplier_key IS NOT NULL AS policy_configured, CASE WHEN p.supplier_key IS NOT NULL THEN 'producto' WHEN s.supplier_key IS NOT NULL THEN 'proveedor' ELSE 'estandar' END AS policy_source,
    CASE WHEN NOT chosen THEN coalesce(least(100.0, o.line_share_pct * 0.45 + CASE WHEN o.last_purchase_date IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN o.line_count >= 3 THEN 15 ELSE 0 END + CASE WHEN o.is_modal THEN 15 ELSE 0 END), conf) END AS supplier_score
    FROM sw LEFT JOIN supplier_policies s ON sw.supplier_key = s.supplier_key LEFT JOIN product_policies p ON sw.supplier_key = p.supplier_key AND sw.product_key = p.product_key LEFT JOIN choices o ON sw.product_key = o.product_key AND o.currency_code = 'COP' AND sw.supplier_key = o.supplier_key),
  items AS (SELECT *, recommended_quantity * unit_cost AS estimated_purchase_value FROM (SELECT *, {TARGET + 7} + effective_lead_time_days AS order_up_to_days, CASE WHEN round(greatest(daily_velocity * ({TARGET + 7} + effective_lead_time_days) - quantity_on_hand, 0), 9) > 0
    THEN ceil(round(greatest(greatest(daily_velocity * ({TARGET + 7} + effective_lead_time_days) - quantity_on_hand, 0), coalesce(minimum_order_quantity, 0)) / coalesce(nullif(pack_size, 0), 1), 9)) * coalesce(nullif(pack_size, 0), 1) ELSE 0 END AS recommended_quantity FROM trm))"""
PLANS = f"""{ITEMS},
  grp AS (SELECT supplier_key, count(*) AS lines, sum(recommended_quantity) AS units, round(sum(estimated_purchase_value), 4) AS estimated_value, count(*) FILTER (WHERE priority = 'critical') AS critical_lines, count(*) FILTER (WHERE priority = 'high') AS high_lines, bool_or(policy_configured) AS policy_configured, round(sum(coalesce(supplier_score, 0)) / count(*), 6) AS supplier_score,
    arg_min(coalesce(preferred_supplier, 'Sin proveedor'), (queue_rank, -coalesce(queue_value, 0), product_key)) AS supplier, min(minimum_order_amount) AS minimum_order_amount, min(shipping_cost) AS shipping_cost, min(free_shipping_threshold) AS free_shipping_threshold, arg_min(effective_max_wait_days, (queue_rank, -coalesce(queue_value, 0), product_key)) AS wait FROM items WHERE recommended_quantity > 0 GROUP BY 1),
  plans AS (SELECT *, CASE WHEN supplier_key IS NULL THEN 'review' WHEN critical_lines > 0 THEN 'buy_now' WHEN coalesce(minimum_order_amount, 0) > 0 AND estimated_value >= minimum_order_amount THEN 'buy_now' WHEN free_shipping_threshold > 0 AND estimated_value >= free_shipping_threshold THEN 'complete_order' WHEN NOT policy_configured THEN 'review' ELSE 'accumulate' END AS decision,
    greatest(coalesce(minimum_order_amount, 0) - estimated_value, 0) AS amount_to_minimum, DATE '{AS_OF}' + wait AS next_review_date, estimated_value + shipping_cost AS estimated_total_with_shipping FROM grp)"""
BATCH = "SELECT CAST(user_id AS VARCHAR) AS external_id, props AS payload, event_id AS seq, ts FROM events"
EVENTS = "SELECT DISTINCT 't1' AS tenant_id, subject, CASE WHEN event_type = 'signup' THEN 'client' WHEN event_type = 'view' THEN 'invoice' ELSE 'item' END AS entity_type, split_part(subject, '-', 1) AS action, CAST(user_id AS VARCHAR) AS external_id FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'new-client' WHEN 'click' THEN 'edit-item' WHEN 'view' THEN 'edit-invoice' WHEN 'error' THEN 'delete-item' END AS subject FROM events WHERE event_type IN ('signup', 'click', 'view', 'error'))"
RAW_SQL = {
    "demand_windows": WINDOWS,
    "period_purchase_cost": PERIOD_COST,
    "supplier_choices": f"WITH {CHOICES} SELECT product_key, currency_code, choice_rank, supplier_key, supplier, is_modal, line_count AS purchase_lines, last_purchase_date FROM choices",
    "replenishment_candidates": f"WITH {CAND} SELECT {', '.join(CANDIDATE)} FROM cand",
    "replenishment_queue": f"WITH {CAND} SELECT product_key, recommended_quantity, unit_cost, priority, reason, review_status FROM que ORDER BY queue_rank, queue_value DESC NULLS LAST, product_key LIMIT 100",
    "apply_policies": f"WITH {ITEMS} SELECT {', '.join(ITEM)} FROM items",
    "supplier_plan_lines": f"WITH {ITEMS} SELECT i.supplier_key, i.product_key, q.name, q.reference, q.family, i.recommended_quantity AS quantity, i.unit_cost, i.estimated_purchase_value AS estimated_value, i.priority, q.coverage_days, i.supplier_source FROM items i JOIN que q ON i.product_key = q.product_key WHERE i.recommended_quantity > 0",
    "supplier_options": f"""WITH {ITEMS},
      opt AS (SELECT o.product_key, o.choice_rank AS nth, o.supplier_key, o.supplier, o.is_modal, o.line_share_pct AS confidence_pct, o.line_count AS purchase_lines, o.average_cost AS average_unit_cost, o.last_cost AS last_unit_cost, o.last_purchase_date,
          least(100.0, o.line_share_pct * 0.45 + CASE WHEN o.last_purchase_date IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN o.line_count >= 3 THEN 15 ELSE 0 END + CASE WHEN o.is_modal THEN 15 ELSE 0 END) AS supplier_score, false AS taken
        FROM choices o JOIN items i ON o.product_key = i.product_key AND o.currency_code = 'COP' WHERE NOT (i.chosen AND i.supplier_key = o.supplier_key)
        UNION ALL SELECT i.product_key, 0, i.supplier_key, i.preferred_supplier, false, s.line_share_pct, s.line_count, s.average_cost, s.last_cost, s.last_purchase_date, NULL, true FROM items i JOIN stats s ON i.product_key = s.product_key AND i.supplier_key = s.supplier_key AND s.currency_code = 'COP' WHERE i.chosen),
      pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_key ORDER BY nth, supplier_key) AS INT) AS position FROM opt)
      SELECT o.product_key, position, o.supplier_key, supplier, is_modal, confidence_pct, purchase_lines, average_unit_cost, last_unit_cost, last_purchase_date, supplier_score, taken OR coalesce(p.is_preferred, false) AS is_preferred,
        CASE WHEN NOT taken THEN CASE WHEN p.supplier_key IS NOT NULL THEN 'producto' WHEN s.supplier_key IS NOT NULL THEN 'proveedor' ELSE 'estandar' END END AS policy_source, CASE WHEN NOT taken THEN p.minimum_order_quantity END AS minimum_order_quantity,
        CASE WHEN NOT taken THEN CASE WHEN p.supplier_key IS NOT NULL THEN p.pack_size ELSE 1 END END AS pack_size, CASE WHEN NOT taken THEN coalesce(p.lead_time_days, s.default_lead_time_days) END AS lead_time_days, CASE WHEN NOT taken THEN coalesce(p.max_wait_days, s.max_wait_days) END AS max_wait_days,
        CASE WHEN NOT taken THEN s.minimum_order_amount END AS minimum_order_amount, CASE WHEN NOT taken THEN coalesce(s.shipping_cost, 0) END AS shipping_cost, CASE WHEN NOT taken THEN s.free_shipping_threshold END AS free_shipping_threshold
      FROM pos o LEFT JOIN supplier_policies s ON o.supplier_key = s.supplier_key LEFT JOIN product_policies p ON o.supplier_key = p.supplier_key AND o.product_key = p.product_key WHERE position <= 3""",
    "supplier_purchase_plans": f"WITH {PLANS} SELECT {', '.join(PLAN)} FROM plans",
    "replenishment_summary": f"WITH {PLANS} SELECT * FROM (SELECT count(*) AS recommended_products, count(*) FILTER (WHERE priority = 'critical') AS critical_products, round(coalesce(sum(estimated_purchase_value), 0), 4) AS estimated_value FROM items), (SELECT count(*) FILTER (WHERE decision IN ('buy_now', 'complete_order')) AS suppliers_to_buy, count(*) FILTER (WHERE decision = 'accumulate') AS suppliers_to_accumulate, count(*) FILTER (WHERE decision = 'review') AS suppliers_to_review FROM plans)",
    "queue_summary_by_priority": f"WITH {ITEMS} SELECT priority, count(*) AS products, count(*) FILTER (WHERE preferred_supplier IS NULL) AS without_supplier, round(sum(estimated_purchase_value), 4) AS estimated_value FROM items GROUP BY 1",
    "queue_by_supplier": f"WITH {ITEMS} SELECT coalesce(preferred_supplier, 'Sin proveedor') AS supplier, review_status, count(*) AS products, round(sum(estimated_purchase_value), 4) AS estimated_value FROM items GROUP BY 1, 2",
    "policies_supplier": f"WITH stats AS {STATS} SELECT h.supplier_key, products, historic_amount, c.name AS supplier, minimum_order_amount, shipping_cost, free_shipping_threshold, default_lead_time_days, max_wait_days, p.supplier_key IS NOT NULL AS configured FROM (SELECT supplier_key, count(DISTINCT product_key) AS products, round(sum(amount), 2) AS historic_amount FROM stats WHERE currency_code = 'COP' GROUP BY 1) h JOIN dim_contact c ON h.supplier_key = c.contact_key LEFT JOIN supplier_policies p ON h.supplier_key = p.supplier_key ORDER BY historic_amount DESC, h.supplier_key LIMIT 500",
    "policies_product": "SELECT w.product_key, w.supplier_key, p.name AS product, c.name AS supplier, minimum_order_quantity, pack_size, is_preferred FROM product_policies w JOIN dim_product p ON w.product_key = p.product_key JOIN dim_contact c ON w.supplier_key = c.contact_key WHERE NOT p.is_deleted ORDER BY product, supplier, w.product_key, w.supplier_key LIMIT 2000",
    "norm_invoice_header": "SELECT document_id, min(date) AS date, min(document_status) AS status, CAST(min(contact_key) AS VARCHAR) AS client_id, 'n' AS client_name, min(currency_code) AS currency_code FROM sales_lines WHERE document_type = 'invoice' GROUP BY 1",
    "norm_invoice_lines": "SELECT document_id, line_number, CAST(product_key - 1 AS VARCHAR) AS item_id, 'x' AS name, CAST(quantity AS DOUBLE) AS quantity, CAST(net_sales AS DOUBLE) AS total FROM sales_lines WHERE document_type = 'invoice'",
    "norm_document_lines": "SELECT document_id, line_number, CAST(product_key - 1 AS VARCHAR) AS item_id, CAST(coalesce(unit_cost, 0) AS DOUBLE) AS price, CAST(quantity AS DOUBLE) AS quantity, CAST(round(coalesce(unit_cost, 0) * quantity, 2) AS DOUBLE) AS total FROM fact_purchases",
    "dedup_batch_last_wins": f"SELECT external_id, payload, seq FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY seq DESC) AS n FROM ({BATCH})) WHERE n = 1",
    "raw_versions": f"WITH b AS ({BATCH}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY seq DESC) AS n FROM b WHERE seq % 2 = 1) WHERE n = 1), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY seq DESC) AS n FROM b WHERE seq % 2 = 0) WHERE n = 1) SELECT external_id, payload, seq FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.external_id = o.external_id AND e.payload = o.payload)",
    "upsert_current": f"""WITH b AS ({BATCH}), x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_id, seq % 2 ORDER BY seq DESC) AS n FROM b) WHERE n = 1)
        SELECT external_id, arg_max(payload, seq % 2) AS payload, min(ts) AS first_seen_at, max(ts) AS last_seen_at, false AS is_deleted FROM x GROUP BY 1""",
    "soft_delete": f"WITH b AS ({BATCH}) SELECT is_deleted, count(*) AS documents FROM (SELECT external_id, bool_or(seq % 9 = 0) AS is_deleted FROM b GROUP BY 1) GROUP BY 1",
    "retry_schedule": "SELECT event_id, CAST(event_id % 10 AS INT) AS attempts, CASE WHEN event_id % 10 >= 8 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN event_id % 10 < 8 THEN date_trunc('second', ts) + to_seconds(CAST(pow(2, event_id % 10) AS INT)) END AS available_at FROM events WHERE event_type = 'error'",
    "sync_state": "SELECT 't1' AS tenant_id, event_type AS resource, max(ts) FILTER (WHERE event_id % 4 <> 0) AS last_success_at, max(ts) FILTER (WHERE event_id % 4 = 0) AS last_error_at FROM events GROUP BY 2",
    "dim_date": "SELECT CAST(strftime(date, '%Y%m%d') AS INT) AS date_key, date, CAST(year(date) AS INT) AS year, CAST(quarter(date) AS INT) AS quarter, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day, CAST(weekofyear(date) AS INT) AS iso_week, CAST(isodow(date) AS INT) AS iso_weekday, isodow(date) >= 6 AS is_weekend FROM (SELECT date FROM sales_lines UNION SELECT date FROM fact_purchases UNION SELECT date FROM fact_payments UNION SELECT date FROM adjustment_lines UNION SELECT date FROM transfer_lines)",
    "dim_product_upsert": "SELECT tenant_id, external_id, name, CAST(CASE WHEN product_key % 3 = 0 THEN row_number() OVER (PARTITION BY product_key % 3 = 0 ORDER BY external_id) ELSE (SELECT count(*) FROM dim_product WHERE product_key % 3 = 0) + row_number() OVER (PARTITION BY product_key % 3 = 0 ORDER BY external_id) END AS BIGINT) AS product_key FROM dim_product",
    "fact_sales_line": "SELECT tenant_id, document_id, document_type, line_number, date, document_status, currency_code, CAST(quantity AS DOUBLE) AS quantity, CAST(net_sales AS DOUBLE) AS net_sales, is_deleted, product_key, contact_key, seller_key, warehouse_key FROM sales_lines",
    "parse_change_events": EVENTS,
    "dedup_change_events": EVENTS,
}
SQL = {k: with_fixtures(v) for k, v in RAW_SQL.items()}
