"""Projections, landing of typed tables and star-schema jobs over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions.cols import json_at, normalized_text, text_of
from martloom.operators import costing, landing, lookups, mart, refresh, replenish
from martloom.operators import purchases as buy
from martloom.plans import flow_queries
from martloom.plans.cost_queries import CLASSIFIED, CUTOFF, WHOLE, _layers
from martloom.plans.fixtures import keep, with_fixtures
from martloom.plans.flow_queries import _bills_json, _doubles, _events, _typed
from martloom.plans.reports import on
from martloom.sources import documents as docs
from martloom.sources.buckets import merge_buckets, read_buckets, write_buckets
from martloom.sources.sinks import shared_folder, stored
from martloom.streaming import changes

AS_OF, DAYS = date(2024, 1, 31), 20


def _payload(df: DataFrame, **fields) -> DataFrame:
    return df.select("tenant_id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload"))


def _text(name: str):
    return F.col(name).cast("string")


def _items_json(m) -> DataFrame:
    field = lambda label, c: F.struct(F.lit(label).alias("label"), c.alias("value"))
    fields = F.array(field("FAMILIA", F.col("family_name")), field("PROVEEDOR", F.col("preferred_supplier_name")))
    stock = F.struct(F.when(F.col("inventory_enabled"), "true").otherwise("false").alias("enabled"), _text("current_cost").alias("unitCost"))
    return _payload(m.dim_product, id=F.col("external_id"), name=F.col("name"), reference=F.col("reference"), type=F.col("item_type"), inventory=stock, customFields=fields)


def _contacts_json(m) -> DataFrame:
    return _payload(m.dim_contact, id=_text("contact_key"), name=F.struct(F.col("name").alias("firstName")), type=F.array("contact_type"))


def _payments_json(m) -> DataFrame:
    who = F.struct(_text("contact_key").alias("id"))
    return _payload(m.fact_payments, id=F.col("payment_id"), date=_text("date"), client=who, type=F.col("payment_type"), currency=F.struct(F.col("currency_code").alias("code")), amount=_text("amount"))


def _notes_json(m) -> DataFrame:
    heads = m.sales_lines.filter("document_type = 'credit_note'").groupBy("tenant_id", "document_id").agg(
        F.min("date").alias("date"), F.min("contact_key").alias("c"), F.min("warehouse_key").alias("w"), F.min("document_status").alias("s"))
    one = lambda c: F.struct(_text(c).alias("id"))
    return _payload(heads, id=F.col("document_id"), date=_text("date"), client=one("c"), warehouse=one("w"), status=F.col("s"), number=F.concat(F.lit("N"), F.col("document_id")))


def _bill_heads_json(m) -> DataFrame:
    heads = m.fact_purchases.groupBy("tenant_id", "document_id").agg(F.min("date").alias("date"), F.min("provider_key").alias("p"), F.min("document_status").alias("s"))
    who = F.struct(_text("p").alias("id"), F.lit("n").alias("name"))
    return _payload(heads, id=F.col("document_id"), date=_text("date"), provider=who, status=F.col("s"), numberTemplate=F.struct(F.col("document_id").alias("fullNumber")))


def _snapshots_raw(m) -> DataFrame:
    rows = m.fact_snapshots.filter("run_id <> '3'")
    stock = F.struct(F.when(F.col("product_key") % 13 != 0, _text("quantity")).alias("availableQuantity"), _text("unit_cost").alias("unitCost"))
    payload = F.to_json(F.struct(_text("product_key").alias("id"), F.lit("x").alias("name"), stock.alias("inventory")))
    return rows.select("run_id", _text("warehouse_key").alias("warehouse_id"), F.col("product_key").alias("seq"), payload.alias("payload"))


def _old_lines(m) -> DataFrame:
    """Lines as they were before: of every document, with other totals."""
    return docs.document_lines(_bills_json(m)).withColumn("total", F.lit(0).cast("decimal(18,2)"))


def _line_batches(m) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = m.fact_purchases.select("tenant_id", "document_id", "line_number", _text("product_key").alias("item_id"), F.col("quantity").cast("double").alias("quantity"))
    batch = lines.filter("line_number = 1").withColumn("quantity", F.col("quantity") + 1000)
    ids = lines.select("tenant_id", "document_id").distinct().withColumn("has_items", F.length("document_id") % 2 == 0)
    of_batch = batch.join(ids.filter("has_items").select("tenant_id", "document_id"), ["tenant_id", "document_id"])
    return lines, of_batch, ids


def _replaced(m) -> DataFrame:
    return landing.replace_lines(*_line_batches(m))


def _projection(m) -> DataFrame:
    typed = m.dim_product.select("tenant_id", "external_id", "name")
    fresh = typed.filter("cast(external_id as long) % 7 = 0").withColumn("name", F.concat("name", F.lit(" new")))
    return landing.upsert_projection(typed, fresh, ["tenant_id", "external_id"])


def _documents(m, kind: str) -> DataFrame:
    """User documents of one event type: the current state, and what an extract brings."""
    e = m.events.filter(F.col("event_type") == kind)
    return e.select(
        F.lit("t1").alias("tenant_id"), F.lit("user").alias("resource"), _text("user_id").alias("external_id"), F.col("props").alias("payload"), F.sha2("props", 256).alias("payload_hash"),
        F.col("event_id").alias("seq"), F.col("ts").alias("received_at"), F.to_date("ts").alias("date"))


def _state(batch: DataFrame) -> DataFrame:
    empty = batch.limit(0).select(*landing.KEY, "payload", "payload_hash", F.col("received_at").alias("first_seen_at"), F.col("received_at").alias("last_seen_at"), F.lit(False).alias("is_deleted"))
    return landing.upsert_current(empty, batch)


def _reconciled(m) -> tuple[DataFrame, DataFrame]:
    return landing.reconcile(_state(_documents(m, "view").drop("date")), _documents(m, "click"), AS_OF, DAYS)


def _applied(m) -> DataFrame:
    """Client events applied to users: a sign-up saves the user's document, an error's event deletes it."""
    events = changes.first_seen(changes.parse_events(_events(m).withColumn("subject", F.when(F.col("subject") == "delete-item", "delete-client").otherwise(F.col("subject")))
                                                     .withColumn("message", F.regexp_replace("message", '^."item"', '{"client"')))).filter("entity_type = 'client'")
    users = m.events.select(F.lit("t1").alias("tenant_id"), F.lit("client").alias("resource"), _text("user_id").alias("external_id")).distinct()
    documents = users.withColumn("payload", F.concat(F.lit("p"), F.col("external_id"))).withColumn("payload_hash", F.sha2("external_id", 256))
    none = documents.limit(0).select(*landing.KEY, "payload", "payload_hash", F.lit(None).cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("last_seen_at"), F.lit(False).alias("is_deleted"))
    return changes.apply_events(none, events, documents)


def _keyed(dim: DataFrame, key: str) -> DataFrame:
    return dim.select("tenant_id", _text(key).alias("external_id"), key)


def _bill_tables(m) -> tuple[DataFrame, DataFrame]:
    p = m.fact_purchases
    heads = p.groupBy("tenant_id", "document_id").agg(F.min("date").alias("date"), F.min("document_status").alias("status"), F.min(_text("provider_key")).alias("provider_id"),
                                                      F.min(F.when(F.col("currency_code") != "COP", F.col("currency_code"))).alias("currency_code"), F.max("is_deleted").alias("is_deleted"))
    lines = p.select("tenant_id", "document_id", "line_number", (F.col("product_key") - 1).cast("string").alias("item_id"), "quantity", F.col("unit_cost").alias("price"), F.col("amount").alias("total"))
    return heads, lines


def _fact_purchases(m) -> DataFrame:
    return mart.fact_purchases(*_bill_tables(m), m.dim_product, _keyed(m.dim_contact, "contact_key"))


def _payment_rows(m) -> DataFrame:
    return m.fact_payments.withColumn("contact_id", _text("contact_key")).drop("contact_key").withColumn("currency_code", F.nullif("currency_code", F.lit("COP")))


def _fact_payments(m) -> DataFrame:
    return mart.fact_payments(_payment_rows(m), _keyed(m.dim_contact, "contact_key"))


def _snapshot_rows(m) -> DataFrame:
    return m.fact_snapshots.select("tenant_id", "run_id", (F.col("product_key") - 1).cast("string").alias("item_id"), _text("warehouse_key").alias("warehouse_id"), "quantity", "unit_cost")


def _fact_snapshots(m) -> DataFrame:
    return mart.fact_snapshots(_snapshot_rows(m), m.dim_product, _keyed(m.dim_warehouse, "warehouse_key"))


def _contact_upsert(m) -> DataFrame:
    rows = m.dim_contact.select("tenant_id", _text("contact_key").alias("external_id"), "name")
    return mart.upsert_dim(rows.limit(0).withColumn("key", F.lit(0).cast("long")), rows, "key")


def _tenants(m) -> DataFrame:
    return mart.dim_tenant(m.region.select(_text("r_regionkey").alias("tenant_id"), F.lower("r_name").alias("slug"), F.col("r_name").alias("name"), F.lit(1).alias("other")))


def _accents(m) -> DataFrame:
    """Customers' names with accents, full-width digits and ß; normalising them gives the plain names."""
    odd = F.translate(F.upper("c_name"), "CUSTOMER0123456789", "ĆÜŠŤÔḾÈŘ０１２３４５６７８９")
    return m.customer.select("c_custkey", normalized_text(F.concat(F.lit("  Straße   "), odd)).alias("plain"))


def sources(m) -> dict[str, DataFrame]:
    """The typed tables that a refresh reads."""
    names = ("invoices", "invoice_lines", "credit_notes", "credit_note_lines", "items", "contacts", "sellers", "warehouses")
    item = (F.col("product_key") - 1).cast("string").alias("item_id")
    line = ["tenant_id", "document_id", "line_number", "date", "quantity", "is_deleted"]
    bills, bill_lines = _bill_tables(m)
    return dict(zip(names, _typed(m), strict=True)) | {
        "tenants": m.dim_warehouse.select("tenant_id", F.lit("t").alias("slug"), F.lit("T").alias("name")).distinct(),
        "bills": bills, "bill_lines": bill_lines, "payments": _payment_rows(m), "snapshot_rows": _snapshot_rows(m),
        "adjustment_lines": m.adjustment_lines.select(*line, item, _text("warehouse_key").alias("warehouse_id")),
        "transfer_lines": m.transfer_lines.select(*line, item, _text("source_key").alias("source_id"), _text("destination_key").alias("destination_id")),
        "opening_report": m.opening_report.withColumn("tenant_id", F.lit("t1")),
    }


def _refreshed(m) -> str:
    """The folder of a mart after a first load and a refresh."""
    path = shared_folder(m.spark, "mart")
    keep(m, "sales_lines", "fact_purchases")
    tables = sources(m)
    tables |= {n: stored(tables[n]) for n in ("invoices", "credit_notes", "bills")}
    for hour, run in enumerate(("first", "second")):
        refresh.refresh(m.spark, path, "t1", run, tables, CUTOFF, lambda h=hour: datetime(2024, 1, 1, h))
    return path


MART_TABLES = ("dim_product", "dim_contact", "dim_seller", "dim_warehouse", "dim_date", "fact_purchases", "fact_payments", "fact_snapshots", "fact_movements", "fact_sales", "cost_layers")


def _mart_rows(m) -> DataFrame:
    """Rows of each published table."""
    path = _refreshed(m)
    return reduce(DataFrame.unionByName, [refresh.published(m.spark, path, n).groupBy(F.lit(n).alias("name")).agg(F.count("*").alias("rows")) for n in MART_TABLES])


def _mart_sales(m) -> DataFrame:
    """The published sales facts with their costs."""
    rows = refresh.published(m.spark, _refreshed(m), "fact_sales")
    numbers = ("quantity", "net_sales", "cogs", "margin")
    return _doubles(rows.select("document_type", "document_id", "line_number", "date", "currency_code", "is_deleted", "cost_status", "cost_method", *numbers), *numbers)


def _upserted(m) -> DataFrame:
    """Users' documents in buckets: half of the events, then the other half merged into the buckets that it touches."""
    path, batch = shared_folder(m.spark, "current"), flow_queries._batch(m)
    write_buckets(_state(batch.filter("seq % 2 = 0")), path, landing.KEY, 16)
    rest = batch.filter("seq % 2 = 1")
    merge_buckets(m.spark, path, landing.KEY, 16, rest, lambda old: landing.upsert_current(old, rest))
    return read_buckets(m.spark, path).select("external_id", "payload", "first_seen_at", "last_seen_at", "is_deleted")


def _lines_in_buckets(m) -> DataFrame:
    """replace_document_lines over lines in buckets of their document."""
    path, key = shared_folder(m.spark, "lines"), ["tenant_id", "document_id"]
    lines, of_batch, ids = _line_batches(m)
    write_buckets(lines, path, key, 16)
    merge_buckets(m.spark, path, key, 16, ids, lambda old: landing.replace_lines(old, of_batch, ids))
    return read_buckets(m.spark, path).select("document_id", "line_number", "item_id", "quantity")


#: Documents of a page of an export.
PAGE = 20_000


def _as_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's payloads as the lines of pages, each a list or, every other, a list under data."""
    n, held = 0, pa.array([], pa.string())

    def lines(payloads: pa.Array, last: bool) -> pa.RecordBatch:
        nonlocal n
        at = np.arange(n, n + len(payloads))
        odd, ends = (at // PAGE + part) % 2 == 1, at % PAGE == PAGE - 1
        if last:
            ends[-1:] = True
        n += len(payloads)
        begin = np.where(odd, '{"metadata": {"total": 1}, "data": [', "[")
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.array(np.where(at % PAGE == 0, begin, ", ")), payloads, pa.array(np.where(ends, np.where(odd, "]}", "]"), "")), "")], ["value"])

    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
            payloads = pa.concat_arrays([held, batch.column("payload").cast(pa.string())])
            held = payloads[-1:]
            yield lines(payloads[:-1], False)
    if len(held):
        yield lines(held, True)


def _pages(m) -> DataFrame:
    """Invoices written as pages of an export, some under data, and read back object by object. Pages are compressed files, so none is a row."""
    path = shared_folder(m.spark, "pages")
    rows = flow_queries._invoices_json(m).select("payload", F.spark_partition_id().alias("part"))
    rows.mapInArrow(_as_pages, "value string").write.option("maxRecordsPerFile", PAGE).option("compression", "gzip").text(path)
    found = docs.read_payload_pages(m.spark, path, "invoices")
    return found.select(text_of(F.col("payload"), "id").alias("document_id"), F.size(docs.elements(json_at(F.col("payload"), "items"))).alias("lines"))


def _backfilled(m) -> DataFrame:
    """Items whose family and supplier are missing for some, filled from their payloads."""
    had = m.dim_product.select("tenant_id", F.col("external_id").alias("item_id"), "product_key", "family_name", "preferred_supplier_name")
    blank = lambda c, n: F.when(F.col("product_key") % n != 0, F.col(c)).alias(c)
    return docs.backfill_attributes(had.select("tenant_id", "item_id", blank("family_name", 2), blank("preferred_supplier_name", 3)), _items_json(m)).drop("tenant_id")


def _names_json(dim: DataFrame, key: str) -> DataFrame:
    """Names as text, as an object, or left out."""
    k = F.col(key)
    name = F.when(k % 3 == 0, F.to_json(F.struct(F.col("name").alias("firstName"), F.lit("Ruiz").alias("lastName")))).when(k % 3 == 1, F.concat(F.lit('"'), F.col("name"), F.lit('"'))).otherwise(F.lit("null"))
    return dim.select("tenant_id", F.concat(F.lit('{"id": '), _text(key), F.lit(', "name": '), name, F.lit(', "status": "active"}')).alias("payload"))


def _warehouses_and_sellers(m) -> DataFrame:
    of = lambda kind, dim, key: docs.named_only(_names_json(dim, key)).select(F.lit(kind).alias("kind"), "id", "name", "status")
    return of("warehouse", m.dim_warehouse, "warehouse_key").unionByName(of("seller", m.dim_seller, "seller_key"))


def _adjustments(m) -> DataFrame:
    """Adjustments whose number is an object, text or missing."""
    n = F.col("document_id").cast("long") % 3
    number = F.when(n == 0, F.concat(F.lit('"numberTemplate": {"fullNumber": "A-'), F.col("document_id"), F.lit('"},'))).when(n == 1, F.concat(F.lit('"number": '), F.col("document_id"), F.lit(","))).otherwise(F.lit(""))
    raw = m.adjustment_lines.select("tenant_id", F.concat(F.lit('{"id": "'), "document_id", F.lit('", '), number, F.lit('"date": "'), _text("date"), F.lit('", "warehouse": {"id": "'), _text("warehouse_key"), F.lit('"}, "observations": "o"}')).alias("payload"))
    return docs.adjustments(raw).drop("tenant_id")


def _transfers(m) -> DataFrame:
    """Transfers that name their warehouses in either way."""
    odd = F.col("document_id").cast("long") % 2 == 1
    side = lambda a, b, c: F.concat(F.lit('"'), F.when(odd, a).otherwise(b), F.lit('": {"id": "'), _text(c), F.lit('"}'))
    raw = m.transfer_lines.select("tenant_id", F.concat(F.lit('{"id": "'), "document_id", F.lit('", "date": "'), _text("date"), F.lit('", '), side("sourceWarehouse", "originWarehouse", "source_key"), F.lit(", "), side("destinationWarehouse", "targetWarehouse", "destination_key"), F.lit("}")).alias("payload"))
    return docs.transfers(raw).select("document_id", "date", "source_id", "destination_id")


def _actions(m) -> DataFrame:
    """Review actions after edits of every fourth product, of one that isn't there, and with states that aren't known."""
    p = m.dim_product.filter("product_key % 4 = 0").select("product_key", F.when(F.col("product_key") % 8 == 0, "ordered").when(F.col("product_key") % 12 == 0, "unknown").otherwise("dismissed").alias("status"), F.lit("e").alias("note"), F.col("product_key").alias("seq"))
    twice = p.unionByName(p.filter("product_key % 20 = 0").withColumn("status", F.lit("reviewed")).withColumn("seq", F.col("seq") + 1)).unionByName(p.withColumn("product_key", -F.col("product_key")))
    return replenish.upsert_actions(m.review_actions, twice, "seq", m.dim_product.select("product_key"))


def _policies(m) -> DataFrame:
    """Product policies after edits that prefer a product's second supplier."""
    pairs = m.fact_purchases.filter("not is_deleted and currency_code = 'COP' and product_key % 7 = 0").select("product_key", F.col("provider_key").alias("supplier_key")).distinct()
    last = pairs.groupBy("product_key").agg(F.max("supplier_key").alias("supplier_key"))
    like = m.product_policies
    edits = last.withColumns({"currency_code": F.lit("COP"), "minimum_order_quantity": F.lit(3.0), "pack_size": F.lit(2.0), "lead_time_days": F.lit(5), "max_wait_days": F.lit(None).cast("int"), "is_preferred": F.lit(True)}).select(*like.columns).withColumn("seq", F.col("supplier_key"))
    return replenish.upsert_product_policies(like, edits, "seq").select("product_key", "supplier_key", "minimum_order_quantity", "is_preferred")


def _supplier_policies(m) -> DataFrame:
    """Supplier policies after edits of every fifth supplier."""
    like = m.supplier_policies
    edits = m.dim_contact.filter("contact_key > 10000000 and contact_key % 5 = 0").select(F.col("contact_key").alias("supplier_key"), F.lit("COP").alias("currency_code"), F.lit(77.0).alias("minimum_order_amount"), F.lit(7.0).alias("shipping_cost"),
                                                                                         F.lit(None).cast("double").alias("free_shipping_threshold"), F.lit(3).alias("default_lead_time_days"), F.lit(4).alias("max_wait_days"), F.col("contact_key").alias("seq"))
    return replenish.upsert_policies(like, edits, ["supplier_key", "currency_code"], "seq").select("supplier_key", "minimum_order_amount", "default_lead_time_days")


def _fresh(m) -> DataFrame:
    """Runs of tenants as events tell them: the last success of the mart and the last costing of each user."""
    runs = m.events.select(_text("user_id").alias("tenant_id"), _text("event_id").alias("run_id"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("succeeded").alias("status"), F.col("ts").alias("finished_at"), "event_type")
    return lookups.refresh_status(runs.filter("event_type in ('view', 'click')"), runs.filter("event_type not in ('view', 'click')"), datetime(2024, 1, 30, 12))


QUERIES = {
    "read_payload_pages": on(_pages),
    "backfill_family_supplier": on(_backfilled),
    "project_warehouse_seller": on(_warehouses_and_sellers),
    "project_adjustment": on(_adjustments),
    "project_transfer": on(_transfers),
    "upsert_actions": on(_actions),
    "upsert_product_policies": on(_policies),
    "upsert_supplier_policies": on(_supplier_policies),
    "refresh_status": on(_fresh),
    "project_item": on(lambda m: _doubles(docs.items(_items_json(m)).select("item_id", "name", "reference", "item_type", "inventory_enabled", "cost", "family_name", "preferred_supplier_name"), "cost")),
    "project_contact": on(lambda m: docs.contacts(_contacts_json(m)).select("contact_id", "name", "contact_type")),
    "project_payment": on(lambda m: _doubles(docs.payments(_payments_json(m)).select("payment_id", "date", "contact_id", "payment_type", "currency_code", "amount"), "amount")),
    "project_credit_note": on(lambda m: docs.credit_notes(_notes_json(m)).select("document_id", "number", "client_id", "warehouse_id", "date", "status")),
    "project_bill": on(lambda m: docs.bills(_bill_heads_json(m)).select("document_id", "number", "provider_id", "provider_name", "date", "status")),
    "snapshot_rows": on(lambda m: _doubles(docs.snapshot_rows(_snapshots_raw(m)), "quantity", "unit_cost")),
    "rebuild_purchase_lines": on(lambda m: _doubles(docs.rebuild_lines(_bills_json(m), _old_lines(m)).select("document_id", "line_number", "item_id", "price", "quantity", "total"), "price", "quantity", "total")),
    "upsert_projection": on(lambda m: _projection(m).select("external_id", "name")),
    "replace_document_lines": on(lambda m: _replaced(m).select("document_id", "line_number", "item_id", "quantity")),
    "apply_change_events": on(lambda m: _applied(m).select("external_id", "payload", "is_deleted")),
    "reconcile_window": on(lambda m: _reconciled(m)[0].select("external_id", "payload", "first_seen_at", "last_seen_at")),
    "reconcile_new_documents": on(lambda m: _reconciled(m)[1]),
    "fact_purchase_line": on(lambda m: _doubles(_fact_purchases(m), "quantity", "unit_cost", "amount").drop("tenant_id")),
    "fact_payment": on(lambda m: _doubles(_fact_payments(m), "amount").drop("tenant_id")),
    "fact_inventory_snapshot": on(lambda m: _doubles(_fact_snapshots(m), "quantity", "unit_cost", "value").drop("tenant_id")),
    "dim_contact_upsert": on(_contact_upsert),
    "dim_tenant": on(_tenants),
    "normalize_text": on(_accents),
    "refresh_mart": on(_mart_rows),
    "refresh_fact_sales": on(_mart_sales),
    "upsert_current_buckets": on(_upserted),
    "replace_lines_buckets": on(_lines_in_buckets),
    "opening_basis": on(lambda m: costing.allocation_statuses(_layers(m), m.sales_lines.select(F.col("date").alias("cutoff")))),
    "layer_warehouses": on(lambda m: costing.layer_warehouses(m.dim_warehouse)),
}

HEAD = "min(date) AS date, min(document_status) AS status"
VIEWS = "SELECT CAST(user_id AS VARCHAR) AS external_id, props, ts, event_id FROM events WHERE event_type = '{}'"
LAST = "SELECT external_id, arg_max(props, event_id) AS payload, arg_max(ts, event_id) AS ts FROM ({}) GROUP BY 1"
CLICKS = VIEWS.format("click") + f" AND CAST(ts AS DATE) BETWEEN DATE '{AS_OF}' - {DAYS} AND DATE '{AS_OF}'"
#: Bill lines have the date of their bill.
HEADED = "headed AS (SELECT p.* EXCLUDE (date), h.date FROM fact_purchases p JOIN (SELECT document_id, min(date) AS date FROM fact_purchases GROUP BY 1) h USING (document_id)), "


def _after_bills(sql: str) -> str:
    return HEADED + sql.replace("FROM fact_purchases WHERE NOT is_deleted AND product_key", "FROM headed WHERE NOT is_deleted AND product_key")


RAW_SQL = {
    "read_payload_pages": "SELECT document_id, CAST(count(*) AS INT) AS lines FROM sales_lines WHERE document_type = 'invoice' GROUP BY 1",
    "backfill_family_supplier": "SELECT external_id AS item_id, family_name, preferred_supplier_name FROM dim_product",
    "project_warehouse_seller": " UNION ALL ".join(f"SELECT '{d}' AS kind, CAST({d}_key AS VARCHAR) AS id, CASE {d}_key % 3 WHEN 0 THEN name || ' Ruiz' WHEN 1 THEN name ELSE CAST({d}_key AS VARCHAR) END AS name, 'active' AS status FROM dim_{d}" for d in ("warehouse", "seller")),
    "project_adjustment": "SELECT document_id, CASE CAST(document_id AS BIGINT) % 3 WHEN 0 THEN 'A-' || document_id WHEN 1 THEN document_id END AS number, date, CAST(warehouse_key AS VARCHAR) AS warehouse_id, 'o' AS observations FROM adjustment_lines",
    "project_transfer": "SELECT document_id, date, CAST(source_key AS VARCHAR) AS source_id, CAST(destination_key AS VARCHAR) AS destination_id FROM transfer_lines",
    "upsert_actions": """WITH e AS (SELECT product_key, CASE WHEN product_key % 20 = 0 THEN 'reviewed' WHEN product_key % 8 = 0 THEN 'ordered' WHEN product_key % 12 = 0 THEN 'unknown' ELSE 'dismissed' END AS status FROM dim_product WHERE product_key % 4 = 0),
        k AS (SELECT product_key, status, 'e' AS note FROM e WHERE status <> 'unknown') SELECT * FROM k UNION ALL SELECT product_key, status, note FROM review_actions WHERE product_key NOT IN (SELECT product_key FROM k)""",
    "upsert_product_policies": """WITH e AS (SELECT product_key, max(provider_key) AS supplier_key FROM fact_purchases WHERE NOT is_deleted AND currency_code = 'COP' AND product_key % 7 = 0 GROUP BY 1)
        SELECT product_key, supplier_key, CAST(3 AS DOUBLE) AS minimum_order_quantity, true AS is_preferred FROM e
        UNION ALL SELECT p.product_key, p.supplier_key, p.minimum_order_quantity, p.is_preferred AND e.supplier_key IS NULL FROM product_policies p LEFT JOIN e ON p.product_key = e.product_key WHERE e.supplier_key IS NULL OR e.supplier_key <> p.supplier_key""",
    "upsert_supplier_policies": """SELECT contact_key AS supplier_key, CAST(77 AS DOUBLE) AS minimum_order_amount, CAST(3 AS INT) AS default_lead_time_days FROM dim_contact WHERE contact_key > 10000000 AND contact_key % 5 = 0
        UNION ALL SELECT supplier_key, minimum_order_amount, default_lead_time_days FROM supplier_policies WHERE supplier_key % 5 <> 0""",
    "refresh_status": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS t, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS status, ts, event_type IN ('view', 'click') AS mart FROM events),
        m AS (SELECT t, arg_max(id, (ts, id)) AS mart_run_id, max(ts) AS mart_finished_at FROM r WHERE mart AND status = 'succeeded' GROUP BY 1), c AS (SELECT t, arg_max(id, (ts, id)) AS cost_run_id, arg_max(status, (ts, id)) AS cost_status FROM r WHERE NOT mart GROUP BY 1)
        SELECT m.t AS tenant_id, mart_run_id, mart_finished_at, mart_finished_at < TIMESTAMP '2024-01-30 10:00:00' AS is_stale, cost_run_id, cost_status FROM m LEFT JOIN c ON m.t = c.t""",
    "project_item": "SELECT external_id AS item_id, name, reference, item_type, inventory_enabled, CAST(current_cost AS DOUBLE) AS cost, family_name, preferred_supplier_name FROM dim_product",
    "project_contact": "SELECT CAST(contact_key AS VARCHAR) AS contact_id, name, contact_type FROM dim_contact",
    "project_payment": "SELECT payment_id, date, CAST(contact_key AS VARCHAR) AS contact_id, payment_type, currency_code, CAST(amount AS DOUBLE) AS amount FROM fact_payments",
    "project_credit_note": f"SELECT document_id, 'N' || document_id AS number, CAST(min(contact_key) AS VARCHAR) AS client_id, CAST(min(warehouse_key) AS VARCHAR) AS warehouse_id, {HEAD} FROM sales_lines WHERE document_type = 'credit_note' GROUP BY 1",
    "project_bill": f"SELECT document_id, document_id AS number, CAST(min(provider_key) AS VARCHAR) AS provider_id, 'n' AS provider_name, {HEAD} FROM fact_purchases GROUP BY 1",
    "snapshot_rows": "SELECT run_id, CAST(warehouse_key AS VARCHAR) AS warehouse_id, CAST(product_key AS VARCHAR) AS item_id, 'x' AS name, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_cost AS DOUBLE) AS unit_cost FROM fact_snapshots WHERE run_id <> '3' AND product_key % 13 <> 0",
    "rebuild_purchase_lines": """SELECT document_id, line_number, CAST(product_key - 1 AS VARCHAR) AS item_id, CAST(coalesce(unit_cost, 0) AS DOUBLE) AS price, CAST(quantity AS DOUBLE) AS quantity,
        CAST(round(coalesce(unit_cost, 0) * quantity, 2) AS DOUBLE) AS total FROM fact_purchases""",
    "upsert_projection": "SELECT external_id, CASE WHEN CAST(external_id AS BIGINT) % 7 = 0 THEN name || ' new' ELSE name END AS name FROM dim_product",
    "replace_document_lines": """SELECT document_id, line_number, CAST(product_key AS VARCHAR) AS item_id, CAST(quantity AS DOUBLE) + CASE WHEN length(document_id) % 2 = 0 THEN 1000 ELSE 0 END AS quantity
        FROM fact_purchases WHERE length(document_id) % 2 = 1 OR line_number = 1""",
    "fact_purchase_line": """SELECT p.document_id, line_number, h.date, h.document_status, product_key, provider_key, CAST(NULL AS BIGINT) AS warehouse_key, h.currency_code, CAST(quantity AS DOUBLE) AS quantity,
        CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(coalesce(amount, 0) AS DOUBLE) AS amount, h.is_deleted FROM fact_purchases p
        JOIN (SELECT document_id, min(date) AS date, min(document_status) AS document_status, coalesce(min(nullif(currency_code, 'COP')), 'COP') AS currency_code, bool_or(is_deleted) AS is_deleted FROM fact_purchases GROUP BY 1) h USING (document_id)""",
    "fact_payment": "SELECT payment_id, date, c.contact_key, payment_type, currency_code, CAST(coalesce(amount, 0) AS DOUBLE) AS amount, is_deleted FROM fact_payments f LEFT JOIN dim_contact c ON f.contact_key = c.contact_key",
    "fact_inventory_snapshot": "SELECT run_id, product_key, warehouse_key, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(value AS DOUBLE) AS value FROM fact_snapshots",
    "apply_change_events": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS external_id, event_type, min((ts, to_timestamp(CAST(epoch(date_trunc('second', ts)) AS BIGINT) + event_id % 7))) AS w
          FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2),
        l AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY w DESC, event_type DESC) AS n FROM e)
        SELECT external_id, 'p' || external_id AS payload, false AS is_deleted FROM l WHERE n = 1 AND event_type = 'signup'""",
    "reconcile_window": f"""WITH v AS ({LAST.format(VIEWS.format('view'))}), c AS ({LAST.format(CLICKS)})
        SELECT coalesce(v.external_id, c.external_id) AS external_id, coalesce(c.payload, v.payload) AS payload, least(v.ts, c.ts) AS first_seen_at, greatest(v.ts, c.ts) AS last_seen_at FROM v FULL JOIN c ON v.external_id = c.external_id""",
    "reconcile_new_documents": f"WITH v AS ({VIEWS.format('view')}), c AS ({CLICKS}) SELECT count(DISTINCT external_id) AS new_documents FROM c WHERE external_id NOT IN (SELECT external_id FROM v)",
    "dim_contact_upsert": "SELECT 't1' AS tenant_id, CAST(contact_key AS VARCHAR) AS external_id, name, row_number() OVER (ORDER BY CAST(contact_key AS VARCHAR)) AS key FROM dim_contact",
    "dim_tenant": "SELECT CAST(r_regionkey AS VARCHAR) AS tenant_id, lower(r_name) AS slug, r_name AS name FROM region",
    "normalize_text": "SELECT c_custkey, 'strasse ' || lower(c_name) AS plain FROM customer",
    "opening_basis": f"WITH {CLASSIFIED} SELECT DISTINCT date AS cutoff, CASE WHEN date IN (SELECT opened_on FROM layers WHERE source = 'opening') THEN 'ready' ELSE 'skipped_no_opening_basis' END AS status FROM sales_lines",
    "layer_warehouses": "SELECT tenant_id, min(warehouse_key) AS warehouse_key FROM dim_warehouse WHERE NOT is_deleted GROUP BY 1",
    "refresh_mart": f"WITH {_after_bills(CLASSIFIED)} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {t}" for n, t in {
        "dim_product": "dim_product", "dim_contact": "dim_contact", "dim_seller": "dim_seller", "dim_warehouse": "dim_warehouse", "fact_purchases": "fact_purchases", "fact_payments": "fact_payments",
        "fact_snapshots": "fact_snapshots", "fact_movements": "(SELECT 1 FROM adjustment_lines UNION ALL SELECT 1 FROM transfer_lines UNION ALL SELECT 1 FROM transfer_lines)", "fact_sales": "sales_lines", "cost_layers": "layers",
        "dim_date": "(SELECT date FROM sales_lines UNION SELECT date FROM headed UNION SELECT date FROM fact_payments UNION SELECT date FROM adjustment_lines UNION SELECT date FROM transfer_lines)"}.items()),
    "refresh_fact_sales": f"""WITH {_after_bills(WHOLE)} SELECT f.document_type, f.document_id, f.line_number, f.date, f.currency_code, f.is_deleted, CASE WHEN f.date < DATE '1998-01-01' THEN 'outside_scope' ELSE coalesce(c.cost_status, 'unavailable') END AS cost_status,
        CASE WHEN c.document_id IS NOT NULL THEN 'fifo' END AS cost_method, CAST(f.quantity AS DOUBLE) AS quantity, CAST(f.net_sales AS DOUBLE) AS net_sales, c.cogs,
        CAST(CASE WHEN c.cost_status IN ('costed', 'estimated') THEN f.net_sales - CAST(c.cogs AS DECIMAL(18,2)) END AS DOUBLE) AS margin
        FROM sales_lines f LEFT JOIN costs c ON f.document_type = c.document_type AND f.document_id = c.document_id AND f.line_number = c.line_number""",
}
RAW_SQL["replace_lines_buckets"] = RAW_SQL["replace_document_lines"]
RAW_SQL["upsert_current_buckets"] = flow_queries.RAW_SQL["upsert_current"]
SQL = {k: with_fixtures(v) for k, v in RAW_SQL.items()}
