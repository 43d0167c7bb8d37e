"""Documents, periods and landing on literal inputs."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from martloom.operators import landing
from martloom.plans.filters import ReportFilter, default_period
from martloom.sources import documents as docs
from martloom.sources.opening import opening_report


def raw(spark, *payloads):
    return spark.createDataFrame([("t1", i, json.dumps(p)) for i, p in enumerate(payloads)], "tenant_id string, seq int, payload string")


def test_periods():
    f = ReportFilter(date(2024, 3, 1), date(2024, 3, 10))
    assert (f.previous().from_date, f.previous().to_date) == (date(2024, 2, 20), date(2024, 2, 29))
    assert default_period(date(2025, 2, 17)).from_date == date(2025, 1, 19)
    with pytest.raises(ValueError):
        ReportFilter(date(2025, 5, 2), date(2025, 5, 1))


def test_invoice(spark):
    p = {"id": 7, "date": "2031-03-09T23:15:00", "client": {"id": "3", "name": {"firstName": "Ana", "lastName": "Ruiz"}}, "seller": {"id": 9, "name": "Eva"}, "total": "88.50", "totalPaid": 33, "balance": "55.5", "currency": {"code": "USD"}, "items": [{"id": 1, "name": "A", "price": 3.5, "quantity": 7}, "x", {"id": 1, "price": 11, "quantity": 0.5}]}
    h = docs.invoice_headers(raw(spark, p, {"date": "no id"})).collect()
    assert len(h) == 1
    assert (h[0].document_id, h[0].date, h[0].status, h[0].client_name, h[0].seller_name, h[0].total_paid, h[0].currency_code) == ("7", date(2031, 3, 9), "unknown", "Ana Ruiz", "Eva", Decimal(33), "USD")
    lines = [(r.line_number, r.name, r.total) for r in docs.invoice_lines(raw(spark, p)).orderBy("line_number").collect()]
    assert lines == [(1, "A", Decimal("24.5")), (3, "Sin nombre", Decimal("5.5"))]


def test_lines_of_bills(spark):
    a = {"id": 1, "purchases": {"items": [1, {"id": 5, "quantity": 3, "price": 7.25}]}}
    b = {"id": 2, "items": [{"item": {"id": 6}, "quantity": 2, "price": 0, "unitPrice": 4, "total": 0, "amount": 9}]}
    got = {(r.document_id, r.line_number, r.item_id, r.total) for r in docs.document_lines(raw(spark, a, b)).collect()}
    assert got == {("1", 1, "5", Decimal("21.75")), ("2", 1, "6", Decimal(9))}


def test_payments_of_nothing(spark):
    given = [{"amount": "0.00"}, {"amount": "0.00", "total": 5}, {"amount": 0, "total": 5}, {"amount": 0.0, "total": "7.5"}, {"amount": 3, "total": 5}, {"total": 5}, {"amount": {"amount": "2.5"}}, {"amount": 0}, {}]
    got = [r.amount for r in docs.payments(raw(spark, *given)).collect()]
    assert got == [Decimal(0), Decimal(0), Decimal(5), Decimal("7.5"), Decimal(3), Decimal(5), Decimal("2.5"), None, None]


def test_items_and_snapshots(spark):
    item = {"id": 4, "name": "N", "reference": {"value": "R"}, "inventory": {"availableQuantity": 3.125, "unitCost": 41.6}, "customFields": [{"label": "familia ", "value": "Jardinería"}, {"key": "PROVEEDOR", "value": "Norte y Cía"}]}
    r = docs.items(raw(spark, item)).first()
    assert (r.reference, r.inventory_enabled, r.family_name, r.preferred_supplier_name) == ("R", True, "Jardinería", "Norte y Cía")
    rows = spark.createDataFrame([("1", "w", 0, json.dumps(item)), ("1", "w", 1, json.dumps(item)), ("1", "w", 2, '{"id": 9}')], "run_id string, warehouse_id string, seq int, payload string")
    assert [(x.item_id, x.quantity) for x in docs.snapshot_rows(rows).collect()] == [("4", Decimal("3.125"))]


def test_pages(spark):
    pages = spark.createDataFrame([('[{"id":1},3]',), ('{"data":[{"id":2}],"metadata":{"total":1}}',), ('{"invoice":{"id":3}}',), ('{"id":4}',)], "value string")
    ids = sorted(json.loads(r.payload)["id"] for r in docs.unwrap(pages, "invoices").collect())
    assert ids == [1, 2, 3, 4]


def test_opening_report(spark):
    t = spark.createDataFrame([("c", "Item A", "r", "", "1,000", "", "u", "e", "918.4", "z"), ("c", None, "", "", "x", "", "", "", "", "z")], ["Categoría", "Ítem", "Referencia", "Descripción", "Cantidad", "Cantidad en remisiones", "Unidad", "Estado", "Costo promedio", "Total"])
    r = opening_report(t.limit(1)).collect()
    assert [(x.item, x.quantity, x.reserved, x.average_cost) for x in r] == [("Item A", Decimal(1000), Decimal(0), Decimal("918.4"))]
    with pytest.raises(ValueError):
        opening_report(t.drop("Ítem"))


def test_landing(spark):
    t = datetime(2026, 1, 1)
    batch = lambda *rows: spark.createDataFrame([("t1", "item", i, p, p, n, t) for n, (i, p) in enumerate(rows)], "tenant_id string, resource string, external_id string, payload string, payload_hash string, seq int, received_at timestamp")
    empty = spark.createDataFrame([], "tenant_id string, resource string, external_id string, payload string, payload_hash string, first_seen_at timestamp, last_seen_at timestamp, is_deleted boolean")
    one = landing.upsert_current(empty, batch(("a", "1"), ("a", "2"), ("b", "1")))
    gone = landing.soft_delete(one, one.filter("external_id = 'a'"))
    assert {(r.external_id, r.payload, r.is_deleted) for r in gone.collect()} == {("a", "2", True), ("b", "1", False)}
    back = landing.upsert_current(gone, batch(("a", "3")))
    assert {(r.external_id, r.payload, r.is_deleted) for r in back.collect()} == {("a", "3", False), ("b", "1", False)}
    assert landing.new_versions(batch(("a", "2"), ("b", "9")), batch(("a", "2"))).count() == 1
