"""Mart jobs, change events that come again, text for matching."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martloom.functions.cols import normalized_text
from martloom.operators import costing, landing, lookups, mart, refresh, replenish
from martloom.plans import cost_queries, mart_queries
from martloom.plans.fixtures import Marts
from martloom.sources import documents as docs
from martloom.sources.buckets import merge_buckets, read_buckets, write_buckets
from martloom.sources.sinks import read_runs
from martloom.streaming import changes


def _event(i: str, minute: int) -> str:
    return json.dumps({"tenant_id": "t1", "subject": "edit-item", "message": json.dumps({"item": {"id": i}}), "available_at": "2030-01-01T00:00:00Z", "created_at": f"2030-01-01T00:{minute:02}:00Z"})


def test_batch_that_comes_again_is_logged_once(spark, tmp_path):
    come, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "checkpoint")
    come.mkdir()

    def batch(name: str, ids: str) -> None:
        (come / name).write_text("\n".join(_event(i, n) for n, i in enumerate(ids)))
        changes.run_dedup(changes.read_events(spark, str(come)), log, checkpoint)

    def logged():
        return sorted((r.external_id, r.epoch, r.created_at.minute) for r in spark.read.parquet(log).collect())

    batch("a.json", "aba")
    batch("b.json", "bcda")
    want = [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 2)]
    assert logged() == want
    for f in (tmp_path / "checkpoint" / "commits").glob("*1*"):  # as if the second batch had failed after it was written
        f.unlink()
    changes.run_dedup(changes.read_events(spark, str(come)), log, checkpoint)
    assert logged() == want
    batch("c.json", "eda")
    assert logged() == [*want, ("e", 2, 0)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["k"]
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "k long, v string")
    write_buckets(rows(range(40), "old"), path, key, 8)
    files = lambda: {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in tmp_path.rglob("bucket=*/*.parquet")}
    before, fresh = files(), rows([3, 5, 99], "new")
    touched = merge_buckets(spark, path, key, 8, fresh, lambda old: landing.upsert_projection(old, fresh, key))
    after = files()
    of = lambda f: int(f.parts[1].split("=")[1])
    assert 0 < len(touched) <= 3
    assert {f: t for f, t in before.items() if of(f) not in touched} == {f: t for f, t in after.items() if of(f) not in touched}
    assert {f for f in before if of(f) in touched}.isdisjoint(after)
    assert {tuple(r) for r in read_buckets(spark, path).collect()} == {(i, "new" if i in (3, 5) else "old") for i in range(40)} | {(99, "new")}
    gone = rows(range(40), "")  # a bucket without rows goes
    merge_buckets(spark, path, key, 8, gone, lambda old: old.join(gone, key, "left_anti"))
    assert [tuple(r) for r in read_buckets(spark, path).collect()] == [(99, "new")] and len(files()) == 1
    assert merge_buckets(spark, path, key, 8, fresh.limit(0), lambda old: old) == []


def test_hash_of_content(spark):
    rows = [(1, '{"b": [1, {"y": 2, "x": "é"}], "a": null}'), (2, '{"a":null,"b":[1,{"x":"é","y":2}]}'), (3, '{"a":null,"b":[1,{"x":"e","y":2}]}'), (4, "not json"), (5, "nor this"), (6, None)]
    got = dict(spark.createDataFrame(rows, "k int, p string").select("k", docs.canonical_hash(F.col("p"))).collect())
    assert got[1] == got[2] and len({got[k] for k in (1, 3, 4, 5)}) == 4 and got[6] is None


def test_text_for_matching(spark):
    rows = [("  ÁRBOL \u00a0 Straße ", "arbol strasse"), ("ﬁno Ｘ２", "fino x2"), ("Šárka Ýr ā", "sarka yr a"), ("e\u0301", "e"), ("", ""), (None, None)]
    got = [r[0] for r in spark.createDataFrame([r[:1] for r in rows], "t string").select(normalized_text(F.col("t"))).collect()]
    assert got == [r[1] for r in rows]


def test_keys_stay(spark):
    load = lambda *ids: spark.createDataFrame([("t1", i, i.upper()) for i in ids], "tenant_id string, external_id string, name string")
    empty = load("x").limit(0).withColumn("key", F.lit(0).cast("long"))
    first = mart.upsert_dim(empty, load(*"dbca"), "key")
    assert {r.external_id: r.key for r in first.collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    again = mart.upsert_dim(first, load("b", "e", "aa"), "key")
    assert {r.external_id: r.key for r in again.collect()} == {"a": 1, "b": 2, "c": 3, "d": 4, "aa": 5, "e": 6}


def test_warehouses_and_basis(spark):
    w = spark.createDataFrame([("t1", 4, "a", False), ("t1", 2, "b", True), ("t1", 7, "c", False), ("t2", 1, "a", False)], "tenant_id string, warehouse_key long, external_id string, is_deleted boolean")
    assert costing.opening_warehouse(w, "t1", "c") == 7 and costing.opening_warehouse(w, "t2") == 1 and costing.layer_warehouse(w, "t1") == 4
    for args in (("t1",), ("t1", "b"), ("t3",)):
        with pytest.raises(ValueError):
            costing.opening_warehouse(w, *args)
    with pytest.raises(ValueError):
        costing.layer_warehouse(w, "t3")
    layers = spark.createDataFrame([("opening", date(2030, 1, 1)), ("purchase", date(2030, 2, 1))], "source string, opened_on date")
    assert (costing.allocation_status(layers, date(2030, 1, 1)), costing.allocation_status(layers, date(2030, 2, 1))) == ("ready", "skipped_no_opening_basis")


DAY = date(2030, 1, 2)


def _tables(spark, tenants: str, price: str = "7", cutoff: date = date(2030, 1, 1)) -> dict:
    """Typed tables: each tenant opens with 4 units of one item at 5, buys 6, sells 7 and takes 1 back."""
    make = lambda rows, schema: spark.createDataFrame([x for t in tenants for x in rows(t)], "tenant_id string, " + schema)
    head = "document_id string, date date, status string, client_id string, {} string, currency_code string, is_deleted boolean"
    line = "document_id string, line_number int, item_id string, quantity decimal(18,4), total decimal(18,2)"
    named = "external_id string, name string, is_deleted boolean"
    return {
        "tenants": make(lambda t: [(t, t, t)], "slug string, name string"),
        "items": make(lambda t: [(t, "i1", "Item", "R1", " ", None, False)], "external_id string, name string, reference string, family_name string, preferred_supplier_name string, is_deleted boolean"),
        "contacts": make(lambda t: [(t, "c1", "C", False), (t, "p1", "P", False)], named), "sellers": make(lambda t: [(t, "s1", "S", False)], named), "warehouses": make(lambda t: [(t, "w1", "W", False)], named),
        "invoices": make(lambda t: [(t, "F1", DAY, "open", "c1", "s1", None, False)], head.format("seller_id")),
        "invoice_lines": make(lambda t: [(t, "F1", 1, "i1", Decimal(7), Decimal(70))], line),
        "credit_notes": make(lambda t: [(t, "N1", date(2030, 1, 3), "open", "c1", "w1", "COP", False)], head.format("warehouse_id")),
        "credit_note_lines": make(lambda t: [(t, "N1", 1, "i1", Decimal(1), Decimal(10))], line),
        "bills": make(lambda t: [(t, "B1", date(2030, 1, 1), "open", "p1", None, False)], "document_id string, date date, status string, provider_id string, currency_code string, is_deleted boolean"),
        "bill_lines": make(lambda t: [(t, "B1", 1, "i1", Decimal(6), Decimal(price), Decimal(42))], "document_id string, line_number int, item_id string, quantity decimal(18,4), price decimal(18,4), total decimal(18,2)"),
        "payments": make(lambda t: [(t, "P1", DAY, "c1", "in", None, None, False)], "payment_id string, date date, contact_id string, payment_type string, currency_code string, amount decimal(18,2), is_deleted boolean"),
        "snapshot_rows": make(lambda t: [(t, "1", "i1", "w1", Decimal(3), Decimal(5))], "run_id string, item_id string, warehouse_id string, quantity decimal(18,4), unit_cost decimal(18,4)"),
        "adjustment_lines": make(lambda t: [(t, "A1", 1, DAY, Decimal(2), False, "i1", "w1")], "document_id string, line_number int, date date, quantity decimal(18,4), is_deleted boolean, item_id string, warehouse_id string"),
        "transfer_lines": make(lambda t: [(t, "T1", 1, DAY, Decimal(2), False, "i1", "w1", "w9")], "document_id string, line_number int, date date, quantity decimal(18,4), is_deleted boolean, item_id string, source_id string, destination_id string"),
        "opening_report": make(lambda t: [(t, 1, "item", "r1", Decimal(4), Decimal(5))], "row_number int, item string, reference string, quantity decimal(18,4), average_cost decimal(18,4)"),
    }


def _clock(*hours):
    times = iter(datetime(2030, 1, 5, h) for h in hours)
    return lambda: next(times)


def test_refresh_ends_in_costed_facts_and_is_seen_whole(spark, tmp_path):
    path, cutoff = str(tmp_path), date(2030, 1, 1)
    sales = lambda t: sorted((r.document_type, str(r.cogs), r.cost_status, r.product_key) for r in refresh.published(spark, path, "fact_sales", t).collect())
    for tenant in "ab":
        counts = refresh.refresh(spark, path, tenant, f"{tenant}1", _tables(spark, "ab"), cutoff, _clock(1, 2, 3))
    assert counts["fact_sales"] == 2 and counts["fact_movements"] == 3 and counts["cost_layers"] == 2
    # 4 at 5 and 3 at 7; the unit that comes back is worth 41 / 7.
    want = [("credit_note", "-5.86", "estimated", 1), ("invoice", "41.00", "costed", 1)]
    assert sales("a") == sales("b") == want
    assert refresh.published(spark, path, "fact_sales").count() == 4

    # A failed run: what was published stays, and the failure is on record.
    broken = _tables(spark, "a") | {"contacts": _tables(spark, "a")["contacts"].withColumn("name", F.raise_error(F.lit("no name")).cast("string"))}
    with pytest.raises(Exception, match="no name"):
        refresh.refresh(spark, path, "a", "a2", broken, cutoff, _clock(4, 5, 6))
    assert sales("a") == want
    runs = {(r.run_id, r.kind): r for r in read_runs(spark, f"{path}/runs").collect()}
    assert runs["a2", "mart"].status == "failed" and "no name" in runs["a2", "mart"].error and runs["a2", "mart"].counts == {"dim_tenant": 1, "dim_product": 1}
    assert runs["a1", "mart"].status == "succeeded" and runs["a1", "cost"].status == "succeeded"

    # A tenant whose documents have gone: facts are emptied, dimensions and keys stay; the other tenant isn't touched.
    gone = {n: (df if n in ("tenants", "items", "contacts", "sellers", "warehouses", "opening_report") else df.limit(0)) for n, df in _tables(spark, "ab").items()}
    refresh.refresh(spark, path, "a", "a3", gone, cutoff, _clock(7, 8, 9))
    assert sales("a") == [] and sales("b") == want
    assert [tuple(r) for r in refresh.published(spark, path, "dim_product", "a").select("external_id", "product_key", "family_name").collect()] == [("i1", 1, "SIN FAMILIA")]

    # Without an opening at the cutoff nothing is costed.
    refresh.refresh(spark, path, "b", "b2", _tables(spark, "ab") | {"opening_report": _tables(spark, "ab")["opening_report"].limit(0)}, cutoff, _clock(7, 8, 9))
    assert {(k, c, s) for k, c, s, _ in sales("b")} == {("credit_note", "None", None), ("invoice", "None", None)}
    status = lookups.refresh_status(read_runs(spark, f"{path}/runs").filter("kind = 'mart'"), read_runs(spark, f"{path}/runs").filter("kind = 'cost'"), datetime(2030, 1, 5, 10))
    assert {(r.tenant_id, r.mart_run_id, r.is_stale, r.cost_status) for r in status.collect()} == {("a", "a3", False, "succeeded"), ("b", "b2", False, "skipped_no_opening_basis")}


def test_mean_score_of_a_plan_does_not_depend_on_order(spark):
    given = [46.4285713, 44.99999995, 44.99999995, 44.09090905, 45.625, 29.99999995, 31.4285713]  # their mean is 41.0818645
    orders = [[given[(k * step + start) % 7] for k in range(7)] for step in range(1, 7) for start in range(7)]
    rows = [(s, s * 10 + n, x) for s, order in enumerate(orders) for n, x in enumerate(order)]
    items = spark.createDataFrame(rows, "supplier_key long, product_key long, supplier_score double").coalesce(1).withColumns({
        "recommended_quantity": F.lit(1.0), "estimated_purchase_value": F.lit(1.0), "priority": F.lit("high"), "queue_rank": F.lit(2), "queue_value": F.lit(1.0), "policy_configured": F.lit(True), "preferred_supplier": F.lit("s"),
        "currency_code": F.lit("COP"), "minimum_order_amount": F.lit(0.0), "shipping_cost": F.lit(0.0), "free_shipping_threshold": F.lit(0.0), "effective_max_wait_days": F.lit(7)})
    got = {r.supplier_score for r in replenish.purchase_plans(items, DAY).collect()}
    assert got == {41.081865}
    none = items.limit(1).withColumn("supplier_score", F.lit(None).cast("double"))
    assert replenish.purchase_plans(none, DAY).first().supplier_score == 0


def _read(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_refresh_and_costs_read_tables_that_are_written_once(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(refresh, "refresh", lambda spark, path, tenant, run, tables, *rest: seen.append(tables))
    mart_queries._refreshed(Marts(spark, sf))
    assert len(seen) == 2
    for name in ("invoices", "invoice_lines", "credit_notes", "credit_note_lines", "bills", "bill_lines"):
        assert "lineitem.parquet" not in _read(seen[0][name]), name
    columns = "product_key long, document_type string, document_id string, line_number int, quantity_allocated decimal(28,4), cost_amount decimal(28,10), allocation_type string, source_document_id string, source_line_number int"
    monkeypatch.setattr(cost_queries, "_allocated", lambda m, invoices: spark.createDataFrame([(1, "invoice", "1", 1, Decimal(1), Decimal(1), "fifo", "B1", 1)], columns))
    assert "lineitem.parquet" not in _read(cost_queries.QUERIES["sales_cost_supplier"](spark, sf))


def test_keys_of_documents_reach_their_lines(spark):
    tables = _tables(spark, "a")
    dims = {n: tables[s].withColumn(k, F.lit(7).cast("long")) for n, (s, k) in refresh.KEYED.items()}
    odd = {n: tables[n].unionByName(tables[n].withColumns({"document_id": F.lit("X"), "client_id": F.lit("nobody"), c: F.lit(None).cast("string")})) for n, c in (("invoices", "seller_id"), ("credit_notes", "warehouse_id"))}
    lines = {n: tables[n].unionByName(tables[n].withColumns({"document_id": F.lit("X"), "item_id": F.lit("nothing")})) for n in ("invoice_lines", "credit_note_lines")}
    got = mart.fact_sales(odd["invoices"], lines["invoice_lines"], odd["credit_notes"], lines["credit_note_lines"], *dims.values())
    assert {(r.document_id, r.product_key, r.contact_key, r.seller_key, r.warehouse_key, int(r.quantity), int(r.net_sales)) for r in got.collect()} == {("F1", 7, 7, 7, None, 7, 70), ("X", None, None, None, None, 7, 70), ("N1", 7, 7, None, 7, -1, -10), ("X", None, None, None, None, -1, -10)}
