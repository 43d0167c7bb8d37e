"""Registered costing queries over all lines, credit notes included, against the walk."""

from __future__ import annotations

from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from test_costing import walk

from martloom.plans import cost_queries as q
from martloom.plans.fixtures import Marts

SF = "/root/testdata/sf0.001"


def test_all_lines_equal_walk(spark):
    m = Marts(spark, SF)
    layers = [tuple(r) for r in q._layers(m).select("product_key", "opened_on", "source", "source_document_id", "source_line_number", "quantity", "unit_cost").collect()]
    rows = m.sales_lines.filter("not is_deleted and quantity <> 0").select("document_type", "document_id", "line_number", "date", "product_key", "quantity", "net_sales").collect()
    lines = [tuple(r)[:6] for r in rows if r.date >= q.CUTOFF]
    want = walk(layers, lines)
    got = {k: q.QUERIES[f"{k}_all_lines"](spark, SF).collect() for k in ("fifo_allocate", "line_cost_status", "layer_balances", "cost_run_summary", "apply_costs_to_facts", "sales_cost_supplier")}
    back = {k for k, (units, _, _) in want.items() if units < 0}
    assert back

    status = {(r.document_type, r.document_id, r.line_number): r for r in got["line_cost_status"]}
    assert set(status) == set(want)
    sums = defaultdict(lambda: [0, 0, 0])
    for r in got["fifo_allocate"]:
        of = sums[r.document_type, r.document_id, r.line_number]
        of[r.allocation_type == "unavailable"] += r.quantity_allocated
        of[2] += r.cost_amount
    for k, (units, missing, cost) in want.items():
        assert (status[k].costed_quantity, status[k].uncosted_quantity) == pytest.approx((float(units), float(missing))), k
        assert status[k].cogs == pytest.approx(float(cost), abs=0.011), k
        assert sums[k] == pytest.approx([float(units), float(missing), float(cost)], abs=0.011), k

    left = defaultdict(float)
    for r in got["layer_balances"]:
        assert r.remaining >= 0
        left[r.product_key] += r.remaining
    stock = defaultdict(Decimal)
    for layer in layers:
        stock[layer[0]] += layer[5]
    for kind, doc, n, _, product, _ in lines:
        if want[kind, doc, n][0]:
            stock[product] -= want[kind, doc, n][0]
    assert left == pytest.approx({k: float(v) for k, v in stock.items()})
    assert sum(r.source == "return" for r in got["layer_balances"]) == len(back)

    (run,) = got["cost_run_summary"]
    assert (run.lines_read, run.lines_costed) == (len(want), sum(not missing for _, missing, _ in want.values()))
    assert run.cogs == pytest.approx(sum(float(c) for _, _, c in want.values()), rel=1e-6)
    facts = {r.cost_status: r.lines for r in got["apply_costs_to_facts"]}
    assert facts["estimated"] == len(back)
    assert facts.get("costed", 0) == Counter(not missing and k not in back for k, (_, missing, _) in want.items())[True]
    year = {tuple(r) for r in m.fact_sales.filter(f"not is_deleted and date between '{q.YEAR.from_date}' and '{q.YEAR.to_date}'").select("document_type", "document_id", "line_number").collect()}
    assert sum(r.cogs for r in got["sales_cost_supplier"]) == pytest.approx(sum(float(c) for k, (_, _, c) in want.items() if k in year), rel=1e-6)
