"""Costing queries over the test tables, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from martloom.operators import costing as c
from martloom.operators import sales as s
from martloom.plans.fixtures import keep, with_fixtures
from martloom.plans.reports import YEAR, on
from martloom.sources.sinks import stored

CUTOFF = date(1998, 1, 1)


def _classified(m):
    return c.classify_opening(m.opening_report, m.dim_product)


def _layers(m):
    return c.cost_layers(_classified(m), m.fact_purchases, CUTOFF)


def _lines(m, invoices: bool):
    rows = m.sales_lines.filter("not is_deleted")
    return rows.filter("document_type = 'invoice'") if invoices else rows


def _allocated(m, invoices: bool = False):
    keep(m, "sales_lines")
    return stored(c.fifo_allocate(_lines(m, invoices), _layers(m), CUTOFF))


def _costs(m, invoices: bool = False):
    return c.line_costs(_lines(m, invoices), _allocated(m, invoices))


def _doubles(df, *names):
    return df.select(*[df[n].cast("double").alias(n) if n in names else df[n] for n in df.columns])


def _fifo(invoices: bool, suffix: str) -> dict:
    """The costing job over all lines, credit notes included, or over invoices."""
    numbers = ("quantity_allocated", "unit_cost", "cost_amount")
    kind = () if invoices else ("document_type",)

    def allocated(m):
        rows = _doubles(_allocated(m, invoices).select(*kind, "document_id", "line_number", "product_key", "sequence", *numbers, "allocation_type", "confidence", "layer_id"), *numbers)
        return rows if invoices else rows.withColumns({n: F.round(n, 6) for n in ("unit_cost", "cost_amount")})

    def by_supplier(m):
        keep(m, "sales_lines", "fact_purchases")
        return s.sales_cost_supplier(m, _allocated(m, invoices), YEAR)

    named = {
        "fifo_allocate": on(allocated),
        "line_cost_status": on(lambda m: _doubles(_costs(m, invoices).select(*SHOWN), "costed_quantity", "uncosted_quantity", "cogs")),
        "layer_balances": on(lambda m: _doubles(c.layer_balances(_layers(m), _allocated(m, invoices)), "quantity", "taken", "remaining")),
        "cost_run_summary": on(lambda m: c.run_summary(_costs(m, invoices))),
        "apply_costs_to_facts": on(lambda m: c.cost_status_summary(c.apply_costs(_lines(m, invoices), _costs(m, invoices), CUTOFF))),
        "sales_cost_supplier": on(by_supplier),
    }
    return {f"{k}{suffix}": v for k, v in named.items()}


SHOWN = ("document_type", "document_id", "line_number", "product_key", "costed_quantity", "uncosted_quantity", "cogs", "cost_status")
QUERIES = {
    "match_opening_products": on(lambda m: c.match_opening(m.opening_report, m.dim_product).select("row_number", "match", "product_key")),
    "classify_opening": on(lambda m: _doubles(_classified(m).select("row_number", "classification", "opening_quantity", "opening_value"), "opening_quantity", "opening_value")),
    "opening_import_summary": on(lambda m: c.opening_summary(_classified(m))),
    "opening_value_check": on(lambda m: c.opening_value(_layers(m))),
    "cost_layers": on(lambda m: _doubles(_layers(m), "quantity", "unit_cost")),
    "sales_sequence": on(lambda m: c.sales_sequence(_lines(m, False), CUTOFF).select("document_type", "document_id", "line_number", "product_key", "seq")),
    **_fifo(False, ""),
    "fifo_returns": on(lambda m: _doubles(_costs(m).select(*SHOWN), "costed_quantity", "uncosted_quantity", "cogs")),
    **_fifo(False, "_all_lines"),
    **_fifo(True, "_invoices"),
}

NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
CLASSIFIED = f"""
  refs AS (SELECT {NORM.format('reference')} AS k, min(product_key) AS pk, count(*) AS n FROM dim_product WHERE NOT is_deleted GROUP BY 1),
  nms AS (SELECT {NORM.format('name')} AS k, min(product_key) AS pk, count(*) AS n FROM dim_product WHERE NOT is_deleted GROUP BY 1),
  matched AS (SELECT o.*, CASE WHEN coalesce(r.n, m.n) IS NULL THEN 'unmatched' WHEN coalesce(r.n, m.n) > 1 THEN 'ambiguous' WHEN r.n IS NOT NULL THEN 'reference' ELSE 'name' END AS match,
    CASE WHEN coalesce(r.n, m.n) = 1 THEN CASE WHEN r.n IS NOT NULL THEN r.pk ELSE m.pk END END AS product_key
    FROM opening_report o LEFT JOIN refs r ON {NORM.format('o.reference')} = r.k LEFT JOIN nms m ON {NORM.format('o.item')} = m.k),
  classified AS (SELECT *, CASE WHEN classification = 'opening_layer' THEN quantity END AS opening_quantity, CASE WHEN classification = 'opening_layer' THEN quantity * average_cost END AS opening_value FROM (
    SELECT *, CASE WHEN product_key IS NULL AND quantity < 0 THEN 'negative_unmatched' WHEN product_key IS NULL AND quantity = 0 THEN 'reference_unmatched' WHEN product_key IS NULL THEN 'unmatched'
      WHEN quantity < 0 THEN 'negative_exception' WHEN quantity = 0 THEN 'reference_only' WHEN average_cost IS NULL THEN 'unpriced_exception' ELSE 'opening_layer' END AS classification FROM matched)),
  layers AS (SELECT product_key, 'O' || row_number AS layer_id, DATE '1998-01-01' AS opened_on, 'opening' AS source, CAST(NULL AS VARCHAR) AS source_document_id, CAST(row_number AS INT) AS source_line_number, CAST(quantity AS DECIMAL(28,4)) AS quantity, CAST(average_cost AS DECIMAL(28,10)) AS unit_cost FROM classified WHERE classification = 'opening_layer'
    UNION ALL SELECT product_key, 'P' || document_id || '/' || line_number, date, 'purchase', document_id, line_number, quantity, unit_cost FROM fact_purchases WHERE NOT is_deleted AND product_key IS NOT NULL AND quantity > 0 AND unit_cost IS NOT NULL AND date >= DATE '1998-01-01'),
  seqd AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_key ORDER BY date, document_type = 'credit_note', document_id, line_number) AS INT) AS seq FROM sales_lines WHERE NOT is_deleted AND quantity <> 0 AND date >= DATE '1998-01-01')"""
ALLOCATED = (
    CLASSIFIED.replace("seqd AS (SELECT *", "seqd AS (SELECT *").replace("WHERE NOT is_deleted AND quantity <> 0 AND", "WHERE document_type = 'invoice' AND NOT is_deleted AND quantity <> 0 AND")
    + """,
  lay AS (SELECT *, sum(quantity) OVER (PARTITION BY product_key ORDER BY opened_on, source = 'purchase', coalesce(source_document_id, ''), source_line_number, layer_id) AS hi FROM layers),
  sup AS (SELECT product_key AS p, sum(quantity) AS supply FROM layers GROUP BY 1),
  pos AS (SELECT *, least(coalesce(supply, 0), sum(quantity) OVER (PARTITION BY product_key ORDER BY seq)) AS hi, least(coalesce(supply, 0), sum(quantity) OVER (PARTITION BY product_key ORDER BY seq) - quantity) AS lo FROM seqd LEFT JOIN sup ON product_key = p),
  seg AS (SELECT s.product_key, document_type, document_id, line_number, greatest(s.lo, l.hi - l.quantity) AS pt, least(s.hi, l.hi) - greatest(s.lo, l.hi - l.quantity) AS taken, l.layer_id, l.unit_cost, l.source, l.source_document_id, l.source_line_number
    FROM pos s JOIN lay l ON s.product_key = l.product_key AND s.lo < l.hi AND l.hi - l.quantity < s.hi),
  num AS (SELECT *, taken * unit_cost AS exact, row_number() OVER w - 1 AS sequence, count(*) OVER (PARTITION BY document_id, line_number) AS n, sum(taken * unit_cost) OVER (PARTITION BY document_id, line_number) AS total, sum(taken * unit_cost) OVER w AS upto FROM seg WINDOW w AS (PARTITION BY document_id, line_number ORDER BY pt)),
  mis AS (SELECT document_id, line_number, product_key, CASE WHEN product_key IS NULL THEN quantity ELSE quantity - (hi - lo) END AS missing FROM pos),
  cnt AS (SELECT document_id, line_number, max(n) AS n FROM num GROUP BY 1, 2),
  alloc AS (SELECT document_id, line_number, product_key, CAST(sequence AS INT) AS sequence, CAST(taken AS DOUBLE) AS quantity_allocated, CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(CASE WHEN sequence = n - 1 THEN round(total, 2) - (upto - exact) ELSE exact END AS DOUBLE) AS cost_amount, 'fifo' AS allocation_type,
      CASE WHEN source = 'opening' THEN 'certified' ELSE 'source' END AS confidence, layer_id, source_document_id, source_line_number FROM num
    UNION ALL SELECT m.document_id, m.line_number, product_key, CAST(coalesce(n, 0) AS INT), CAST(missing AS DOUBLE), NULL, 0, 'unavailable', 'unavailable', NULL, NULL, NULL FROM mis m LEFT JOIN cnt ON m.document_id = cnt.document_id AND m.line_number = cnt.line_number WHERE missing <> 0),
  costs AS (SELECT 'invoice' AS document_type, s.document_id, s.line_number, s.product_key, s.quantity, s.net_sales, coalesce(tk, 0) AS costed_quantity, CAST(m.missing AS DOUBLE) AS uncosted_quantity, coalesce(cg, 0) AS cogs,
      CASE WHEN m.missing <> 0 AND coalesce(tk, 0) <> 0 THEN 'partial' WHEN m.missing <> 0 THEN 'unavailable' ELSE 'costed' END AS cost_status
    FROM pos s JOIN mis m ON s.document_id = m.document_id AND s.line_number = m.line_number
    LEFT JOIN (SELECT document_id, line_number, CAST(sum(taken) AS DOUBLE) AS tk, CAST(round(sum(exact), 2) AS DOUBLE) AS cg FROM num GROUP BY 1, 2) g ON s.document_id = g.document_id AND s.line_number = g.line_number)"""
)
RAW_SQL = {
    "match_opening_products": f"WITH {CLASSIFIED} SELECT row_number, match, product_key FROM matched",
    "classify_opening": f"WITH {CLASSIFIED} SELECT row_number, classification, CAST(opening_quantity AS DOUBLE) AS opening_quantity, CAST(opening_value AS DOUBLE) AS opening_value FROM classified",
    "opening_import_summary": f"WITH {CLASSIFIED} SELECT classification, count(*) AS rows, CAST(coalesce(sum(opening_quantity), 0) AS DOUBLE) AS units, CAST(coalesce(sum(opening_value), 0) AS DOUBLE) AS value FROM classified GROUP BY 1",
    "opening_value_check": f"WITH {CLASSIFIED} SELECT count(*) AS layers, CAST(coalesce(sum(quantity), 0) AS DOUBLE) AS units, CAST(coalesce(sum(quantity * unit_cost), 0) AS DOUBLE) AS value FROM layers WHERE source = 'opening'",
    "cost_layers": f"WITH {CLASSIFIED} SELECT product_key, layer_id, opened_on, source, source_document_id, source_line_number, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_cost AS DOUBLE) AS unit_cost FROM layers",
    "sales_sequence": f"WITH {CLASSIFIED} SELECT document_type, document_id, line_number, product_key, seq FROM seqd",
    "fifo_allocate_invoices": f"WITH {ALLOCATED} SELECT document_id, line_number, product_key, sequence, quantity_allocated, unit_cost, cost_amount, allocation_type, confidence, layer_id FROM alloc",
    "line_cost_status_invoices": f"WITH {ALLOCATED} SELECT {', '.join(SHOWN)} FROM costs",
    "layer_balances_invoices": f"WITH {ALLOCATED} SELECT l.product_key, l.layer_id, source, CAST(quantity AS DOUBLE) AS quantity, coalesce(t, 0) AS taken, CAST(quantity AS DOUBLE) - coalesce(t, 0) AS remaining, CASE WHEN CAST(quantity AS DOUBLE) - coalesce(t, 0) > 0 THEN 'open' ELSE 'depleted' END AS status FROM layers l LEFT JOIN (SELECT layer_id, sum(quantity_allocated) AS t FROM alloc WHERE allocation_type = 'fifo' GROUP BY 1) a ON l.layer_id = a.layer_id",
    "cost_run_summary_invoices": f"WITH {ALLOCATED} SELECT count(*) AS lines_read, count(*) FILTER (WHERE cost_status = 'costed') AS lines_costed, count(*) FILTER (WHERE cost_status = 'partial') AS lines_partial, count(*) FILTER (WHERE cost_status = 'unavailable') AS lines_unavailable, CAST(sum(quantity) AS DOUBLE) AS sales_units, sum(costed_quantity) AS costed_units, CAST(sum(CAST(cogs AS DECIMAL(18,2))) AS DOUBLE) AS cogs, CASE WHEN count(*) FILTER (WHERE cost_status IN ('partial', 'unavailable')) > 0 THEN 'succeeded_with_exceptions' ELSE 'succeeded' END AS status FROM costs",
    "apply_costs_to_facts_invoices": f"""WITH {ALLOCATED} SELECT cost_status, count(*) AS lines, CAST(sum(net_sales) AS DOUBLE) AS net_sales, CAST(coalesce(sum(cogs), 0) AS DOUBLE) AS cogs, CAST(coalesce(sum(margin), 0) AS DOUBLE) AS margin FROM (
        SELECT f.net_sales, CASE WHEN f.date < DATE '1998-01-01' THEN 'outside_scope' ELSE c.cost_status END AS cost_status, CAST(c.cogs AS DECIMAL(18,2)) AS cogs, CASE WHEN c.cost_status = 'costed' THEN f.net_sales - CAST(c.cogs AS DECIMAL(18,2)) END AS margin
        FROM sales_lines f LEFT JOIN costs c ON f.document_type = c.document_type AND f.document_id = c.document_id AND f.line_number = c.line_number WHERE f.document_type = 'invoice' AND NOT f.is_deleted) GROUP BY 1""",
    "sales_cost_supplier_invoices": f"""WITH {ALLOCATED}, par AS (SELECT a.*, sum(quantity_allocated) OVER (PARTITION BY document_id, line_number) AS whole FROM alloc a WHERE allocation_type <> 'unavailable'),
      agg AS (SELECT coalesce(c.name, 'Sin proveedor/costo de apertura') AS supplier, f.currency_code, round(sum(CAST(f.net_sales AS DOUBLE) * quantity_allocated / whole), 4) AS attributed_net_sales, round(sum(cost_amount), 4) AS cogs, sum(quantity_allocated) AS allocated_units,
        count(DISTINCT a.document_id) AS documents, count(DISTINCT a.product_key) AS products, count(*) AS allocation_rows FROM par a JOIN fact_sales f ON f.document_type = 'invoice' AND f.document_id = a.document_id AND f.line_number = a.line_number
        LEFT JOIN fact_purchases b ON b.document_id = a.source_document_id AND b.line_number = a.source_line_number AND NOT b.is_deleted LEFT JOIN dim_contact c ON b.provider_key = c.contact_key WHERE NOT f.is_deleted AND f.date BETWEEN DATE '{YEAR.from_date}' AND DATE '{YEAR.to_date}' GROUP BY 1, 2)
      SELECT *, round(attributed_net_sales - cogs, 4) AS gross_margin, round(coalesce(round(attributed_net_sales - cogs, 4) / nullif(attributed_net_sales, 0) * 100, 0), 4) AS gross_margin_pct, round(coalesce(attributed_net_sales / nullif(sum(attributed_net_sales) OVER (PARTITION BY currency_code), 0) * 100, 0), 6) AS share_pct FROM agg ORDER BY attributed_net_sales DESC, supplier, currency_code LIMIT 100""",
}
#: The job over all lines. Returns are priced one after the other, of all products at once.
WHOLE = (
    CLASSIFIED
    + """,
  lay AS (SELECT *, hi - quantity AS lo FROM (SELECT *, sum(quantity) OVER w AS hi, CAST(sum(quantity * unit_cost) OVER w - quantity * unit_cost AS DOUBLE) AS worth FROM layers
    WINDOW w AS (PARTITION BY product_key ORDER BY opened_on, source = 'purchase', coalesce(source_document_id, ''), source_line_number, layer_id))),
  sup AS (SELECT product_key AS p, sum(quantity) AS supply, CAST(sum(quantity * unit_cost) AS DOUBLE) AS supply_value FROM layers GROUP BY 1),
  run AS (SELECT *, sum(quantity) OVER w AS net, sum(greatest(quantity, 0)) OVER w AS asked, sum(greatest(-quantity, 0)) OVER w AS back FROM seqd LEFT JOIN sup ON product_key = p WINDOW w AS (PARTITION BY product_key ORDER BY seq)),
  ask AS (SELECT *, asked - greatest(max(net) OVER (PARTITION BY product_key ORDER BY seq) - supply, 0) AS used FROM run),
  pos AS (SELECT *, CASE WHEN quantity < 0 THEN supply + back + quantity ELSE lag(used, 1, 0) OVER (PARTITION BY product_key ORDER BY seq) END AS lo, CASE WHEN quantity < 0 THEN supply + back ELSE used END AS hi FROM ask),
  every AS (SELECT product_key, layer_id, lo, hi, unit_cost, NULL AS return_seq, worth, source, source_document_id, source_line_number FROM lay
    UNION ALL SELECT product_key, 'R' || document_id || '/' || line_number, lo, hi, NULL, seq, NULL, 'return', NULL, NULL FROM pos WHERE quantity < 0 AND supply IS NOT NULL),
  ret AS (SELECT r.*, l.lo AS at, l.unit_cost AS at_cost, l.worth AS at_worth, l.return_seq, row_number() OVER (PARTITION BY r.product_key ORDER BY r.seq) AS k
    FROM pos r LEFT JOIN every l ON l.product_key = r.product_key AND l.lo < r.used AND r.used <= l.hi WHERE quantity < 0 AND supply IS NOT NULL),
  src AS (SELECT r.*, o.k AS j FROM ret r LEFT JOIN ret o ON o.product_key = r.product_key AND o.seq = r.return_seq),
  walk AS (WITH RECURSIVE go AS (
      SELECT p AS product_key, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS vs, CAST([] AS DOUBLE[]) AS xs, supply_value AS v, CAST(0 AS DOUBLE) AS x FROM sup
      UNION ALL SELECT product_key, k, list_append(vs, v), list_append(xs, nx), v + CAST(-quantity AS DOUBLE) * nx, nx FROM (
        SELECT go.vs, go.xs, go.v, s.product_key, s.k, s.quantity, CASE WHEN s.used = 0 THEN s.supply_value / CAST(s.supply AS DOUBLE)
            WHEN s.j IS NULL THEN (s.at_worth + CAST(s.used - s.at AS DOUBLE) * CAST(s.at_cost AS DOUBLE)) / CAST(s.used AS DOUBLE)
            ELSE (go.vs[s.j] + CAST(s.used - s.at AS DOUBLE) * go.xs[s.j]) / CAST(s.used AS DOUBLE) END AS nx
        FROM go JOIN src s ON s.product_key = go.product_key AND s.k = go.k + 1))
    SELECT product_key, k, x FROM go WHERE k > 0),
  price AS (SELECT src.product_key, src.seq, CAST(x AS DECIMAL(28,10)) AS price FROM src JOIN walk ON src.product_key = walk.product_key AND src.k = walk.k),
  seg AS (SELECT s.product_key, document_type, document_id, line_number, greatest(s.lo, l.lo) AS pt, least(s.hi, l.hi) - greatest(s.lo, l.lo) AS taken, l.layer_id, coalesce(l.unit_cost, price) AS unit_cost, l.source, l.source_document_id, l.source_line_number
    FROM pos s JOIN every l ON s.product_key = l.product_key AND s.lo < l.hi AND l.lo < s.hi LEFT JOIN price ON price.product_key = l.product_key AND price.seq = l.return_seq WHERE s.quantity > 0 AND s.hi > s.lo),
  num AS (SELECT *, row_number() OVER w - 1 AS sequence, count(*) OVER (PARTITION BY document_type, document_id, line_number) AS n, sum(exact) OVER (PARTITION BY document_type, document_id, line_number) AS total, sum(exact) OVER w AS upto
    FROM (SELECT *, round(taken * unit_cost, 6) AS exact FROM seg) WINDOW w AS (PARTITION BY document_type, document_id, line_number ORDER BY pt)),
  mis AS (SELECT *, CASE WHEN quantity > 0 THEN quantity - CASE WHEN supply IS NULL THEN 0 ELSE hi - lo END WHEN supply IS NULL THEN quantity ELSE 0 END AS missing FROM pos),
  cnt AS (SELECT document_type, document_id, line_number, max(n) AS n FROM num GROUP BY 1, 2, 3),
  alloc AS (SELECT document_type, document_id, line_number, product_key, CAST(sequence AS INT) AS sequence, CAST(taken AS DOUBLE) AS quantity_allocated, CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(CASE WHEN sequence = n - 1 THEN round(total, 2) - (upto - exact) ELSE exact END AS DOUBLE) AS cost_amount, 'fifo' AS allocation_type,
      CASE WHEN source = 'opening' THEN 'certified' ELSE 'source' END AS confidence, layer_id, source_document_id, source_line_number, exact FROM num
    UNION ALL SELECT document_type, document_id, line_number, pos.product_key, 0, CAST(quantity AS DOUBLE), CAST(price AS DOUBLE), CAST(round(round(quantity * price, 6), 2) AS DOUBLE), 'credit_note_return', 'estimated', 'R' || document_id || '/' || line_number, NULL, NULL, round(quantity * price, 6) FROM pos JOIN price ON pos.product_key = price.product_key AND pos.seq = price.seq
    UNION ALL SELECT m.document_type, m.document_id, m.line_number, product_key, CAST(coalesce(n, 0) AS INT), CAST(missing AS DOUBLE), NULL, 0, 'unavailable', 'unavailable', NULL, NULL, NULL, 0 FROM mis m LEFT JOIN cnt ON m.document_type = cnt.document_type AND m.document_id = cnt.document_id AND m.line_number = cnt.line_number WHERE missing <> 0),
  costs AS (SELECT s.document_type, s.document_id, s.line_number, s.product_key, s.quantity, s.net_sales, coalesce(tk, 0) AS costed_quantity, CAST(s.missing AS DOUBLE) AS uncosted_quantity, coalesce(cg, 0) AS cogs,
      CASE WHEN s.missing <> 0 AND coalesce(tk, 0) <> 0 THEN 'partial' WHEN s.missing <> 0 THEN 'unavailable' WHEN s.document_type = 'credit_note' THEN 'estimated' ELSE 'costed' END AS cost_status
    FROM mis s LEFT JOIN (SELECT document_type, document_id, line_number, sum(quantity_allocated) AS tk, CAST(round(sum(exact), 2) AS DOUBLE) AS cg FROM alloc WHERE allocation_type <> 'unavailable' GROUP BY 1, 2, 3) g ON s.document_type = g.document_type AND s.document_id = g.document_id AND s.line_number = g.line_number)"""
)
WHOLE_SQL = {
    "fifo_allocate": f"WITH {WHOLE} SELECT document_type, document_id, line_number, product_key, sequence, quantity_allocated, round(unit_cost, 6) AS unit_cost, round(cost_amount, 6) AS cost_amount, allocation_type, confidence, layer_id FROM alloc",
    "line_cost_status": f"WITH {WHOLE} SELECT {', '.join(SHOWN)} FROM costs",
    "layer_balances": f"""WITH {WHOLE} SELECT l.product_key, l.layer_id, source, CAST(hi - lo AS DOUBLE) AS quantity, coalesce(t, 0) AS taken, CAST(hi - lo AS DOUBLE) - coalesce(t, 0) AS remaining, CASE WHEN CAST(hi - lo AS DOUBLE) - coalesce(t, 0) > 0 THEN 'open' ELSE 'depleted' END AS status
        FROM every l LEFT JOIN (SELECT layer_id, sum(quantity_allocated) AS t FROM alloc WHERE allocation_type = 'fifo' GROUP BY 1) a ON l.layer_id = a.layer_id""",
    "cost_run_summary": f"""WITH {WHOLE} SELECT count(*) AS lines_read, count(*) FILTER (WHERE cost_status IN ('costed', 'estimated')) AS lines_costed, count(*) FILTER (WHERE cost_status = 'partial') AS lines_partial, count(*) FILTER (WHERE cost_status = 'unavailable') AS lines_unavailable, CAST(sum(quantity) AS DOUBLE) AS sales_units, sum(costed_quantity) AS costed_units,
        CAST(sum(CAST(cogs AS DECIMAL(18,2))) AS DOUBLE) AS cogs, CASE WHEN count(*) FILTER (WHERE cost_status IN ('partial', 'unavailable')) > 0 THEN 'succeeded_with_exceptions' ELSE 'succeeded' END AS status FROM costs""",
    "apply_costs_to_facts": f"""WITH {WHOLE} SELECT cost_status, count(*) AS lines, CAST(sum(net_sales) AS DOUBLE) AS net_sales, CAST(coalesce(sum(cogs), 0) AS DOUBLE) AS cogs, CAST(coalesce(sum(margin), 0) AS DOUBLE) AS margin FROM (
        SELECT f.net_sales, CASE WHEN f.date < DATE '1998-01-01' THEN 'outside_scope' ELSE c.cost_status END AS cost_status, CAST(c.cogs AS DECIMAL(18,2)) AS cogs, CASE WHEN c.cost_status IN ('costed', 'estimated') THEN f.net_sales - CAST(c.cogs AS DECIMAL(18,2)) END AS margin
        FROM sales_lines f LEFT JOIN costs c ON f.document_type = c.document_type AND f.document_id = c.document_id AND f.line_number = c.line_number WHERE NOT f.is_deleted) GROUP BY 1""",
    "sales_cost_supplier": f"""WITH {WHOLE}, par AS (SELECT a.*, sum(quantity_allocated) OVER (PARTITION BY document_type, document_id, line_number) AS whole FROM alloc a WHERE allocation_type <> 'unavailable'),
      agg AS (SELECT coalesce(c.name, 'Sin proveedor/costo de apertura') AS supplier, f.currency_code, round(sum(CAST(f.net_sales AS DOUBLE) * quantity_allocated / whole), 4) AS attributed_net_sales, round(sum(cost_amount), 4) AS cogs, sum(quantity_allocated) AS allocated_units,
        count(DISTINCT a.document_type || a.document_id) AS documents, count(DISTINCT a.product_key) AS products, count(*) AS allocation_rows FROM par a JOIN fact_sales f ON f.document_type = a.document_type AND f.document_id = a.document_id AND f.line_number = a.line_number
        LEFT JOIN fact_purchases b ON b.document_id = a.source_document_id AND b.line_number = a.source_line_number AND NOT b.is_deleted LEFT JOIN dim_contact c ON b.provider_key = c.contact_key WHERE NOT f.is_deleted AND f.date BETWEEN DATE '{YEAR.from_date}' AND DATE '{YEAR.to_date}' GROUP BY 1, 2)
      SELECT *, round(attributed_net_sales - cogs, 4) AS gross_margin, round(coalesce(round(attributed_net_sales - cogs, 4) / nullif(attributed_net_sales, 0) * 100, 0), 4) AS gross_margin_pct, round(coalesce(attributed_net_sales / nullif(sum(attributed_net_sales) OVER (PARTITION BY currency_code), 0) * 100, 0), 6) AS share_pct FROM agg ORDER BY attributed_net_sales DESC, supplier, currency_code LIMIT 100""",
}
RAW_SQL |= WHOLE_SQL | {f"{k}_all_lines": v for k, v in WHOLE_SQL.items()} | {"fifo_returns": WHOLE_SQL["line_cost_status"]}
SQL = {k: with_fixtures(v) for k, v in RAW_SQL.items()}
