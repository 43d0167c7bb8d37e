"""The given test tables seen as mart tables. The SQL is common to Spark and the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martloom.sources.sinks import stored

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ALL_COLUMNS = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"

FIXTURES = {
    "dim_product": """
        SELECT 't1' AS tenant_id, p_partkey + 1 AS product_key, cast(p_partkey AS string) AS external_id, p_name AS name,
          concat('REF-', cast(p_partkey AS string)) AS reference, p_brand AS item_type,
          CASE WHEN p_size % 10 = 0 THEN 'SIN FAMILIA' ELSE p_type END AS family_name,
          CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS preferred_supplier_name,
          p_size % 7 <> 0 AS inventory_enabled, cast(cast(p_retailprice AS decimal(18,2)) * 0.60 AS decimal(18,2)) AS current_cost,
          p_partkey % 101 = 100 AS is_deleted
        FROM {part}""",
    "dim_contact": """
        SELECT 't1' AS tenant_id, c_custkey + 1 AS contact_key, c_name AS name, 'client' AS contact_type FROM {customer}
        UNION ALL SELECT 't1', 10000001 + s_suppkey, s_name, 'provider' FROM {supplier}""",
    "dim_seller": "SELECT 't1' AS tenant_id, cast(n_nationkey + 1 AS bigint) AS seller_key, n_name AS name, n_nationkey % 9 = 8 AS is_deleted FROM {nation}",
    "dim_warehouse": "SELECT 't1' AS tenant_id, cast(r_regionkey + 1 AS bigint) AS warehouse_key, r_name AS name, r_regionkey = 4 AS is_deleted FROM {region}",
    "sales_lines": f"""
        SELECT 't1' AS tenant_id, document_type, cast(l_orderkey AS string) AS document_id,
          cast(row_number() OVER (PARTITION BY document_type, l_orderkey ORDER BY {ALL_COLUMNS}) AS int) AS line_number,
          cast(o_orderdate AS date) AS date, o_orderstatus AS document_status,
          CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey + 1 END AS product_key, o_custkey + 1 AS contact_key,
          CASE WHEN document_type = 'invoice' THEN o_orderkey % 25 + 1 END AS seller_key,
          CASE WHEN document_type = 'credit_note' THEN o_orderkey % 5 + 1 END AS warehouse_key,
          CASE WHEN o_orderkey % 10 = 0 THEN 'USD' ELSE 'COP' END AS currency_code,
          cast(sign * l_quantity AS decimal(18,4)) AS quantity, cast(sign * cast(l_extendedprice AS decimal(18,2)) AS decimal(18,2)) AS net_sales,
          o_orderkey % 97 = 0 AS is_deleted, l_orderkey AS order_key
        FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity <= 10 THEN 'credit_note' ELSE 'invoice' END AS document_type,
                CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity <= 10 THEN -1 ELSE 1 END AS sign
              FROM {{lineitem}} WHERE l_returnflag <> 'A') x JOIN {{orders}} o ON l_orderkey = o_orderkey""",
    "fact_sales": """
        SELECT s.*, cost_status, CASE WHEN cost_status IN ('costed', 'estimated', 'partial') THEN cast(quantity * current_cost AS decimal(18,2)) END AS cogs,
          CASE WHEN cost_status IN ('costed', 'estimated') THEN cast(net_sales - cast(quantity * current_cost AS decimal(18,2)) AS decimal(18,2)) END AS margin
        FROM (SELECT *, CASE WHEN date < DATE '1998-01-01' THEN 'outside_scope' WHEN product_key IS NULL OR order_key % 11 = 0 THEN 'unavailable'
                WHEN order_key % 11 = 1 THEN 'partial' WHEN document_type = 'credit_note' THEN 'estimated' ELSE 'costed' END AS cost_status
              FROM {sales_lines}) s LEFT JOIN (SELECT product_key AS pk, current_cost FROM {dim_product}) p ON s.product_key = p.pk""",
    "fact_purchases": f"""
        SELECT 't1' AS tenant_id, concat('B', cast(l_orderkey AS string), '-', cast(l_suppkey AS string)) AS document_id,
          cast(row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {ALL_COLUMNS}) AS int) AS line_number,
          cast(l_shipdate AS date) AS date, l_linestatus AS document_status, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey + 1 END AS product_key,
          10000001 + l_suppkey AS provider_key, cast(NULL AS bigint) AS warehouse_key,
          CASE WHEN l_orderkey % 10 = 0 THEN 'USD' ELSE 'COP' END AS currency_code,
          cast(l_quantity AS decimal(18,4)) AS quantity, unit_cost, cast(l_quantity AS decimal(18,4)) * unit_cost AS raw_amount,
          cast(cast(l_quantity AS decimal(18,4)) * unit_cost AS decimal(18,2)) AS amount, l_orderkey % 97 = 0 AS is_deleted
        FROM (SELECT *, CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN NULL
                ELSE cast(cast(cast(p_retailprice AS decimal(18,2)) * 0.50 AS decimal(18,2)) + l_suppkey % 11 AS decimal(18,4)) END AS unit_cost
              FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_returnflag = 'A') x""",
    "fact_payments": """
        SELECT 't1' AS tenant_id, cast(event_id AS string) AS payment_id, cast(ts AS date) AS date, user_id + 1 AS contact_key,
          CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS payment_type,
          CASE WHEN event_id % 10 = 0 THEN 'USD' ELSE 'COP' END AS currency_code, cast(value AS decimal(18,2)) AS amount, event_id % 97 = 0 AS is_deleted
        FROM {events} WHERE event_type = 'purchase'""",
    "snapshot_runs": """
        SELECT 't1' AS tenant_id, run_id, status, finished_at FROM (
          SELECT '1' AS run_id, 'succeeded' AS status, TIMESTAMP '2001-07-30 10:00:00' AS finished_at
          UNION ALL SELECT '2', 'succeeded', TIMESTAMP '2001-07-31 10:00:00' UNION ALL SELECT '3', 'failed', TIMESTAMP '2001-07-31 12:00:00') r""",
    "fact_snapshots": """
        SELECT 't1' AS tenant_id, run_id, p_partkey + 1 AS product_key, cast(r_regionkey + 1 AS bigint) AS warehouse_key, cast(quantity AS decimal(18,4)) AS quantity,
          CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE cast(cast(p_retailprice AS decimal(18,2)) * 0.60 AS decimal(18,2)) END AS unit_cost,
          CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE cast(quantity * cast(cast(p_retailprice AS decimal(18,2)) * 0.60 AS decimal(18,2)) AS decimal(18,2)) END AS value
        FROM (SELECT *, CASE WHEN p_name LIKE '% gear' THEN 0 - r_regionkey % 2 WHEN p_name LIKE '% bolt' THEN 0 WHEN p_partkey % 5 = 1 THEN 1
                ELSE (p_partkey * 7 + r_regionkey * 13 + cast(run_id AS int)) % 120 - 10 END AS quantity
              FROM {part}, {region}, (SELECT '1' AS run_id UNION ALL SELECT '2' UNION ALL SELECT '3') r) shelf""",
    "adjustment_lines": """
        SELECT 't1' AS tenant_id, cast(event_id AS string) AS document_id, 1 AS line_number, cast(ts AS date) AS date,
          event_id % (SELECT count(*) FROM {part}) + 1 AS product_key, user_id % 5 + 1 AS warehouse_key,
          cast(cast(regexp_replace(props, '[^0-9]', '', 'g') AS int) - 50 AS decimal(18,4)) AS quantity, event_id % 97 = 0 AS is_deleted
        FROM {events} WHERE event_type = 'error'""",
    "transfer_lines": """
        SELECT 't1' AS tenant_id, cast(event_id AS string) AS document_id, 1 AS line_number, cast(ts AS date) AS date,
          event_id % (SELECT count(*) FROM {part}) + 1 AS product_key, user_id % 5 + 1 AS source_key, (user_id + 1) % 5 + 1 AS destination_key,
          cast(cast(regexp_replace(props, '[^0-9]', '', 'g') AS int) AS decimal(18,4)) AS quantity, event_id % 97 = 0 AS is_deleted
        FROM {events} WHERE event_type = 'view'""",
    "opening_report": """
        SELECT p_partkey + 2 AS row_number, concat('  ', upper(p_name), '  ') AS item, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat('ref-', cast(p_partkey AS string)) END AS reference,
          cast((p_partkey * 37) % 60 - 5 AS decimal(18,4)) AS quantity,
          CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE cast(cast(p_retailprice AS decimal(18,2)) * 0.60 AS decimal(18,2)) END AS average_cost
        FROM {part}""",
    "supplier_policies": """
        SELECT 10000001 + s_suppkey AS supplier_key, 'COP' AS currency_code, cast(s_suppkey % 7 * 5000 AS double) AS minimum_order_amount, cast(s_suppkey % 5 * 10 AS double) AS shipping_cost,
          CASE WHEN s_suppkey % 2 = 0 THEN cast(40000 AS double) END AS free_shipping_threshold, cast(s_suppkey % 4 * 5 AS int) AS default_lead_time_days, cast(s_suppkey % 6 * 3 AS int) AS max_wait_days
        FROM {supplier} WHERE s_suppkey % 3 = 0""",
    "product_policies": """
        SELECT supplier_key, product_key, 'COP' AS currency_code, cast(product_key % 9 * 4 AS double) AS minimum_order_quantity, cast(product_key % 3 * 6 AS double) AS pack_size,
          CASE WHEN product_key % 5 = 0 THEN NULL ELSE cast(product_key % 11 AS int) END AS lead_time_days, cast(NULL AS int) AS max_wait_days, (product_key - 1) % 80 = 0 AS is_preferred
        FROM (SELECT product_key, min(provider_key) AS supplier_key FROM {fact_purchases} WHERE NOT is_deleted AND currency_code = 'COP' AND (product_key - 1) % 20 = 0 GROUP BY product_key) x""",
    "review_actions": "SELECT p_partkey + 1 AS product_key, 'reviewed' AS status, 'n' AS note FROM {part} WHERE p_partkey % 15 = 0",
}
#: A global flag only the checking engine's regexp_replace needs.
SPARK_TEXT = {", 'g')": ")"}


class Marts:
    """Mart tables of a folder of test tables, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}
        self.kept: set[str] = set()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in SOURCES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in FIXTURES:
                text = FIXTURES[name]
                for a, b in SPARK_TEXT.items():
                    text = text.replace(a, b)
                needed = [n for n in (*SOURCES, *FIXTURES) if f"{{{n}}}" in text]
                self.made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in needed})
            else:
                raise AttributeError(name)
        return self.made[name]


def keep(m: Marts, *names: str) -> None:
    """Writes tables once, as a source has them, for queries that read them again and again; those made of them since read what was written."""
    for name in names:
        if name not in m.kept:
            m.made[name] = stored(getattr(m, name))
            m.kept.add(name)


def with_fixtures(query: str) -> str:
    """The query with the mart tables that it names, and theirs, before it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in FIXTURES:
            if name not in wanted and (f"{{{name}}}" in text or name in text.replace("{", " ").replace("}", " ").replace(",", " ").replace(")", " ").replace("(", " ").split()):
                need(FIXTURES[name])
                wanted.append(name)

    need(query)
    if not wanted:
        return query
    names = {n: n for n in (*SOURCES, *FIXTURES)}
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n].format(**names)})" for n in wanted) + "\n" + (", " + query.strip()[5:] if query.strip().upper().startswith("WITH ") else query)
