"""A tenant's mart rebuilt from its typed tables: staged under a run, published by the run's record.

Each run writes all its tables below path/<run_id>, every one made from those written before
it. Nothing is seen until the run is recorded as succeeded: published() reads the tables of
each tenant's latest such run. So a tenant without documents gets empty facts, and a run
that fails leaves what was published, and a record of its error.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.operators import costing, inventory, mart
from martloom.operators import purchases as buy
from martloom.sources.sinks import counted, read_runs, record_run

#: Dimensions with keys of their own: source and key.
KEYED = {"dim_product": ("items", "product_key"), "dim_contact": ("contacts", "contact_key"), "dim_seller": ("sellers", "seller_key"), "dim_warehouse": ("warehouses", "warehouse_key")}
#: Sources with one row for each day of something.
DATED = ("invoices", "credit_notes", "bills", "payments", "adjustment_lines", "transfer_lines")


def latest_runs(spark: SparkSession, path: str) -> dict[str, str]:
    """The run of each tenant's published tables: one pair a tenant."""
    done = read_runs(spark, f"{path}/runs").filter("kind = 'mart' and status = 'succeeded'")
    return dict(done.groupBy("tenant_id").agg(F.max_by("run_id", F.struct("finished_at", "run_id"))).collect())


def published(spark: SparkSession, path: str, name: str, tenant_id: str | None = None) -> DataFrame | None:
    """A published table of all tenants or of one; None before the first run."""
    runs = latest_runs(spark, path)
    wanted = [run for tenant, run in sorted(runs.items()) if tenant_id in (None, tenant)]
    return spark.read.parquet(*[f"{path}/{run}/{name}" for run in wanted]) if wanted else None


def _dimension(old: DataFrame | None, source: DataFrame, key: str) -> DataFrame:
    """The dimension with its published keys; rows that the source hasn't any more stay."""
    source = source.drop(key)
    if old is None:
        old = source.limit(0).withColumn(key, F.lit(None).cast("long"))
    return mart.upsert_dim(old, source, key)


def _stock(rows: DataFrame, d: dict[str, DataFrame], **keys: str) -> DataFrame:
    """Lines of stock documents with their product and warehouses by key; keys: column of the id -> column of the key."""
    rows = mart.keyed(rows, d["dim_product"], "item_id", "product_key", "product_key").drop("item_id")
    for source, key in keys.items():
        rows = mart.keyed(rows, d["dim_warehouse"], source, "warehouse_key", key).drop(source)
    return rows


def cost_facts(d: dict[str, DataFrame], stage: Callable[[str, DataFrame], DataFrame], opening: DataFrame, cutoff: date) -> str:
    """FIFO over the staged facts: stages cost_layers, cost_allocations and fact_sales with costs laid over. Without an opening layer at the cutoff facts have no costs."""
    stage("cost_layers", costing.cost_layers(costing.classify_opening(opening, d["dim_product"]), d["fact_purchases"], cutoff))
    status, facts = costing.allocation_status(d["cost_layers"], cutoff), d["staged_sales"]
    lines = facts.filter("not is_deleted")
    ready = status == "ready"
    allocations = costing.fifo_allocate(lines if ready else lines.limit(0), d["cost_layers"], cutoff)
    stage("cost_allocations", allocations)
    costs = stage("cost_lines", costing.line_costs(lines, d["cost_allocations"]))
    costed = costing.apply_costs(facts, costs, cutoff)
    stage("fact_sales", costed if ready else costed.withColumn("cost_status", F.lit(None).cast("string")))
    return costing.run_summary(costs).first()["status"] if ready else status


def refresh(spark: SparkSession, path: str, tenant_id: str, run_id: str, sources: dict[str, DataFrame], cutoff: date, clock: Callable[[], datetime]) -> dict[str, int]:
    """Rebuilds a tenant's mart and publishes it; gives the rows of each table, as counted while they were written.

    sources are typed tables of all tenants by name: tenants, items, contacts, sellers,
    warehouses, invoices, invoice_lines, credit_notes, credit_note_lines, bills, bill_lines,
    payments, snapshot_rows, adjustment_lines, transfer_lines (with ids) and opening_report.
    Two records are left: mart (rows by table) and cost (its status). If a step fails, both are
    recorded as failed with the error, which is raised again; the published tables stay. The
    jobs run when this is called. clock gives the time for the records.
    """
    started = clock()
    mine = {name: df.filter(F.col("tenant_id") == tenant_id) for name, df in sources.items()}
    d: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        at = f"{path}/{run_id}/{name}"
        counts[name] = counted(df, lambda x: x.write.parquet(at))
        d[name] = spark.read.schema(df.schema).parquet(at)
        return d[name]

    try:
        stage("dim_tenant", mart.dim_tenant(mine["tenants"]))
        for name, (source, key) in KEYED.items():
            rows = mart.dim_product(mine[source]) if name == "dim_product" else mine[source]
            stage(name, _dimension(published(spark, path, name, tenant_id), rows, key))
        stage("dim_date", mart.dim_date(*[mine[n] for n in DATED]))
        stage("fact_purchases", mart.fact_purchases(mine["bills"], mine["bill_lines"], d["dim_product"], d["dim_contact"]))
        stage("fact_payments", mart.fact_payments(mine["payments"], d["dim_contact"]))
        stage("fact_snapshots", mart.fact_snapshots(mine["snapshot_rows"], d["dim_product"], d["dim_warehouse"]))
        adjusted = _stock(mine["adjustment_lines"], d, warehouse_id="warehouse_key")
        stage("fact_movements", inventory.fact_movements(adjusted, _stock(mine["transfer_lines"], d, source_id="source_key", destination_id="destination_key")))
        sold = [mine[n] for n in ("invoices", "invoice_lines", "credit_notes", "credit_note_lines")]
        stage("staged_sales", mart.fact_sales(*sold, *[d[n] for n in KEYED]))
        stage("derived_modes", buy.product_supplier_mode(d["fact_purchases"]))
        stage("derived_stats", buy.supplier_product_stats(d["fact_purchases"]))
        status = cost_facts(d, stage, mine["opening_report"], cutoff)
    except Exception as error:
        for kind in ("mart", "cost"):
            record_run(spark, f"{path}/runs", run_id, tenant_id, kind, "failed", started, clock(), counts, str(error))
        raise
    record_run(spark, f"{path}/runs", run_id, tenant_id, "cost", status, started, clock(), {"lines": counts["cost_lines"]})
    record_run(spark, f"{path}/runs", run_id, tenant_id, "mart", "succeeded", started, clock(), counts)
    return counts
