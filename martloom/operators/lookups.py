"""Values for report filters, and how fresh the mart is."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions.cols import NO_FAMILY


def date_range(fact: DataFrame) -> DataFrame:
    return fact.filter("not is_deleted").agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"))


def currencies(*facts: DataFrame) -> DataFrame:
    """Different currencies of the facts. Each is made distinct before the union."""
    each = [f.filter("not is_deleted and currency_code is not null").select("currency_code").distinct() for f in facts]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    return out.distinct()


def statuses(fact: DataFrame) -> DataFrame:
    return fact.filter("not is_deleted and document_status is not null").select("document_status").distinct()


def families(products: DataFrame) -> DataFrame:
    return products.filter("not is_deleted").select(F.coalesce("family_name", F.lit(NO_FAMILY)).alias("family")).distinct()


def suppliers(purchases: DataFrame, contacts: DataFrame) -> DataFrame:
    """Providers with purchases."""
    used = purchases.filter("not is_deleted and provider_key is not null").select(F.col("provider_key").alias("_pk")).distinct()
    return contacts.join(used, F.col("contact_key") == F.col("_pk"), "left_semi").select(F.col("contact_key").alias("key"), "name")


def members(dim: DataFrame, key: str, top: int | None = 500) -> DataFrame:
    """Active members of a dimension by name."""
    rows = dim.filter("not is_deleted").select(F.col(key).alias("key"), "name")
    return rows if top is None else rows.orderBy("name", "key").limit(top)


def refresh_status(mart_runs: DataFrame, cost_runs: DataFrame, now: datetime, stale_hours: int = 2) -> DataFrame:
    """Each tenant's latest succeeded mart run and latest cost run; stale when the mart run is older than stale_hours. Columns say which run they are of."""
    done = mart_runs.filter("status = 'succeeded'").groupBy("tenant_id").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("mart_run_id"), F.max("finished_at").alias("mart_finished_at"))
    cost = cost_runs.groupBy(F.col("tenant_id").alias("_t")).agg(F.max_by(F.struct("run_id", "status"), F.struct("finished_at", "run_id")).alias("c"))
    age = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {stale_hours} HOURS")
    return done.join(cost, F.col("tenant_id") == F.col("_t"), "left").select("tenant_id", "mart_run_id", "mart_finished_at", (F.col("mart_finished_at") < age).alias("is_stale"), F.col("c.run_id").alias("cost_run_id"), F.col("c.status").alias("cost_status"))
