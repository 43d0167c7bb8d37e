"""Landing documents: batch dedup, raw versions, current state, soft deletes, lines, runs.

A batch: tenant_id, resource, external_id, payload, payload_hash, seq (order), received_at.
Raw versions have the same columns. Current state: tenant_id, resource, external_id,
payload, payload_hash, first_seen_at, last_seen_at, is_deleted.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["tenant_id", "resource", "external_id"]
MAX_ATTEMPTS, MAX_WAIT = 8, 3600


def last_of_batch(batch: DataFrame) -> DataFrame:
    """The last payload of each document; a row without external_id is an error. Rows are picked with partial aggregation."""
    key = F.when(F.col("external_id").isNull(), F.raise_error(F.lit("a document has no id")).cast("string")).otherwise(F.col("external_id"))
    rest = [c for c in batch.columns if c not in KEY]
    rows = batch.withColumn("external_id", key).groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("x"))
    return rows.select(*KEY, "x.*").select(*batch.columns)


def new_versions(batch: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows of the batch whose content raw hasn't: to be appended to it."""
    return last_of_batch(batch).join(raw.select(*KEY, "payload_hash"), [*KEY, "payload_hash"], "left_anti")


def upsert_current(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Current state with the batch: the newest payload, deleted rows revived, first_seen_at kept, last_seen_at moved on."""
    fresh = last_of_batch(batch).select(*KEY, "payload", "payload_hash", F.col("received_at").alias("first_seen_at"), F.col("received_at").alias("last_seen_at"), F.lit(False).alias("is_deleted"))
    both = current.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    g = both.groupBy(*KEY).agg(F.max_by(F.struct("payload", "payload_hash", "is_deleted"), "_new").alias("x"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return g.select(*KEY, "x.payload", "x.payload_hash", "first_seen_at", "last_seen_at", "x.is_deleted")


def upsert_projection(typed: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """A typed table with newer rows by key."""
    return typed.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def replace_lines(lines: DataFrame, batch_lines: DataFrame, documents: DataFrame, always: bool = False) -> DataFrame:
    """Lines with those of the batch's documents replaced. A document without an item list (has_items false) keeps its old lines, unless always."""
    replaced = documents if always else documents.filter("has_items")
    keys = ["tenant_id", "document_id"]
    return lines.join(replaced.select(*keys).distinct(), keys, "left_anti").unionByName(batch_lines)


def soft_delete(current: DataFrame, deletes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows named in deletes marked as deleted."""
    marked = deletes.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    rows = current.join(marked, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    return rows.withColumn("is_deleted", F.col("is_deleted") | F.col(f"_{keys[0]}").isNotNull()).select(*current.columns)


def retry_schedule(events: DataFrame) -> DataFrame:
    """Failed events with their next attempt: 2**n seconds after the n-th, an hour at most; after the eighth they have failed for good."""
    n = F.col("attempts")
    wait = F.least(F.pow(F.lit(2.0), n), F.lit(float(MAX_WAIT))).cast("int")
    over = n >= MAX_ATTEMPTS
    return events.withColumn("status", F.when(over, "failed").otherwise("pending")).withColumn("available_at", F.when(~over, F.timestamp_seconds(F.unix_timestamp("failed_at") + wait)))


def reconcile(current: DataFrame, extract: DataFrame, as_of: date, lookback_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Current state with the extract's documents of the last days, and how many of those were new."""
    recent = extract.filter(F.col("date").between(F.lit(as_of - timedelta(days=lookback_days)), F.lit(as_of))).drop("date")
    fresh = last_of_batch(recent)
    new = fresh.join(current.select(*KEY), KEY, "left_anti").agg(F.count("*").alias("new_documents"))
    return upsert_current(current, recent), new


def sync_state(runs: DataFrame) -> DataFrame:
    """Of each tenant and resource the last success and the last error."""
    ok, bad = F.col("status") == "succeeded", F.col("status") == "failed"
    return runs.groupBy("tenant_id", "resource").agg(F.max(F.when(ok, F.col("finished_at"))).alias("last_success_at"), F.max(F.when(bad, F.col("finished_at"))).alias("last_error_at"), F.max_by("error", F.when(bad, F.col("finished_at"))).alias("last_error"))
