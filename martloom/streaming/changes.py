"""Change events: parsed, told from repeats, and applied in order.

What has been seen is a state of the stream by tenant, subject and content, kept by RocksDB
and the checkpoint: a batch looks up its own keys, however many there have been. A batch
that comes again starts from the state before it and finds the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.functions.cols import json_at, text_of
from martloom.operators.landing import KEY, soft_delete, upsert_current
from martloom.sources.documents import canonical_hash

#: The entities whose events are taken; subjects are new-, edit- or delete- and the entity.
ENTITIES = ("invoice", "bill", "client", "item")
EVENT = T.StructType([T.StructField("tenant_id", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("message", T.StringType()), T.StructField("available_at", T.TimestampType()), T.StructField("created_at", T.TimestampType())])


def read_events(spark, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON files, one event a line."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def parse_events(events: DataFrame) -> DataFrame:
    """action, entity_type, external_id and payload_hash of supported subjects; others are dropped."""
    subject = F.split("subject", "-", 2)
    action, entity = F.get(subject, F.lit(0)), F.get(subject, F.lit(1))
    known = action.isin("new", "edit", "delete") & entity.isin(*ENTITIES)
    rows = events.filter(known).withColumn("action", action).withColumn("entity_type", entity)
    ids = F.coalesce(*[F.when(F.col("entity_type") == e, text_of(F.col("message"), f"{e}.id")) for e in ENTITIES])
    return rows.withColumn("external_id", ids).withColumn("payload_hash", canonical_hash(F.concat(F.lit('{"subject":"'), F.col("subject"), F.lit('","message":'), F.col("message"), F.lit("}"))))


def first_seen(events: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Events whose tenant, subject and content neither the log nor an earlier row of events has."""
    key = ["tenant_id", "subject", "payload_hash"]
    one = events.groupBy(*key).agg(F.min_by(F.struct(*[c for c in events.columns if c not in key]), F.struct("available_at", "created_at")).alias("x")).select(*key, "x.*").select(*events.columns)
    return one if log is None else one.join(log.select(*key), key, "left_anti")


def _first_of_key(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The first row of a key that the state doesn't know, by available_at and created_at."""
    first = None
    for frame in frames:
        rows = frame if first is None else pd.concat([first, frame])
        first = rows.sort_values(["available_at", "created_at"], kind="stable", na_position="last").head(1)
    if first is not None and not state.exists:
        state.update((True,))
        yield first


def first_seen_stream(events: DataFrame) -> DataFrame:
    """first_seen of a stream of parsed events, over all its batches. The state has a row for each key there ever was; dedup_stream bounds it by time."""
    keyed = events.groupBy("tenant_id", "subject", "payload_hash")
    return keyed.applyInPandasWithState(_first_of_key, events.schema, "seen boolean", "append", "NoTimeout")


def dedup_stream(events: DataFrame, within: str | None = None) -> DataFrame:
    """The stream without repeats, for ever, or, with bounded state, within a time."""
    key = ["tenant_id", "subject", "payload_hash"]
    return events.dropDuplicates(key) if within is None else events.withWatermark("created_at", within).dropDuplicatesWithinWatermark(key)


def apply_events(current: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """Current state after the events: of each document the last one counts; delete marks it, others take its canonical payload from documents. An event without an id is an error."""
    checked = events.withColumn("external_id", F.when(F.col("external_id").isNull(), F.raise_error(F.lit("an event has no id")).cast("string")).otherwise(F.col("external_id")))
    nth = F.row_number().over(Window.partitionBy("tenant_id", "entity_type", "external_id").orderBy(F.desc("available_at"), F.desc("created_at"), F.desc("action")))
    last = checked.withColumn("nth", nth).filter("nth = 1").select("tenant_id", F.col("entity_type").alias("resource"), "external_id", "action", F.col("created_at").alias("received_at"))
    saved = documents.join(last.filter("action <> 'delete'"), KEY).select(*KEY, "payload", "payload_hash", F.lit(0).alias("seq"), "received_at")
    return soft_delete(upsert_current(current, saved), last.filter("action = 'delete'"))


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on: on executors' disks in RocksDB, with its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def run_changes(events: DataFrame, apply, checkpoint: str) -> None:
    """Applies what a stream holds now, batch after batch, and stops. apply(batch, epoch) must give the same result when a batch comes again."""
    keep_state_in_rocksdb(events.sparkSession)
    query = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def logged(log: str):
    """What to apply to each batch: its rows written as the batch's own part of the log, over what an earlier try has left."""

    def apply(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    return apply


def run_dedup(events: DataFrame, log: str, checkpoint: str) -> None:
    """Logs the events of a stream that no earlier batch has, each once."""
    run_changes(first_seen_stream(parse_events(events)), logged(log), checkpoint)


def payload_of(entity: str):
    """JSON of an event's entity."""
    return json_at(F.col("message"), entity)
