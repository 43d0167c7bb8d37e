"""Tables kept in buckets of a key: a batch reads and rewrites the buckets that it touches, and no others.

A bucket is a folder and the rows of some hashes of the key. Choose as many as keep each at
some hundred MB; a table keeps the number that it was written with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.sources.sinks import stored

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Writes a whole table in buckets, in place of what was there."""
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def merge_buckets(spark: SparkSession, path: str, keys: list[str], buckets: int, touched: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replaces the buckets that touched has keys of by merge(their rows), and gives their numbers.

    merge must keep each row's key in the buckets that it is given, and give the same when it
    comes again: new rows are written apart first, but buckets are replaced one by one, so
    a batch that failed half-way is mended by running it again. A bucket left without rows
    goes. The driver gets the numbers of buckets only.
    """
    which = bucket_of(keys, buckets)
    ids = sorted(r[0] for r in touched.select(which.alias(BUCKET)).distinct().collect())
    if not ids:
        return []
    old = spark.read.parquet(path).filter(F.col(BUCKET).isin(ids)).drop(BUCKET)
    new = stored(merge(old).withColumn(BUCKET, which).repartition(BUCKET))
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    full = {r[0] for r in new.select(BUCKET).distinct().collect()}
    for i in set(ids) - full:
        _remove(spark, f"{path}/{BUCKET}={i}")
    return ids
