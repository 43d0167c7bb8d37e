"""Writing marts, exports and run records."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a Spark of one process may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="martloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once and read back, for frames that several others use: each would plan the whole chain again."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, write) -> int:
    """Writes df and gives the number of rows that were written, observed on the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return int(seen.get["rows"])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


RUN = "run_id string, tenant_id string, kind string, status string, started_at timestamp, finished_at timestamp, counts map<string,long>, error string"


def record_run(
    spark: SparkSession, path: str, run_id: str, tenant_id: str, kind: str, status: str, started: datetime, finished: datetime,
    counts: dict[str, int], error: str | None = None,
) -> DataFrame:
    """Appends one run to the run table and gives it back. Errors are cut at 4000 characters."""
    row = spark.createDataFrame([(run_id, tenant_id, kind, status, started, finished, counts, error and error[:4000])], RUN)
    row.coalesce(1).write.mode("append").parquet(path)
    return row


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run table, empty before the first run."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(RUN).parquet(path) if there else spark.createDataFrame([], RUN)
