"""Written tables that pin what later steps must see unchanged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def pinned_path(spark: SparkSession, what: str = "pinned") -> str:
    """A new path in the folder that all machines share (spark.checkpoint.dir). Where that is unset, a temporary one in local mode; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        folder = tempfile.mkdtemp(prefix="countloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = pinned_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input for each task of a range exchange, and its tasks at most.
TASK_BYTES, MOST_TASKS = 32 << 20, 50_000


def tasks_for(df: DataFrame) -> int:
    """Tasks for an exchange of df: the session's number of shuffle partitions, or one for each TASK_BYTES of the tables that its plan reads where that is more. No job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    total = sum(n for n in sizes if n < 1 << 62)  # rows of the driver have no known size
    return min(MOST_TASKS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)))
