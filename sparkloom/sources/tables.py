"""Driver tables as DataFrames and views."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL over the tables that it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which the driver and all executors share. Where it names none a single machine takes a temporary
    one, and a cluster is an error, as each machine would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or tempfile.mkdtemp(prefix="sparkloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{shared_folder(spark).rstrip('/')}/sparkloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def parts_for(df: DataFrame, each: int) -> int:
    """Shuffle partitions for what df is made into: those that the session sets, or one for each `each` bytes of the files that df reads, 10,000 at most. The planner
    knows their sizes without a job; sources whose sizes it doesn't know count as none."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(10_000, -(-bytes_read(df) // each)))


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the planner knows them without a job; none where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)
