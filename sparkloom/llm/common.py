"""Shared helpers: table reading, the shared scratch folder, numpy connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; null ids sort before all others.
NULL_ID = -(2**63)
#: Bytes of a batch that goes to a Python worker.
ARROW_BYTES = 8 << 20
#: Most shuffle partitions that are taken unless the session sets more: each map task keeps a block for each of them.
PARTITIONS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset on a single machine (local mode, as in tests) a temporary folder is made and set as the checkpoint folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sparkloom/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes what the operators of this application wrote; call it when their results have been written elsewhere."""
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("sparkloom_")]:
        spark.sql(f"DROP TABLE `{name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], each: int = 128 << 20) -> DataFrame:
    """df written to the shared folder in buckets of its keys, and read back: a join on these keys shuffles the other side alone."""
    spark = df.sparkSession
    n, own_name = partitions_for(df, each), f"sparkloom_{name}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(own_name)
    return spark.table(own_name)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of ARROW_BYTES or one row: long texts don't add up to ten thousand of them in a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written with a row number _sl_row that tells its rows apart for good."""
    return materialize(df.withColumn("_sl_row", F.monotonically_increasing_id()), name)


def partitions_for(df: DataFrame, each: int) -> int:
    """Shuffle partitions for what df is made into: as many as the session sets, or as the files that df reads take at `each` bytes, up to PARTITIONS. The planner
    knows their sizes without a job; sources whose sizes it doesn't know count as none. Beyond PARTITIONS tasks grow, and sort with more spill."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(PARTITIONS, -(-_bytes_read(df) // each)))


def _bytes_read(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def few_tasks(df: DataFrame, each: int) -> int | None:
    """The session's cores where the files that df reads are so small, fewer than `each` bytes a core, that their row groups may be fewer than the cores; else None."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if 0 < _bytes_read(df) < each * cores else None


def own(df: DataFrame) -> list:
    """All columns of df by name, whatever signs are in it."""
    return [F.col(f"`{c}`") for c in df.columns]


def id_key(id_col: str):
    """A bigint key that is never null."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID))


def id_back(key: str):
    return F.when(F.col(key) != NULL_ID, F.col(key))


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of the edges u-v: the nodes, sorted, and the smallest node that each reaches."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
        if np.array_equal(before, label):
            return nodes, nodes[label]
