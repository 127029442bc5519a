"""Polls of a changing listing as a stream, each held against the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import polled


class PollWatch:
    """Differences from poll to poll, in a folder, over the micro-batches of a stream.

    Rows are what a poll lists; `poll` numbers them in ascending order. A row whose keys are all null lists nothing and only says that its poll took place, so that a
    poll that finds nothing is known and deletes what was there. The rows of a poll come in one batch (one file, for a stream of files), any number of polls in
    each; polls that aren't after the last one are left out. The first poll of all adds everything.

    Each batch writes its changes and its last poll's listing (keys and hashes) under its number, and reads those of earlier batches: run again after
    a failure, it replaces its own rows. What is kept is one listing a batch, until clear() drops those that no batch reads any more.
    """

    def __init__(self, spark: SparkSession, path: str, poll: str, keys: list[str], value: Column):
        self.spark, self.path, self.poll, self.keys, self.value = spark, path, poll, keys, value

    def _at(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _read(self, name: str, schema: str) -> DataFrame:
        self.spark.createDataFrame([], schema).drop("batch").write.mode("ignore").parquet(self._at(name, -1))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def take(self, rows: DataFrame, batch: int) -> None:
        """Takes in one micro-batch; a function for foreachBatch()."""
        kinds = dict(rows.dtypes)
        own = ", ".join(f"`{c}` {kinds[c]}" for c in (self.poll, *self.keys))
        done = self._read("polls", f"`{self.poll}` {kinds[self.poll]}, batch bigint").where(F.col("batch") < batch)
        last = done.agg(F.max(F.struct("batch", self.poll)).alias("x")).select("x.*").first()
        there = F.lit(False)
        for k in self.keys:
            there = there | F.col(k).isNotNull()
        new = rows if last[0] is None else rows.where(F.col(self.poll) > F.lit(last[1]))
        polls = new.select(self.poll).distinct()
        listed = new.where(there).select(self.poll, *self.keys, F.xxhash64(self.value).alias("_hash"))
        # A poll before all others, of which nothing is listed, makes the first one add its rows.
        before = polls.select(F.min(self.poll).alias("p")).select((F.col("p") - 1).alias(self.poll)) if last[0] is None else self.spark.createDataFrame([(last[1],)], f"`{self.poll}` {kinds[self.poll]}")
        held = self._read("listing", f"{own}, _hash bigint, batch bigint").where(F.col("batch") == F.lit(-2 if last[0] is None else last[0])).drop("batch")
        changes = polled(held.unionByName(listed), self.poll, self.keys, F.col("_hash"), before.unionByName(polls))
        changes.write.mode("overwrite").parquet(self._at("changes", batch))
        newest = polls.agg(F.max(self.poll).alias(self.poll)).where(F.col(self.poll).isNotNull())
        listed.join(F.broadcast(newest), self.poll, "left_semi").write.mode("overwrite").parquet(self._at("listing", batch))
        newest.write.mode("overwrite").parquet(self._at("polls", batch))  # last: only now the batch counts for later ones

    def changes(self) -> DataFrame:
        """(poll, keys, change, batch) of all polls so far: added, modified or deleted."""
        return self.spark.read.option("mergeSchema", "false").parquet(f"{self.path}/changes")

    def clear(self) -> None:
        """Removes the listings of all batches but the last two that had polls, which a batch that is run again may still read."""
        batches = sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/polls").select("batch").distinct().collect())
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for batch in batches[:-2]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._at("listing", batch)), True)
