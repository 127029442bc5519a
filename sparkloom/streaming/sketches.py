"""Column profiles of a stream as mergeable sketches: each micro-batch is summed up by partitions, and its small summary merged into the stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that a heavy-hitter sketch tracks, rows of a sample, letters of a value that are kept.
TRACKED, SAMPLE, LETTERS = 1024, 128, 128


class ColumnSketches:
    """Per column of a stream: rows, nulls, finite numbers with mean, deviation, minimum and maximum, about how many different values (HyperLogLog), the values that
    occur most (a frequent-items sketch of TRACKED counters; exact while no more different ones were seen), and a sample of rows: the `sample` of least hash.

    All of it merges: what a partition knows combines on the map side, then over partitions, then with what is stored, one row a column of bounded size. A batch writes the
    merged state under its number and reads the newest of earlier ones; run again after a failure, it replaces its own.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], sample: int = SAMPLE):
        self.spark, self.path, self.columns, self.sample = spark, path, columns, sample

    def _at(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _partial(self, rows: DataFrame) -> DataFrame:
        """(column, moments, sketches) of rows: one aggregate over (column, text, number)."""
        kinds = dict(rows.dtypes)
        number = lambda c: F.col(f"`{c}`").cast("double") if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal") else F.lit(None).cast("double")
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.left(F.col(f"`{c}`").cast("string"), F.lit(LETTERS)).alias("text"), number(c).alias("number"), F.xxhash64(F.col(f"`{c}`").cast("string")).alias("hash")) for c in self.columns])
        tall = rows.select(F.explode(cells).alias("x")).select("x.*")
        x = F.when(F.isnan("number") | (F.abs("number") == float("inf")), None).otherwise(F.col("number"))
        tall = tall.withColumn("number", x)
        seen = F.col("text").isNotNull()
        return tall.groupBy("column").agg(
            F.count("*").alias("n"), F.count_if(~seen).alias("nulls"), F.count("number").alias("numbers"), F.avg("number").alias("mean"), (F.var_pop("number") * F.count("number")).alias("m2"), F.min("number").alias("least"), F.max("number").alias("most"),
            F.hll_sketch_agg(F.when(seen, F.col("hash"))).alias("distinct"), F.expr(f"approx_top_k_accumulate(text, {TRACKED})").alias("top"),
        )

    def _merged(self, parts: DataFrame) -> DataFrame:
        """One row a column of several: moments by the rule for parts, sketches by their own."""
        mass = F.sum(F.col("numbers") * F.col("mean"))
        m2 = F.sum("m2") + F.sum(F.col("numbers") * F.col("mean") * F.col("mean")) - mass * mass / F.sum("numbers")
        return parts.groupBy("column").agg(
            F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("numbers").alias("numbers"), F.try_divide(mass, F.sum("numbers")).alias("mean"), F.when(F.sum("numbers") > 0, F.greatest(m2, F.lit(0.0))).alias("m2"), F.min("least").alias("least"), F.max("most").alias("most"),
            F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"),
        )

    def _kept(self, rows: DataFrame) -> DataFrame:
        """The sample of rows with their hashes; a limit on each task, then one of its size."""
        own = F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.columns]), {"ignoreNullFields": "false"})
        return rows.select(own.alias("row")).select(F.sha2("row", 256).alias("hash"), "row").orderBy("hash", "row").limit(self.sample)

    def _newest(self, before: int) -> int | None:
        rows = self.spark.read.parquet(f"{self.path}/done").where(F.col("batch") < before)
        return rows.agg(F.max("batch")).first()[0]

    def take(self, rows: DataFrame, batch: int) -> None:
        """Takes in one micro-batch; a function for foreachBatch()."""
        self.spark.range(0).write.mode("ignore").parquet(self._at("done", -1))
        last, parts, kept = self._newest(batch), self._partial(rows), self._kept(rows)
        if last is not None:
            parts = self._merged(self.spark.read.parquet(self._at("state", last)).unionByName(parts))
            kept = self.spark.read.parquet(self._at("sample", last)).unionByName(kept).orderBy("hash", "row").limit(self.sample)
        parts.write.mode("overwrite").parquet(self._at("state", batch))
        kept.write.mode("overwrite").parquet(self._at("sample", batch))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._at("done", batch))  # last: only now the batch counts for later ones

    def profile(self, top: int = 5) -> DataFrame:
        """(column, n, nulls, numbers, mean, deviation, least, most, about_distinct, top): top is an array of (item, count), most first, ties by item."""
        last = self._newest(2**62)
        if last is None:
            raise ValueError("no batch was taken in yet")
        state = self.spark.read.parquet(self._at("state", last))
        deviation = F.when(F.col("numbers") > 1, F.sqrt(F.col("m2") / (F.col("numbers") - 1))).when(F.col("numbers") == 1, 0.0)
        ranked = F.array_sort(F.filter(F.expr(f"approx_top_k_estimate(top, {TRACKED})"), lambda x: x["item"].isNotNull()), lambda a, b: F.when(a["count"] != b["count"], F.when(a["count"] > b["count"], -1).otherwise(1)).when(a["item"] < b["item"], -1).otherwise(F.when(a["item"] > b["item"], 1).otherwise(0)))
        return state.select("column", "n", "nulls", "numbers", "mean", deviation.alias("deviation"), "least", "most", F.hll_sketch_estimate("distinct").alias("about_distinct"), F.slice(ranked, 1, top).alias("top"))

    def rows(self) -> DataFrame:
        """(hash, row): the sample, rows as JSON."""
        return self.spark.read.parquet(self._at("sample", self._newest(2**62)))
