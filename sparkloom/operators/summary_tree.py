"""Trees of summaries over event logs that take appended events and rewrite only the paths to their roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut

#: Batches after which what batches wrote to the edge is folded into one table.
FOLD = 32
_CHILD = "struct<child: bigint, hash: string, first: bigint, last: bigint, n: bigint, sums: array<double>>"
_OPEN = f"session string, level int, node bigint, children array<{_CHILD}>, batch bigint"
_NODE = "session string, level int, node bigint, first bigint, last bigint, n bigint, children int, hash string, sums array<double>, batch bigint"


class SummaryTree:
    """Nodes over the events of each session, in a folder: leaves cover `leaf` events, nodes above `fanout` nodes each, up to one root.

    An event has its number in the session, from 0 without gaps. A node knows its first and last event, how many it covers, the sums of the given measures, and a
    hash of its children's. Beside the nodes the tree keeps its open edge: for each session and level the children of the last node. A batch of appended events
    needs that edge alone: it makes the leaves that are new or were open, then level by level the nodes above, all by equi joins and groups of at most `leaf` or
    `fanout` rows, so that a session of any share of the events is worked on by many tasks.

    Batches have numbers. What a batch writes has its number, and it reads what earlier ones wrote: a batch that is run again, after a failure at any place, replaces its
    own rows, so that foreachBatch() of a stream appends each event exactly once.
    """

    def __init__(self, spark: SparkSession, path: str, leaf: int = 32, fanout: int = 8, measures: int = 0):
        if leaf < 1 or fanout < 2:
            raise ValueError("a leaf takes an event at least, a node two nodes")
        self.spark, self.path, self.leaf, self.fanout, self.measures = spark, path, leaf, fanout, measures

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        self._write(self.spark.createDataFrame([], schema), name, -1)  # so that there is a folder to read
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _edge(self, batch: int) -> DataFrame:
        """The open edge before a batch: of each session and level the newest row, from the last fold and the batches since."""
        folds, edge = (self._read(x, _OPEN, batch) for x in ("folds", "edge"))
        at = folds.select(F.max("batch")).first()[0]
        rows = edge if at is None else folds.where(F.col("batch") == at).unionByName(edge.where(F.col("batch") > at))
        return rows.groupBy("session", "level").agg(F.max_by(F.struct("node", "children", "batch"), "batch").alias("x")).select("session", "level", "x.*")

    def append(self, events: DataFrame, batch: int, session: str = "session", number: str = "number", hashed: str = "hash", measures: list[Column] = ()) -> None:
        """Takes in new events: their session, number, hash and measures. No events: nothing changes but the batch is there."""
        if len(measures) != self.measures:
            raise ValueError(f"the tree sums {self.measures} measures")
        k = F.col(number).cast("bigint")
        sums = F.array(*[F.coalesce(m.cast("double"), F.lit(0.0)) for m in measures]).cast("array<double>")
        new = events.select(F.col(session).cast("string").alias("session"), F.struct(k.alias("child"), F.col(hashed).alias("hash"), k.alias("first"), k.alias("last"), F.lit(1).cast("bigint").alias("n"), sums.alias("sums")).alias("c"))
        edge = self._edge(batch)
        level, nodes, opened = 0, None, None
        while True:
            size = self.leaf if level == 0 else self.fanout
            own = new.groupBy("session", F.floor(F.col("c.child") / size).alias("node")).agg(F.collect_list("c").alias("new"))
            held = edge.where(F.col("level") == level).select("session", "node", F.col("children").alias("old"))
            met = own.join(held, ["session", "node"], "left")
            fresh = F.transform("new", lambda x: x["child"])
            kept = F.filter(F.coalesce("old", F.array().cast(f"array<{_CHILD}>")), lambda x: ~F.array_contains(fresh, x["child"]))
            made = met.select("session", F.lit(level).alias("level"), "node", F.array_sort(F.concat(kept, "new")).alias("children"))
            # Events are gone through once, for their leaves, and a level is written once, for all that is made of it. A full leaf takes no event any more and keeps none.
            of = F.col("of") if level else F.when(F.size("of") < size, F.col("of"))
            told = cut(self._summed(made).withColumns({"children": F.size("of"), "of": of}))
            if told.isEmpty():
                break
            # A node of one child above the leaves is no node yet: it only keeps that child until another comes.
            real = told.where((F.col("level") == 0) | (F.col("children") > 1) | (F.col("node") > 0))
            some = real.select("session", "level", "node", "first", "last", "n", "children", "hash", "sums")
            if level == 0:
                ends = told.where(F.col("of").isNotNull())  # only a session's last leaf is not full
                edge = cut(edge.where(F.col("level") > 0).join(told.select("session").distinct(), "session", "left_semi"))
            else:
                ends = told.join(told.groupBy("session").agg(F.max("node").alias("node")), ["session", "node"], "left_semi")
            ends = ends.select("session", "level", "node", F.col("of").alias("children"))
            nodes, opened = (some, ends) if nodes is None else (nodes.unionByName(some), opened.unionByName(ends))
            new = real.select("session", F.struct(F.col("node").alias("child"), "hash", "first", "last", "n", "sums").alias("c"))
            level += 1
        empty = self.spark.createDataFrame([], _NODE), self.spark.createDataFrame([], _OPEN)
        self._write(empty[0] if nodes is None else nodes, "nodes", batch)
        self._write(empty[1] if opened is None else opened, "edge", batch)
        if batch % FOLD == FOLD - 1:
            self._write(self._edge(batch + 1), "folds", batch)

    def _summed(self, made: DataFrame) -> DataFrame:
        low = F.array_min(F.transform("children", lambda x: x["first"]))
        high = F.array_max(F.transform("children", lambda x: x["last"]))
        n = F.aggregate("children", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        zero = F.array(*[F.lit(0.0)] * self.measures).cast("array<double>")
        sums = F.aggregate("children", zero, lambda a, x: F.zip_with(a, x["sums"], lambda p, q: p + q))
        hashed = F.sha2(F.array_join(F.transform("children", lambda x: x["hash"]), ""), 256)
        return made.select("session", "level", "node", low.alias("first"), high.alias("last"), n.alias("n"), sums.alias("sums"), hashed.alias("hash"), F.col("children").alias("of"))

    def nodes(self) -> DataFrame:
        """The tree as it stands: session, level, node, first, last, n, children (how many), hash, sums and the batch that wrote it."""
        rows = self._read("nodes", _NODE, None)
        own = [c for c in rows.columns if c not in ("session", "level", "node")]
        return rows.groupBy("session", "level", "node").agg(F.max_by(F.struct(*own), "batch").alias("x")).select("session", "level", "node", "x.*")

    def sink(self, **columns):
        """A function for foreachBatch(): appends each micro-batch under its number."""
        return lambda events, batch: self.append(events, batch, **columns)
