"""Ordered, per-key operators: latest rows, supersession, chains, groups and budget packs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. One aggregate by max_by, which combines before the shuffle; order columns decide ties."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key. Spark's window group limit prunes before the shuffle."""
    return df.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("recency") <= n)


def shadowed(df: DataFrame, subject: list[str], sequence: str, current: Column) -> DataFrame:
    """status: current rows but the newest of a subject are shadowed-by-newer; the others keep current or other."""
    newest = F.max(F.when(current, F.col(sequence))).over(Window.partitionBy(*subject))
    return df.withColumn("temporal_status", F.when(~current, "not-current").when(F.col(sequence) < newest, "shadowed-by-newer").otherwise("current"))


def superseded(df: DataFrame, key: str, sequence: str, supersedes: Column) -> DataFrame:
    """superseded_by: the key of the last row that names this row's key among those it supersedes (not itself)."""
    links = df.select(F.explode(supersedes).alias("_old"), F.col(key).alias("_new"), F.col(sequence).alias("_seq")).where("_old <> _new")
    by = links.groupBy("_old").agg(F.max_by("_new", "_seq").alias("superseded_by"))
    return df.join(by, F.col(key) == F.col("_old"), "left").drop("_old")


def position_recency(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    return df.withColumn("position", F.col(sequence) / F.max(sequence).over(Window.partitionBy(*keys)))


def folded(df: DataFrame, keys: list[str], order: list[str], run: Callable, schema: str) -> DataFrame:
    """df in partitions by keys, sorted by keys and order, through run(frames): what depends on the rows before it in turn, with no key gathered."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def chained(df: DataFrame, keys: list[str], order: list[str], body: Column, hash_col: str = "event_hash") -> DataFrame:
    """Adds previous_hash and a SHA-256 over it and the body, for each key in order. A chain depends on every row before, so that rows stream past in order; the
    last hash is all that is kept."""
    rows = df.withColumn("_body", body)
    schema = T.StructType([*df.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField(hash_col, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, ""
        for f in frames:
            before, own = [], []
            for key, text in zip(zip(*(f[k] for k in keys), strict=True), f["_body"], strict=True):
                if key != at:
                    at, last = key, "0" * 64
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode("utf-8", "replace")).hexdigest()
                own.append(last)
            yield f.drop(columns="_body").assign(**{"previous_hash": before, hash_col: own})

    return folded(rows, keys, order, run, schema)


def verify_chain(df: DataFrame, keys: list[str], sequence: str, body: Column, hash_col: str = "event_hash") -> DataFrame:
    """One row a key: rows, whether the chain holds, and the first bad sequence. Each row is held against its predecessor alone, so that a
    window sorted by key and sequence serves and rows needn't be recomputed in order."""
    w = Window.partitionBy(*keys).orderBy(sequence)
    before = F.coalesce(F.lag(hash_col).over(w), F.lit("0" * 64))
    gap = F.coalesce(F.col(sequence) - F.lag(sequence).over(w), F.lit(1)) != 1
    bad = (F.col("previous_hash") != before) | (F.sha2(F.concat(F.col("previous_hash"), F.lit("|"), body), 256) != F.col(hash_col)) | gap
    checked = df.withColumn("_bad", bad)
    return checked.groupBy(*keys).agg(F.count("*").alias("n_rows"), (~F.bool_or("_bad")).alias("valid"), F.min(F.when(F.col("_bad"), F.col(sequence))).alias("first_bad"))


def contiguous(df: DataFrame, keys: list[str], order: str, start: str, end: str) -> DataFrame:
    """Per key: whether each segment starts where the one before it ends."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_ok", before.isNull() | (before == F.col(start))).groupBy(*keys).agg(F.count("*").alias("segments"), F.bool_and("_ok").alias("contiguous"))


def drop_consecutive(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Without rows whose value equals the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn("_keep", first | ~before.eqNullSafe(F.col(value))).where("_keep").drop("_keep")


def hierarchy(df: DataFrame, keys: list[str], order: list[str], leaf: int, fanout: int, levels: int) -> DataFrame:
    """Summary nodes over ordered rows: (keys, level, node, first, last, n). Leaves take `leaf` rows, nodes above `fanout` nodes.

    A node's number follows from its rows' positions, so that all levels come from one numbering; each level aggregates the one below.
    """
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    base = df.withColumn("_pos", pos).groupBy(*keys, F.floor(F.col("_pos") / leaf).alias("node")).agg(F.min("_pos").alias("first"), F.max("_pos").alias("last"), F.count("*").alias("n"))
    out, level = None, base
    for i in range(levels):
        rows = level.withColumn("level", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
        level = level.groupBy(*keys, F.floor(F.col("node") / fanout).alias("node")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return out


def pack_until(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order up to the first that does not fit: a running sum."""
    used = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    over = F.max(F.when(F.col("_used") > budget, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_used", used).withColumn("_over", over).where("_over = 0").drop("_used", "_over")


def pack_skipping(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int, item: str) -> DataFrame:
    """(keys, used, n_items, items) of rows in order, those that don't fit the budget skipped. Rows stream past; what is kept of a key is how much it has used."""
    kinds = dict(df.dtypes)
    rows = df.select(*keys, *order, F.col(cost).cast("bigint").alias("_c"), F.col(item).alias("_id"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, n = None, 0, 0
        for f in frames:
            out = []
            for key, size, one in zip(zip(*(f[k] for k in keys), strict=True), f["_c"], f["_id"], strict=True):
                if key != at:
                    at, used, n = key, 0, 0
                    out.append((*key, 0, 0, None))
                if used + size <= budget:
                    used, n = used + int(size), n + 1
                    out.append((*key, used, n, one))
            yield pd.DataFrame(out, columns=[*keys, "_used", "_n", "_item"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_used bigint, _n bigint", f"_item {kinds[item]}"])
    taken = folded(rows, keys, order, run, schema)
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct("_n", "_item"))))
    return taken.groupBy(*keys).agg(F.max("_used").alias("used"), F.max("_n").cast("int").alias("n_items"), F.transform(kept, lambda x: x["_item"]).alias("items"))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, weight: float = 0.2) -> DataFrame:
    """(keys, mean, n): the exponentially weighted mean of each key's values in order, the first as its start, written as a sum: the r-th value from the end weighs
    weight (1 - weight)^(r - 1), the first what is left. No key is gathered."""
    w = Window.partitionBy(*keys)
    back = F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))
    rows = df.withColumn("_r", back).withColumn("_n", F.count("*").over(w))
    share = F.when(F.col("_r") == F.col("_n"), F.pow(F.lit(1 - weight), F.col("_n") - 1)).otherwise(weight * F.pow(F.lit(1 - weight), F.col("_r") - 1))
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * share).alias("mean"), F.count("*").alias("n"))


def cache_hits(df: DataFrame, keys: list[str], time: str, ttl: float) -> DataFrame:
    """df with hit: whether a response that was stored when the key was last missed is no older than `ttl`, in the unit of the numeric column `time`. What is stored depends on the rows before, so
    that rows stream past in the order of their times; a key's last store is all that is kept."""
    schema = T.StructType([*df.schema.fields, T.StructField("hit", T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stored = None, None
        for f in frames:
            hits = []
            for key, now in zip(zip(*(f[k] for k in keys), strict=True), f[time], strict=True):
                if key != at:
                    at, stored = key, None
                hit = stored is not None and now - stored <= ttl
                stored = stored if hit else now
                hits.append(hit)
            yield f.assign(hit=hits)

    return folded(df, keys, [time], run, schema)


def snapshot_diff(before: DataFrame, now: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, change): rows that were added, deleted or modified between two snapshots with unique keys, by a hash of what counts; nulls equal each other. One
    equi join; what is shuffled of either side are its keys and hashes."""
    side = lambda df, name: df.select(*keys, F.xxhash64(value).alias(name))
    both = side(before, "_old").join(side(now, "_new"), keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select(*keys, change.alias("change")).where("change is not null")


def polled(snapshots: DataFrame, poll: str, keys: list[str], value: Column, polls: DataFrame | None = None) -> DataFrame:
    """(poll, keys, change) of a series of snapshots (poll, keys, ...): each held against the one before, by the rows of a key in the order of polls: a row without
    one in the poll before is added, without one in the poll after it is deleted in that. No pair of snapshots is joined. polls names them (column poll), those that found
    nothing too; by default they are those that rows have."""
    polls = (snapshots if polls is None else polls).select(poll).distinct()
    place = polls.withColumn("_i", F.row_number().over(Window.orderBy(poll)))
    rows = snapshots.select(poll, *keys, F.xxhash64(value).alias("_h")).join(place, poll)
    w = Window.partitionBy(*keys).orderBy("_i")
    near = rows.withColumn("_pi", F.lag("_i").over(w)).withColumn("_ph", F.lag("_h").over(w)).withColumn("_ni", F.lead("_i").over(w))
    there = F.when(F.col("_pi").isNull() | (F.col("_pi") != F.col("_i") - 1), F.when(F.col("_i") > 1, "added")).when(F.col("_ph") != F.col("_h"), "modified")
    came = near.select("_i", *keys, there.alias("change")).where("change is not null")
    went = near.where(F.col("_ni").isNull() | (F.col("_ni") != F.col("_i") + 1)).select((F.col("_i") + 1).alias("_i"), *keys, F.lit("deleted").alias("change"))
    return came.unionByName(went).join(place, "_i").select(poll, *keys, "change")
