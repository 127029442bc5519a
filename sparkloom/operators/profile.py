"""Bounded views of tables: column profiles, samples, relevant rows, deduplicated retrieval hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Columns that a bounded view shows first.
PRIORITY = ["error", "errors", "status", "message", "path", "source", "url", "id", "name", "score", "distance", "rank", "count", "total", "next", "page"]


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def column_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row a column: rows, nulls, null ratio, distinct values, and of finite numbers count, min, max, mean, sample deviation (0 for one).

    One pass for all but the distinct counts. Those are exact by default: each column is read on its own, its values combined on the map side, and what is
    shuffled are a column's different values, without the copies of rows that several distinct counts in one aggregate make. Where approximate they are
    sketches of fixed size in the same pass. The result has one row a column.
    """
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggs: list[Column] = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        aggs += [F.count_if(v.isNull()).alias(f"nulls{i}"), *([F.approx_count_distinct(v).alias(f"distinct{i}")] if approximate else [])]
        if _numeric(kinds[c]):
            x = v.cast("double")
            x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
            aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"), F.coalesce(F.stddev_samp(x), F.when(F.count(x) > 0, 0.0)).alias(f"dev{i}")]
    one = df.agg(*aggs)
    if not approximate:
        each = [df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().agg(F.count("*").alias("d")).withColumn("i", F.lit(i)) for i, c in enumerate(columns)]
        counts = reduce(DataFrame.unionByName, each)
        one = one.crossJoin(F.broadcast(counts.agg(*[F.max(F.when(F.col("i") == i, F.col("d"))).alias(f"distinct{i}") for i in range(len(columns))])))
    rows = []
    for i, c in enumerate(columns):
        num = _numeric(kinds[c])
        pick = lambda p, i=i, num=num: F.col(f"{p}{i}") if num else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"nulls{i}").alias("nulls"), (F.col(f"nulls{i}") / F.greatest(F.col("rows"), F.lit(1))).alias("null_ratio"), F.col(f"distinct{i}").alias("distinct_values"), (F.col(f"n{i}") if num else F.lit(0).cast("bigint")).alias("numbers"), pick("min").alias("minimum"), pick("max").alias("maximum"), pick("mean").alias("mean"), pick("dev").alias("deviation")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_values(df: DataFrame, columns: list[str], k: int = 5, longest: int = 128) -> DataFrame:
    """The k most frequent values of each column, values of up to `longest` characters, by count and then value: exact counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull() & (F.length("value") <= longest)).groupBy("column", "value").count()
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value")).cast("bigint")
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def bottom_k(df: DataFrame, key: Column, k: int) -> DataFrame:
    """A deterministic sample: the k rows with the least SHA-256 of the key. A top-k, not a sort of everything."""
    return df.withColumn("sample_key", F.sha2(key.cast("string"), 256)).orderBy("sample_key").limit(k)


def priority_columns(columns: list[str], query: list[str], most: int, by_name: bool = False) -> list[str]:
    """Columns that a view shows: priority names first, then those that share a token with the query, then as they come, or by name as for streams, whose columns
    have no order."""
    words = {w.lower() for w in query}
    rank = lambda c: (c.lower() not in PRIORITY, not words & set(c.lower().replace("_", " ").split()), c if by_name else columns.index(c))
    return sorted(columns, key=rank)[:most]


def relevant_rows(df: DataFrame, text: Column, query: list[str], k: int, bad: Column | None = None, extra: Column | None = None, order: str = "row_id") -> DataFrame:
    """The k rows that matter most for the query, back in input order: 20 a shared token, 50 for a bad status, and an own score."""
    score = tx.overlap(F.array_distinct(tx.tokens(text)), query) * 20.0
    if bad is not None:
        score = score + F.when(bad, 50.0).otherwise(0.0)
    if extra is not None:
        score = score + F.coalesce(extra, F.lit(0.0))
    top = df.withColumn("relevance", score).orderBy(F.desc("relevance"), F.asc(order)).limit(k)
    return top.orderBy(order)


def best_hits(df: DataFrame, identity: Column, score: Column, text: Column, tie: str) -> DataFrame:
    """One row an identity: the best by score, then by length of text, then the least tie. One shuffle of partial maxima by key."""
    rank = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("score"), F.desc(F.length(text)), F.asc(tie)))
    return df.withColumn("identity", identity).withColumn("score", score).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
