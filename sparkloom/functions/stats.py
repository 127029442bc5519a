"""Statistics as Column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(value: Column, q: float) -> Column:
    """Percentile by nearest rank: the value at ceil(n q) of the sorted ones."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {_name(value)})")


def _name(value: Column | str) -> str:
    return value if isinstance(value, str) else value._jc.toString()


def rounded_rank(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """(keys, out): the percentile at the index (n - 1) q, rounded half to even. Values are counted, combined on the map side, and a running sum over a key's
    different values finds the one at the index."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    rows = counts.withColumn("_end", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = F.bround((F.col("_n") - 1) * F.lit(q)).cast("bigint")
    return rows.where((F.col("_end") > at) & (F.col("_end") - F.col("_c") <= at)).select(*keys, F.col(value).alias(out))


def upper_median(value: str) -> Column:
    """The middle value, the upper one of two: exact by rank, without gathering (percentile_disc from the top)."""
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{value})")


def geometric_mean(value: str) -> Column:
    return F.exp(F.avg(F.log(F.col(value))))


def wilson_lower(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a rate; 0 without trials."""
    p = successes / n
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(F.lit(0.0))


def half_life(age_seconds: Column, half_life_seconds: float = 30 * 24 * 60 * 60.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_seconds, F.lit(0.0)) / half_life_seconds)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_unit(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 in 0..1; 0 where sizes differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    unit = F.least(F.greatest((dot(a, b) / norms + 1) / 2, F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), unit).otherwise(F.lit(0.0))


def roi(importance: Column, confidence: Column, validity: Column, successes: Column, failures: Column, reuse: Column) -> Column:
    """What a stored observation has been worth."""
    return importance * confidence * validity * (successes + 1) / (failures + 1) * F.log2(reuse + 2)


def unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
