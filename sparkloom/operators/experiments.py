"""Paired experiments, policies and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def paired(df: DataFrame, arm: str, baseline: str, candidate: str, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of two arms with equal keys side by side: b_<value> and c_<value>. An equi join on the whole key."""
    side = lambda name, p: df.where(F.col(arm) == name).select(*keys, *[F.col(v).alias(f"{p}_{v}") for v in values])
    return side(baseline, "b").join(side(candidate, "c"), keys)


def mismatches(fields: list[str], left: str = "b_", right: str = "c_") -> Column:
    """Names of the identity fields that differ or are null on either side."""
    bad = [F.when(F.col(left + f).isNull() | F.col(right + f).isNull() | (F.col(left + f) != F.col(right + f)), F.lit(f)) for f in fields]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def compare(pairs: DataFrame, value: str, success: str | None = None) -> DataFrame:
    """One row: pairs, means, aggregate ratio, median and geometric mean of the pairs' ratios, pass rates."""
    ratio = F.col(f"c_{value}") / F.col(f"b_{value}")
    p = pairs.where(F.col(f"b_{value}") > 0).withColumn("_r", ratio)
    out = [F.count("*").alias("n_pairs"), F.avg(f"b_{value}").alias("baseline_mean"), F.avg(f"c_{value}").alias("candidate_mean"), (F.sum(f"c_{value}") / F.sum(f"b_{value}")).alias("aggregate_ratio"), F.median("_r").alias("median_ratio"), stats.geometric_mean("_r").alias("geometric_ratio")]
    if success:
        out += [F.avg(F.col(f"{s}_{success}").cast("double")).alias(f"{s}_rate") for s in ("b", "c")]
    return p.agg(*out)


def drift(df: DataFrame, keys: list[str], order: list[str], value: str, least: int = 10) -> DataFrame:
    """Per key: |mean of the later half - mean of the earlier half|; 0 below `least` rows."""
    w = Window.partitionBy(*keys)
    halves = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    gap = F.abs(F.avg(F.when(~early, F.col(value))) - F.avg(F.when(early, F.col(value))))
    return halves.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, gap).otherwise(0.0).alias("drift"))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that fail."""
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for ok, name in checks]), lambda x: x.isNotNull())


def median_ranks(n: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (from 0) among n sorted values of the two middle values of `rounds` resamples of n: the order statistics of n uniform numbers
    are beta distributed, so that no resample is drawn value by value. Equal in distribution to sorting each resample."""
    rng = np.random.default_rng(seed)
    low = rng.beta(k := (n + 1) // 2, n + 1 - k, rounds)
    high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k, rounds)
    return tuple(np.minimum((x * n).astype(np.int64), n - 1) for x in (low, high))


def bootstrap_median(df: DataFrame, keys: list[str], value: str, rounds: int = 1000, seed: int = 1337) -> DataFrame:
    """Per key: median and the 2.5 and 97.5 percentiles of resampled medians. Seeded, so that runs agree.

    All values count: they are counted by value, combined on the map side, and a pandas function a group draws the ranks of the resampled
    medians. It holds a key's different values.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_v")
        v, ends = pdf["_v"].to_numpy(), np.cumsum(pdf["_n"].to_numpy())
        n = int(ends[-1])
        at = lambda ranks: v[np.searchsorted(ends, ranks, "right")]
        low, high = median_ranks(n, rounds, seed)
        found = np.sort((at(low) + at(high)) / 2)
        median = float((at((n - 1) // 2) + at(n // 2)) / 2)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [n], "median": [median], "low": [found[int(0.025 * (rounds - 1))]], "high": [found[int(0.975 * (rounds - 1))]]})

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n bigint, median double, low double, high double"])
    return rows.groupBy(*keys).applyInPandas(run, schema)
