"""Named functions over rows: what users plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Functions:
    """Functions by name with their return types. Pure ones may run anywhere and again; others only in a call on the driver."""

    def __init__(self):
        self._known: dict[str, tuple[Callable, str, bool, str]] = {}

    def register(self, name: str, function: Callable, returns: str, pure: bool = True, description: str = "") -> None:
        if name in self._known:
            raise ValueError(f"two functions are named {name}")
        self._known[name] = (function, returns, pure, description)

    def names(self) -> list[str]:
        return sorted(self._known)

    def call(self, name: str, *values):
        return self._known[name][0](*values)

    def _pure(self, name: str) -> tuple[Callable, str]:
        function, returns, pure, _ = self._known[name]
        if not pure:
            raise ValueError(f"{name} isn't pure: executors may run a task again")
        return function, returns

    def expose(self, spark: SparkSession) -> None:
        """Makes the pure ones SQL functions, in Arrow batches."""
        for name, (function, returns, pure, _) in self._known.items():
            if pure:
                spark.udf.register(name, F.udf(function, returns, useArrow=True))

    def map(self, df: DataFrame, name: str, column: str, out: str) -> DataFrame:
        function, returns = self._pure(name)
        return df.withColumn(out, F.udf(function, returns, useArrow=True)(column))

    def filter(self, df: DataFrame, name: str, column: str) -> DataFrame:
        function, _ = self._pure(name)
        return df.where(F.udf(function, "boolean", useArrow=True)(column))

    def reduce(self, df: DataFrame, name: str, keys: list[str], column: str, out: str) -> DataFrame:
        """Folds an associative and commutative function of two values over each key: first within each batch of a task, then over the batches' results."""
        function, returns = self._pure(name)
        kinds = dict(df.dtypes)
        schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{out} {returns}"])

        def fold(values: pd.Series):
            result = None
            for v in values.dropna():
                result = v if result is None else function(result, v)
            return result

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield f.groupby(keys, dropna=False)[column].agg(fold).reset_index().rename(columns={column: out})

        def final(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{k: [f[k].iloc[0]] for k in keys}, out: [fold(f[out])]})

        return df.select(*keys, column).mapInPandas(partial, schema).groupBy(*keys).applyInPandas(final, schema)


def map_reduce(tasks: DataFrame, key: str, mapper: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tries: int = 2) -> DataFrame:
    """Idempotent tasks, once each by key, through a mapper that may fail some times before a task counts as failed (its row is left to Spark's own retries)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for left in range(tries, -1, -1):
                try:
                    yield mapper(f)
                    break
                except Exception:
                    if not left:
                        raise

    return tasks.dropDuplicates([key]).mapInPandas(run, schema)
