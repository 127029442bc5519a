"""Routes of tasks to providers: how complex a task is, the cheapest candidate that can do it, the best one by score with fallbacks.

Tasks may be any number of rows; candidates are a configuration of at most MOST rows, which is checked, and go into the plan as literals: a route is an expression of
its row, without a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most candidates; levels; terms with their points, sizes from which on a task counts a point more, and the points that each level takes.
MOST = 128
LEVELS = ["simple", "medium", "complex", "reasoning"]
HARD = ["architecture", "security", "migration", "race condition", "formal", "proof", "root cause"]
SOME = ["refactor", "debug", "benchmark", "cross-repo", "dependency"]
FILES, TOKENS = 8, 16_000
POINTS = {"reasoning": 4, "complex": 2, "medium": 1}


def complexity(task: Column, changed_files: Column | None = None, tokens: Column | None = None) -> Column:
    """A task's level by its words and its size; a null text has no words, a null size is none."""
    text = F.lower(task)
    said = lambda terms: F.coalesce(F.greatest(*[F.contains(text, F.lit(t)) for t in terms]), F.lit(False)).cast("int")
    large = lambda n, least: F.coalesce(n >= least, F.lit(False)).cast("int") if n is not None else F.lit(0)
    points = 2 * said(HARD) + said(SOME) + large(changed_files, FILES) + large(tokens, TOKENS)
    out = F
    for level, least in POINTS.items():
        out = out.when(points >= least, level)
    return out.otherwise(LEVELS[0])


def _held(candidates: DataFrame, fields: list[str]) -> Column:
    """The candidates as one literal array of structs."""
    rows = candidates.select(*fields).take(MOST + 1)
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} candidates")
    schema = candidates.select(*fields).schema
    kind = f"array<{schema.simpleString()}>"
    made = [F.struct(*[F.lit(r[c]).cast(schema[c].dataType).alias(c) for c in fields]) for r in rows]
    return F.array(*made).cast(kind)


def cheapest(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tasks with eligible_count and route: of the candidates whose context and price fit, and that have tools where they are needed, the one of the least price, then
    latency, then by names; null where none fits.

    Tasks: required_context, max_cost_micros, require_tools (null: no) and others; candidates: cost_micros, latency_ms, provider, model, max_context, supports_tools (null: no). A null price or context
    fits nothing; of a task it is met by nothing.
    """
    fields = ["cost_micros", "latency_ms", "provider", "model", "max_context", "supports_tools"]
    false = F.lit(False)

    def fits(x: Column) -> Column:
        tools = ~F.coalesce(F.col("require_tools"), false) | F.coalesce(x["supports_tools"], false)
        return F.coalesce((x["max_context"] >= F.col("required_context")) & (x["cost_micros"] <= F.col("max_cost_micros")) & tools, false)

    able = F.filter(_held(candidates, fields), fits)
    return tasks.withColumn("_able", able).select(*tasks.columns, F.size("_able").alias("eligible_count"), F.array_min("_able").alias("route"))


def ranked(candidates: DataFrame, now: float, prefer_subscription: bool = True) -> DataFrame:
    """Candidates that are available, with their score: quality, price, latency, quota, priority and subscription."""
    blended = F.col("input_cost_per_million") + F.col("output_cost_per_million") * 2
    score = F.col("quality") * 60 - blended * 2 - F.col("latency_ms") / 1000 + F.least(F.lit(20.0), F.col("quota_remaining") * 20)
    score = score + F.greatest(F.lit(-20), F.least(F.lit(20), F.col("priority"))) * 0.5
    if prefer_subscription:
        score = score + F.when(F.col("subscription"), 15.0).otherwise(0.0)
    return candidates.where(F.col("available") & (F.col("rate_limited_until") <= now) & (F.col("quota_remaining") > 0)).withColumn("score", score)


def best(tasks: DataFrame, candidates: DataFrame, now: float, prefer_subscription: bool = True, fallbacks: int = 5) -> DataFrame:
    """Tasks (task, changed_files, token_estimate and others) with complexity, route and fallbacks: of the available candidates that take tasks of the level and size, the best score,
    then by names; the next ones are the fallbacks. Null and empty where there is none. A context window of zero or null has no limit."""
    level = lambda name: F.array_position(F.array(*map(F.lit, LEVELS)), name)
    rows = ranked(candidates, now, prefer_subscription).select((-F.col("score")).alias("order"), "provider", "model", "account", F.greatest(level(F.col("max_complexity")), F.lit(1)).alias("most"), "context_window")
    held = F.array_sort(_held(rows, ["order", "provider", "model", "account", "most", "context_window"]))
    size = F.coalesce(F.col("token_estimate"), F.lit(0))
    open_ = lambda x: (x["most"] >= level(F.col("complexity"))) & ((F.coalesce(x["context_window"], F.lit(0)) == 0) | (size <= x["context_window"]))
    out = tasks.withColumn("complexity", complexity(F.col("task"), F.col("changed_files"), F.col("token_estimate"))).withColumn("_able", F.filter(held, open_))
    first = F.get("_able", F.lit(0))
    route = F.when(first.isNotNull(), F.struct(first["provider"].alias("provider"), first["model"].alias("model"), first["account"].alias("account"), (-first["order"]).alias("score")))
    return out.select(*tasks.columns, "complexity", route.alias("route"), F.transform(F.slice("_able", 2, fallbacks), lambda x: F.struct(x["provider"], x["model"], x["account"])).alias("fallbacks"))
