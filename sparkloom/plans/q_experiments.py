"""Paired experiments, policies and gates over orders and line items as arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import experiments as ex, windows
from ..sources.tables import table
from .registry import query


def _arms(spark, sf_dir):
    """Line items as runs: the ship status is the arm, the order's line the task."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey", "l_linenumber", "l_linestatus").agg(F.avg("l_extendedprice").alias("cost"), F.avg((F.col("l_returnflag") != "R").cast("double")).alias("passed"), F.max("l_discount").alias("hardware"))


_ARMS = "WITH a AS (SELECT l_suppkey, l_linenumber, l_linestatus, avg(l_extendedprice) AS cost, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0 END) AS passed, max(l_discount) AS hardware FROM lineitem GROUP BY ALL), p AS (SELECT l_suppkey, l_linenumber, b.cost AS b_cost, c.cost AS c_cost, b.passed AS b_passed, c.passed AS c_passed, b.hardware AS b_hardware, c.hardware AS c_hardware FROM (SELECT * FROM a WHERE l_linestatus = 'F') b JOIN (SELECT * FROM a WHERE l_linestatus = 'O') c USING (l_suppkey, l_linenumber)) "


def _pairs(spark, sf_dir):
    return ex.paired(_arms(spark, sf_dir), "l_linestatus", "F", "O", ["l_suppkey", "l_linenumber"], ["cost", "passed", "hardware"])


def _round(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(_ARMS + "SELECT l_suppkey, l_linenumber, round(b_cost, 1) AS b_cost, round(c_cost, 1) AS c_cost FROM p")
def paired_join(spark, sf_dir):
    return _round(_pairs(spark, sf_dir).select("l_suppkey", "l_linenumber", "b_cost", "c_cost"), 1)


@query(_ARMS + "SELECT count(*) AS n_pairs, round(avg(b_cost), 2) AS baseline_mean, round(avg(c_cost), 2) AS candidate_mean, round(sum(c_cost) / sum(b_cost), 4) AS aggregate_ratio, round(median(c_cost / b_cost), 4) AS median_ratio, round(exp(avg(ln(c_cost / b_cost))), 4) AS geometric_ratio, round(avg(b_passed), 4) AS b_rate, round(avg(c_passed), 4) AS c_rate FROM p")
def paired_comparison(spark, sf_dir):
    out = _round(ex.compare(_pairs(spark, sf_dir), "cost", "passed"), 4)
    return out.withColumn("baseline_mean", F.round("baseline_mean", 2)).withColumn("candidate_mean", F.round("candidate_mean", 2))


@query(_ARMS + "SELECT l_suppkey, l_linenumber, CASE WHEN b_hardware <> c_hardware THEN 'hardware' ELSE '' END AS bad FROM p")
def identity_parity(spark, sf_dir):
    bad = F.array_join(ex.mismatches(["hardware"]), ",").alias("bad")
    return _pairs(spark, sf_dir).select("l_suppkey", "l_linenumber", bad)


@query("SELECT l_linestatus AS arm, round(sum(l_quantity) / sum(l_extendedprice), 8) AS work_per_quota, round(avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM lineitem GROUP BY l_linestatus")
def failure_inclusive(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linestatus").alias("arm")).agg(F.round(F.sum("l_quantity") / F.sum("l_extendedprice"), 8).alias("work_per_quota"), F.round(F.avg((F.col("l_returnflag") != "R").cast("double")), 6).alias("pass_rate"))


_WILSON = "SELECT o_orderpriority, n, s, round((s / n + 3.8416 / (2 * n) - 1.96 * sqrt((s / n * (1 - s / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS low FROM (SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority)"


@query(_WILSON)
def wilson_bound(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("s"))
    return g.withColumn("low", F.round(stats.wilson_lower(F.col("s"), F.col("n")), 6))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN abs(avg(CASE WHEN i > n // 2 THEN value END) - avg(CASE WHEN i <= n // 2 THEN value END)) ELSE 0 END, 6) AS drift FROM r GROUP BY event_type""")
def drift(spark, sf_dir):
    return _round(ex.drift(table(spark, sf_dir, "events"), ["event_type"], ["event_id"], "value"))


@query("""WITH g AS (SELECT l_linestatus, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0 END) AS rate, avg(l_discount) AS discount, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_linestatus)
SELECT l_linestatus, rate >= 0.5 AND discount <= 0.06 AND p95 <= 50000 AS passed, concat_ws(',', CASE WHEN rate < 0.5 THEN 'success' END, CASE WHEN discount > 0.06 THEN 'ratio' END, CASE WHEN p95 > 50000 THEN 'latency' END) AS reasons FROM g""")
def gate_means(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.avg((F.col("l_returnflag") != "R").cast("double")).alias("rate"), F.avg("l_discount").alias("discount"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice)").alias("p95"))
    why = ex.reasons((F.col("rate") >= 0.5, "success"), (F.col("discount") <= 0.06, "ratio"), (F.col("p95") <= 50000, "latency"))
    return g.select("l_linestatus", (F.size(why) == 0).alias("passed"), F.array_join(why, ",").alias("reasons"))


@query(_ARMS + "SELECT round(avg(c_passed - b_passed), 6) AS delta, avg(c_passed - b_passed) >= -0.05 AS non_inferior FROM p")
def non_inferiority(spark, sf_dir):
    d = F.avg(F.col("c_passed") - F.col("b_passed"))
    return _pairs(spark, sf_dir).agg(F.round(d, 6).alias("delta"), (d >= -0.05).alias("non_inferior"))


@query("SELECT l_suppkey, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) * 1000000 // sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS ppm FROM lineitem GROUP BY l_suppkey")
def integer_ratio_ppm(spark, sf_dir):
    """Exact integers: whole sums and an integral division."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.floor("l_quantity")).alias("q"), F.sum(F.floor("l_extendedprice")).alias("p"))
    return li.select("l_suppkey", F.expr("(q * 1000000) div p").alias("ppm"))


@query("SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) >= 0.4 AS task_ok, count(DISTINCT o_orderpriority) >= 5 AS coverage_ok, count(*) AS n FROM orders")
def slo_gate(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg((F.avg((F.col("o_orderstatus") == "F").cast("double")) >= 0.4).alias("task_ok"), (F.count_distinct("o_orderpriority") >= 5).alias("coverage_ok"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6) AS success FROM events")
def maturity_gate(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"), F.round(F.avg((F.col("event_type") != "error").cast("double")), 6).alias("success"))


_LAST = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS i FROM events), g AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_disc(value, 0.95) AS p95 FROM r WHERE i <= 100 GROUP BY event_type)
SELECT event_type, n, round(mean, 6) AS mean, p95, CASE WHEN n < 20 THEN 'hold' WHEN p95 > 98 THEN 'tighten' WHEN mean > 50 THEN 'keep' ELSE 'relax' END AS decision FROM g"""


@query(_LAST)
def policy_recommendation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    g = windows.last_n(e, ["event_type"], [F.desc("event_id")], 100).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
    choice = F.when(F.col("n") < 20, "hold").when(F.col("p95") > 98, "tighten").when(F.col("mean") > 50, "keep").otherwise("relax")
    return g.select("event_type", "n", F.round("mean", 6).alias("mean"), "p95", choice.alias("decision"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS i FROM events), g AS (SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value < 90 THEN 1 ELSE 0 END) AS BIGINT) AS s FROM r WHERE i <= 200 GROUP BY event_type)
SELECT event_type, n, s, round((s / n + 3.8416 / (2 * n) - 1.96 * sqrt((s / n * (1 - s / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS low FROM g""")
def rollout_evaluation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    g = windows.last_n(e, ["event_type"], [F.desc("event_id")], 200).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 90).alias("s"))
    return g.withColumn("low", F.round(stats.wilson_lower(F.col("s"), F.col("n")), 6))


@query()
def bootstrap_interval(spark, sf_dir):
    return ex.bootstrap_median(table(spark, sf_dir, "events"), ["event_type"], "value", rounds=10_000)


@query("SELECT s_suppkey, round(60 * least(1, s_acctbal / 10000) - 2 * (s_nationkey % 5) + least(20, 20 * (s_suppkey % 3)) + CASE WHEN s_nationkey % 2 = 0 THEN 15 ELSE 0 END, 6) AS route_score FROM supplier WHERE s_acctbal > 0 ORDER BY route_score DESC, s_suppkey LIMIT 6")
def provider_route(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    score = 60 * F.least(F.lit(1.0), F.col("s_acctbal") / 10000) - 2 * (F.col("s_nationkey") % 5) + F.least(F.lit(20), 20 * (F.col("s_suppkey") % 3)) + F.when(F.col("s_nationkey") % 2 == 0, 15).otherwise(0)
    return s.select("s_suppkey", F.round(score, 6).alias("route_score")).orderBy(F.desc("route_score"), "s_suppkey").limit(6)


@query("SELECT b.event_id AS b_event_id, c.event_id AS c_event_id FROM (SELECT *, event_id // 2000 AS slot FROM events WHERE event_id % 4 = 1) b JOIN (SELECT *, event_id // 2000 AS slot FROM events WHERE event_id % 4 = 3) c ON b.event_type = c.event_type AND b.user_id % 3 = c.user_id % 3 AND b.event_id % 3 = c.event_id % 3 AND b.event_id % 5 = c.event_id % 5 AND b.event_id % 7 = c.event_id % 7 AND CAST(floor(b.value) AS BIGINT) % 2 = CAST(floor(c.value) AS BIGINT) % 2 AND b.slot = c.slot AND b.event_id % 2 = c.event_id % 2")
def paired_join_wide(spark, sf_dir):
    """Two arms paired on a key of eight fields."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 1, "b").when(k % 4 == 3, "c").alias("arm"), "event_type", (F.col("user_id") % 3).alias("k1"), (k % 3).alias("k2"), (k % 5).alias("k3"), (k % 7).alias("k4"), (F.floor("value") % 2).alias("k5"), F.floor(k / 2000).alias("k6"), (k % 2).alias("k7"))
    return ex.paired(e, "arm", "b", "c", ["event_type", "k1", "k2", "k3", "k4", "k5", "k6", "k7"], ["event_id"]).select("b_event_id", "c_event_id")
