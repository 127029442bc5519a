"""Graph analytics over part-supplier and customer edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import table
from .registry import query

#: Parts (even nodes) and suppliers (odd ones): goods go from a supplier to a part, returned ones back.
_EDGES = "SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 2 * l_partkey ELSE 2 * l_suppkey + 1 END AS src, CASE WHEN l_returnflag = 'R' THEN 2 * l_suppkey + 1 ELSE 2 * l_partkey END AS dst FROM lineitem"


def _edges(spark, sf_dir, by=None):
    """Edges once each; by: shuffled but once, for that column, where what takes them wants them."""
    back, part, supplier = F.col("l_returnflag") == "R", 2 * F.col("l_partkey"), 2 * F.col("l_suppkey") + 1
    every = table(spark, sf_dir, "lineitem").select(F.when(back, part).otherwise(supplier).alias("src"), F.when(back, supplier).otherwise(part).alias("dst"))
    if not by:
        return every.distinct()
    with graph.in_rounds(every):
        return graph.placed(every, by).distinct()


def _seed(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node bigint")


@query(f"WITH e AS ({_EDGES}) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"WITH e AS ({_EDGES}), o AS (SELECT src AS node, count(DISTINCT dst) AS efferent FROM e GROUP BY src), i AS (SELECT dst AS node, count(DISTINCT src) AS afferent FROM e GROUP BY dst) SELECT node, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent, round(coalesce(efferent, 0) / (coalesce(afferent, 0) + coalesce(efferent, 0)), 6) AS instability FROM o FULL JOIN i USING (node)")
def coupling(spark, sf_dir):
    return graph.coupling(_edges(spark, sf_dir)).withColumn("instability", F.round("instability", 6))


_BFS = f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT {{0}}, depth + 1 FROM r JOIN e ON {{1}} = node WHERE depth < {{2}}) SELECT node, min(depth) AS depth FROM r GROUP BY node"


@query(_BFS.format("e.dst", "e.src", 3))
def call_hierarchy(spark, sf_dir):
    return graph.reach(_edges(spark, sf_dir), _seed(spark, 3), 3)


@query(_BFS.format("e.src", "e.dst", 4))
def reverse_impact(spark, sf_dir):
    return graph.reach(_edges(spark, sf_dir), _seed(spark, 3), 4, reverse=True)


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = node WHERE depth < 4), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT node % 2 AS path, min(depth) AS depth, count(*) AS symbols FROM m GROUP BY node % 2")
def blast_radius(spark, sf_dir):
    found = graph.reach(_edges(spark, sf_dir), _seed(spark, 3), 4, reverse=True)
    return found.groupBy((F.col("node") % 2).alias("path")).agg(F.min("depth").alias("depth"), F.count("*").alias("symbols"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(3 AS BIGINT) AS seed, CAST(3 AS BIGINT) AS node UNION SELECT 7, 7 UNION SELECT seed, e.dst FROM r JOIN e ON e.src = node) SELECT seed, node FROM r")
def dependency_closure(spark, sf_dir):
    return graph.closure(_edges(spark, sf_dir), _seed(spark, 3, 7))


@query(f"WITH e AS ({_EDGES}) SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def two_cycles(spark, sf_dir):
    return graph.two_cycles(_edges(spark, sf_dir))


@query()
def strong_components(spark, sf_dir):
    return graph.cycles(_edges(spark, sf_dir))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"WITH e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS n FROM n), o AS (SELECT src, count(*) AS out FROM e GROUP BY src), r0 AS (SELECT node, 1.0 / c.n AS rank FROM n, c)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + coalesce((SELECT sum(rank) FROM r{i} WHERE node NOT IN (SELECT src FROM o)), 0) / c.n) AS rank FROM n CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM e JOIN o USING (src) JOIN r{i} ON r{i}.node = src GROUP BY dst) g ON g.dst = n.node)")
    return ", ".join(parts) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql(30))
def pagerank(spark, sf_dir):
    return graph.pagerank(_edges(spark, sf_dir, "src")).withColumn("rank", F.round("rank", 6))


def _personalized_sql(rounds: int) -> str:
    parts = [f"WITH e AS ({_EDGES}), o AS (SELECT src, count(*) AS out FROM e GROUP BY src), l AS MATERIALIZED (SELECT src, dst, 1.0 / out AS share FROM e JOIN o USING (src)), b AS (SELECT 3 AS node, 0.5 AS p UNION ALL SELECT 7, 0.5), r0 AS (SELECT node, p AS rank FROM b)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT node, sum(r) AS rank FROM (SELECT dst AS node, rank * share * 0.85::DOUBLE AS r FROM l JOIN r{i} ON node = src UNION ALL SELECT node, p * 0.15 FROM b) GROUP BY node)")
    return ", ".join(parts) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_personalized_sql(32))
def personalized_pagerank(spark, sf_dir):
    e = _edges(spark, sf_dir, "src").withColumn("weight", F.lit(1.0))
    return graph.personalized_pagerank(e, _seed(spark, 3, 7).withColumn("weight", F.lit(1.0))).withColumn("rank", F.round("rank", 6))


@query("SELECT 2 * p_partkey AS node FROM part WHERE p_size > 5 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def dead_code(spark, sf_dir):
    """Parts that no large line points at."""
    calls = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select((2 * F.col("l_partkey")).alias("dst"))
    nodes = table(spark, sf_dir, "part").select((2 * F.col("p_partkey")).alias("node"), "p_size")
    return graph.unreferenced(nodes, calls, "p_size <= 5").select("node")


@query(f"WITH e AS ({_EDGES}) SELECT src AS node, dst AS neighbour FROM e WHERE src = 3 UNION SELECT dst, src FROM e WHERE dst = 3")
def neighbours(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return e.where("src = 3").select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(e.where("dst = 3").select("dst", "src")).distinct()


@query("WITH RECURSIVE l AS (SELECT event_id, event_id AS root, 0 AS hops FROM events WHERE event_id % 8 = 0 UNION ALL SELECT e.event_id, l.root, hops + 1 FROM l JOIN events e ON e.event_id = l.event_id + 1 AND e.event_id % 8 <> 0) SELECT root, count(*) AS n, max(hops) AS hops FROM l GROUP BY root")
def lineage_chain(spark, sf_dir):
    """Follows pointers from every eighth event to those behind it."""
    e, k = table(spark, sf_dir, "events").select("event_id"), F.col("event_id")
    links = e.where(k % 8 != 0).select((k - 1).alias("src"), k.alias("dst"))
    steps = graph.lineage(links, e.where(k % 8 == 0).select(k.alias("root")))
    return steps.groupBy("root").agg(F.sum("n").alias("n"), F.max("hops").alias("hops"))


@query("SELECT body, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, md5(regexp_replace(lower(p_type), '\\s+', ' ', 'g')) AS body FROM part) GROUP BY body HAVING count(*) > 1")
def duplicate_bodies(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.md5(F.regexp_replace(F.lower("p_type"), r"\s+", " ")).alias("body"))
    return p.groupBy("body").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("SELECT l_suppkey, round(count(DISTINCT l_partkey) * log2(2 + count(*)), 6) AS hotspot FROM lineitem GROUP BY l_suppkey ORDER BY hotspot DESC, l_suppkey LIMIT 20")
def hotspots(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.count_distinct("l_partkey") * F.log2(2.0 + F.count("*")), 6).alias("hotspot"))
    return g.orderBy(F.desc("hotspot"), "l_suppkey").limit(20)


@query("SELECT o_orderkey, CASE WHEN risk >= 40 THEN 'high' WHEN risk >= 15 THEN 'medium' ELSE 'low' END AS level FROM (SELECT l_orderkey AS o_orderkey, count(*) + log2(1 + sum(l_quantity)) AS risk FROM lineitem GROUP BY l_orderkey)")
def change_risk(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") + F.log2(1 + F.sum("l_quantity"))).alias("risk"))
    return g.select("o_orderkey", F.when(F.col("risk") >= 40, "high").when(F.col("risk") >= 15, "medium").otherwise("low").alias("level"))
