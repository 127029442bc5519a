"""Event logs: latest rows, supersession, chains, hierarchy and packs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.graph import cut
from ..operators.summary_tree import SummaryTree
from ..sources.tables import scratch, table
from ..streaming.polls import PollWatch
from .registry import query


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return windows.latest(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN 'not-current' WHEN turn < max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) THEN 'shadowed-by-newer' ELSE 'current' END AS temporal_status FROM conversations")
def latest_per_subject(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return windows.shadowed(c, ["conv_id"], "turn", F.col("role") == "user")


@query("SELECT event_id, user_id, event_type, recency FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events) WHERE recency <= 3")
def last_n_per_scope(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return windows.last_n(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).drop("ts")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 2")
def rollback_target(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id")
    return windows.last_n(e, ["user_id"], [F.desc("event_id")], 2).where("recency = 2").drop("recency")


@query("""WITH links AS (SELECT event_id - 97 AS old, event_id AS new FROM events WHERE event_type = 'purchase')
SELECT e.event_id, coalesce(max(new), -1) AS superseded_by FROM events e LEFT JOIN links ON e.event_id = old GROUP BY e.event_id""")
def supersession(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.array(F.col("event_id") - 97)).alias("old"))
    return windows.superseded(e, "event_id", "event_id", F.col("old")).select("event_id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


@query("SELECT conv_id, turn, round(turn / max(turn) OVER (PARTITION BY conv_id), 6) AS position FROM conversations")
def position_recency(spark, sf_dir):
    out = windows.position_recency(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")
    return out.withColumn("position", F.round("position", 6))


def _body():
    return F.concat_ws("|", F.col("turn").cast("string"), "role", "text")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
chain AS (SELECT conv_id, turn, i, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || '|' || concat_ws('|', CAST(turn AS VARCHAR), role, text)) AS event_hash FROM c WHERE i = 1
UNION ALL SELECT c.conv_id, c.turn, c.i, chain.event_hash, sha256(chain.event_hash || '|' || concat_ws('|', CAST(c.turn AS VARCHAR), c.role, c.text)) FROM chain JOIN c ON c.conv_id = chain.conv_id AND c.i = chain.i + 1)
SELECT conv_id, turn, previous_hash, event_hash FROM chain""")
def hash_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return windows.chained(c, ["conv_id"], ["turn"], _body()).select("conv_id", "turn", "previous_hash", "event_hash")


@query("SELECT conv_id, count(*) AS n_rows, max(turn) - min(turn) + 1 = count(*) AND conv_id % 5 <> 0 AS valid FROM conversations GROUP BY conv_id")
def chain_verify(spark, sf_dir):
    """Chains, those of every fifth conversation tampered with at their first row."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chained = windows.chained(c, ["conv_id"], ["turn"], _body())
    least = chained.groupBy("conv_id").agg(F.min("turn").alias("t0"))
    bad = chained.join(least, "conv_id").withColumn("role", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == F.col("t0")), "forged").otherwise(F.col("role")))
    return windows.verify_chain(bad, ["conv_id"], "turn", _body()).select("conv_id", "n_rows", "valid")


@query("SELECT conv_id, count(*) AS segments, true AS contiguous FROM conversations GROUP BY conv_id")
def segment_contiguity(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n"))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    return windows.contiguous(c.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")), ["conv_id"], "turn", "start", "end")


@query("SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR b IS DISTINCT FROM event_type")
def consecutive_dedup(spark, sf_dir):
    return windows.drop_consecutive(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
b AS (SELECT user_id, pos // 4 AS node, min(pos) AS first, max(pos) AS last, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT user_id, node // 2 AS node, min(first) AS first, max(last) AS last, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY user_id, node // 2),
d AS (SELECT user_id, node // 2 AS node, min(first) AS first, max(last) AS last, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY user_id, node // 2)
SELECT user_id, 0 AS level, node, first, last, n FROM b UNION ALL SELECT user_id, 1, node, first, last, n FROM c UNION ALL SELECT user_id, 2, node, first, last, n FROM d""")
def hierarchical_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    out = windows.hierarchy(e, ["user_id"], ["event_id"], 4, 2, 3)
    return out.select("user_id", "level", F.col("node").cast("bigint").alias("node"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "n")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 2000")
def budget_pack_stop(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return windows.pack_until(c, ["conv_id"], [F.desc("turn")], "n", 2000).select("conv_id", "turn")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, i, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used, CASE WHEN n <= 1500 THEN [turn] ELSE [] END AS items FROM c WHERE i = 1
UNION ALL SELECT c.conv_id, c.i, CASE WHEN used + n <= 1500 THEN used + n ELSE used END, CASE WHEN used + n <= 1500 THEN list_append(items, turn) ELSE items END FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
SELECT conv_id, CAST(used AS BIGINT) AS used, CAST(len(items) AS INT) AS n_items, array_to_string(items, ',') AS items FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""")
def budget_pack_skip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return windows.pack_skipping(c, ["conv_id"], ["turn"], "n", 1500, "turn").withColumn("items", F.array_join("items", ","))


@query("SELECT conv_id, turn, role, CAST(count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS near FROM conversations WHERE turn >= 0")
def context_lines(spark, sf_dir):
    from pyspark.sql import Window

    near = F.count("*").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2))
    return table(spark, sf_dir, "conversations").where("turn >= 0").select("conv_id", "turn", "role", near.alias("near"))


@query("""SELECT conv_id, count(*) AS n_events, count(DISTINCT role) AS n_roles, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id""")
def session_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_events"), F.count_distinct("role").alias("n_roles"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("n_chars"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, i, value AS m FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, f.m * 0.8::DOUBLE + e.value * 0.2::DOUBLE FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(arg_max(m, i), 6) AS latency, count(*) AS n FROM f GROUP BY user_id""")
def ewma_latency(spark, sf_dir):
    found = windows.ewma(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value")
    return found.select("user_id", F.round("mean", 6).alias("latency"), "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, i, CAST(CASE WHEN value > 80 THEN 1 ELSE 0 END AS BIGINT) AS run FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, CASE WHEN e.value > 80 THEN f.run + 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, max(run) AS worst, CASE WHEN max(run) >= 3 THEN least(900, 30 * power(2, max(run) - 3)) ELSE 0 END AS open_seconds FROM f GROUP BY user_id""")
def circuit_breaker(spark, sf_dir):
    """The longest run of failures a user, by islands of a running count of successes."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("bad", F.col("value") > 80).withColumn("island", F.sum((~F.col("bad")).cast("int")).over(w))
    runs = e.groupBy("user_id", "island").agg(F.count_if("bad").alias("run")).groupBy("user_id").agg(F.max("run").alias("worst"))
    return runs.withColumn("open_seconds", F.when(F.col("worst") >= 3, F.least(F.lit(900.0), 30 * F.pow(F.lit(2.0), F.col("worst") - 3))).otherwise(0.0))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_type, event_id, i, event_id AS stored, false AS hit FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.i, CASE WHEN e.event_id - stored <= 2000 THEN stored ELSE e.event_id END, e.event_id - stored <= 2000 FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)
SELECT user_id, count_if(hit) AS hits, count_if(NOT hit) AS misses FROM f GROUP BY user_id""")
def response_cache_hits(spark, sf_dir):
    """Requests by user and kind, stored at a miss for 2000 ticks."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return windows.cache_hits(e, ["user_id", "event_type"], "event_id", 2000).groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0) a FULL OUTER JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 5 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
def snapshot_diff(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    before = p.where(k % 3 != 0).select(k.alias("k"), F.col("p_size").alias("v"))
    now = p.where(k % 5 != 0).select(k.alias("k"), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))
    return windows.snapshot_diff(before, now, ["k"], F.col("v"))


@query("""WITH s AS (SELECT event_id // 1000 AS poll, user_id, max(event_type) AS v FROM events GROUP BY 1, 2), t AS (SELECT DISTINCT poll FROM s)
SELECT coalesce(b.poll, a.poll + 1) AS poll, coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.poll IS NULL THEN 'added' WHEN b.poll IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM s a FULL JOIN s b ON a.user_id = b.user_id AND b.poll = a.poll + 1
WHERE (a.poll IS NULL AND b.poll > (SELECT min(poll) FROM t)) OR (b.poll IS NULL AND a.poll < (SELECT max(poll) FROM t)) OR a.v <> b.v""")
def poll_and_diff(spark, sf_dir):
    """Users seen in each thousand events, poll after poll."""
    e = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("poll"), "user_id").agg(F.max("event_type").alias("v"))
    return windows.polled(e, "poll", ["user_id"], F.col("v"))


@query("""WITH s AS (SELECT event_id // 1000 AS poll, user_id, max(event_type) AS v FROM events WHERE event_id // 1000 % 4 <> 2 GROUP BY 1, 2), t AS (SELECT DISTINCT event_id // 1000 AS poll FROM events)
SELECT coalesce(b.poll, a.poll + 1) AS poll, coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.poll IS NULL THEN 'added' WHEN b.poll IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM s a FULL JOIN s b ON a.user_id = b.user_id AND b.poll = a.poll + 1
WHERE a.poll IS NULL OR (b.poll IS NULL AND a.poll < (SELECT max(poll) FROM t)) OR a.v <> b.v""")
def stream_poll_and_diff(spark, sf_dir):
    """Users seen in each thousand events as polls in three micro-batches; each fourth poll finds nothing."""
    e = table(spark, sf_dir, "events").withColumn("poll", F.floor(F.col("event_id") / 1000))
    seen = e.where("poll % 4 <> 2").groupBy("poll", "user_id").agg(F.max("event_type").alias("v"))
    marks = e.select("poll").distinct().select("poll", F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("v"))
    rows = cut(seen.unionByName(marks))
    watch = PollWatch(spark, scratch(spark, "polls"), "poll", ["user_id"], F.col("v"))
    last = rows.agg(F.max("poll")).first()[0]
    for batch in range(3):
        watch.take(rows.where(F.floor(F.col("poll") * 3 / F.lit(last + 1)) == batch), batch)
    return watch.changes().select("poll", "user_id", "change")


def _tree_sql(leaf: int, fanout: int, levels: int) -> str:
    out = ["e AS (SELECT CAST(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, sha256(CAST(event_id AS VARCHAR)) AS hash, value FROM events)"]
    out.append(f"l0 AS (SELECT session, k // {leaf} AS node, min(k) AS first, max(k) AS last, count(*) AS n, count(*) AS children, sha256(string_agg(hash, '' ORDER BY k)) AS hash, sum(value) AS total FROM e GROUP BY 1, 2)")
    for i in range(1, levels):
        out.append(f"l{i} AS (SELECT session, node // {fanout} AS node, min(first) AS first, max(last) AS last, sum(n) AS n, count(*) AS children, sha256(string_agg(hash, '' ORDER BY node)) AS hash, sum(total) AS total FROM (SELECT *, count(*) OVER (PARTITION BY session) AS c FROM l{i - 1}) WHERE c > 1 GROUP BY 1, 2)")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT session, {i} AS level, CAST(node AS BIGINT) AS node, first, last, CAST(n AS BIGINT) AS n, CAST(children AS INT) AS children, hash, round(total, 4) AS total FROM l{i}" for i in range(levels))


@query(_tree_sql(8, 4, 12))
def summary_tree(spark, sf_dir):
    """The tree of summaries over each user's events, appended in three batches."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.row_number().over(order) - 1).alias("number"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    e, path = e.withColumn("batch", F.floor(3 * F.col("number") / F.col("n"))), scratch(spark, "summary-tree-events")
    e.write.partitionBy("batch").parquet(path)  # a batch reads its own rows alone
    e = spark.read.schema(e.schema).parquet(path).withColumn("hash", F.sha2(F.col("event_id").cast("string"), 256))
    tree = SummaryTree(spark, scratch(spark, "summary-tree"), 8, 4, 1)
    for batch in range(3):
        tree.append(e.where(F.col("batch") == batch), batch, "user_id", "number", "hash", [F.col("value")])
    return tree.nodes().select("session", "level", "node", "first", "last", "n", "children", "hash", F.round(F.col("sums")[0], 4).alias("total"))
