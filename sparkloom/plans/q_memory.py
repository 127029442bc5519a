"""Memories, sessions, jobs, plans, tools and several graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import externalize as ext, jobs, memory, multigraph, planning, views
from ..sources.tables import table
from .registry import query

_WORDS = "list_filter(regexp_extract_all(lower({0}), '{1}'), lambda x: length(x) >= {2})"


def _memories(spark, sf_dir):
    """Documents as memories: the language is the class; some are superseded or have expired."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(k.alias("memory_id"), "text", F.col("lang").alias("memory_class"), (k % 10 / 10.0).alias("confidence"), (k * 3600.0).alias("created_at"), F.when(k % 13 == 0, k + 1).alias("superseded_by"), F.when(k % 17 == 0, 1000.0).alias("expires_at"))


_MEMORY_SQL = """WITH m AS (SELECT doc_id, lang, text, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.-]+'), lambda x: length(x) >= 1) AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM m),
tf AS (SELECT doc_id, q, len(w) AS len, len(list_filter(w, lambda x: x = q)) AS f FROM m, (SELECT unnest(['that', 'idea']) AS q)),
df AS (SELECT q, count_if(f > 0) AS df FROM tf GROUP BY q),
r AS (SELECT doc_id, sum(CASE WHEN f > 0 THEN greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / greatest(a, 1))) ELSE 0 END) AS rank, bool_or(f > 0) AS hit FROM tf JOIN df USING (q), s GROUP BY doc_id),
best AS (SELECT doc_id, rank FROM r WHERE hit AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 ORDER BY rank DESC, doc_id LIMIT 80),
w AS (SELECT event_id % 200 AS doc_id, sum(value / 100) AS w FROM events GROUP BY 1)
SELECT doc_id AS memory_id, round(0.55 / (1 + rank) + 0.25 * (doc_id % 10) / 10.0 + 0.12 * exp(-greatest(4e6 - doc_id * 3600.0, 0) / 86400.0 / 90) + 0.08 * least(1, coalesce(w, 0) / 5), 6) AS score
FROM best LEFT JOIN w USING (doc_id) ORDER BY 0.55 / (1 + rank) + 0.25 * (doc_id % 10) / 10.0 + 0.12 * exp(-greatest(4e6 - doc_id * 3600.0, 0) / 86400.0 / 90) + 0.08 * least(1, coalesce(w, 0) / 5) DESC, doc_id DESC LIMIT 20"""


@query(_MEMORY_SQL)
def memory_search(spark, sf_dir):
    relations = table(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("target_id"), (F.col("value") / 100).alias("weight"))
    found = memory.search(_memories(spark, sf_dir), relations, "that idea", 4e6, 20)
    return found.select("memory_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS memory_id, 'substring' AS mode, round(0.55 + 0.25 * (doc_id % 10) / 10.0 + 0.12 * exp(-greatest(4e6 - doc_id * 3600.0, 0) / 86400.0 / 90), 6) AS score FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'hin th') AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 ORDER BY doc_id DESC LIMIT 40) ORDER BY 0.55 + 0.25 * (doc_id % 10) / 10.0 + 0.12 * exp(-greatest(4e6 - doc_id * 3600.0, 0) / 86400.0 / 90) DESC, doc_id DESC LIMIT 10")
def memory_search_substring(spark, sf_dir):
    """A query whose words no memory has as tokens is sought as it is written."""
    own = _memories(spark, sf_dir)
    none = spark.createDataFrame([], "target_id bigint, weight double")
    found = memory.search(own, none, "hin th", 4e6, 10, tokens=F.array().cast("array<string>"))
    return found.select("memory_id", "mode", F.round("score", 6).alias("score"))


@query("""WITH o AS (SELECT event_id, (event_id % 7) / 7.0 AS cosine, (event_id % 10) / 10.0 AS importance, value / 100 AS confidence, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE 1.0 END AS validity, event_id % 3 AS roi, event_type FROM events),
b AS (SELECT *, CASE WHEN event_type = 'error' THEN (SELECT ln(1 + (count(*) - count_if(event_type = 'error') + 0.5) / (count_if(event_type = 'error') + 0.5)) FROM events) ELSE 0 END * 4 + cosine * 25 + roi * 5 AS base FROM o WHERE validity > 0),
t AS (SELECT * FROM b WHERE base > 0 ORDER BY base DESC, event_id LIMIT 160),
r AS (SELECT t.*, e.event_id * 3600.0 AS updated_at FROM t JOIN events e USING (event_id) WHERE e.event_id % 4 <> 0 AND (CASE WHEN e.user_id % 5 = 0 THEN 'u0' WHEN e.user_id % 5 = 1 THEN '' ELSE 'u2' END) IN ('', 'u0'))
SELECT event_id AS memory_id, round(base + importance * 5 + confidence * 3 + validity * 2 + greatest(1 - ((SELECT max(updated_at) FROM r) - updated_at) / 86400.0 / 30, 0) * 4, 6) AS score FROM r ORDER BY base + importance * 5 + confidence * 3 + validity * 2 + greatest(1 - ((SELECT max(updated_at) FROM r) - updated_at) / 86400.0 / 30, 0) * 4 DESC, event_id LIMIT 20""")
def scoped_memory(spark, sf_dir):
    """Observations found by a query, and the active records of one user or of all that lead to them."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    o = e.select(k.alias("observation_id"), "event_type", (k % 10 / 10.0).alias("importance"), (F.col("value") / 100).alias("confidence"), F.when(k % 11 == 0, 0.0).otherwise(1.0).alias("validity"), (k % 3).alias("roi"))
    base = memory.observed(o, F.array("event_type"), ["error"], F.col("observation_id") % 7 / 7.0, 160)
    user = F.when(F.col("user_id") % 5 == 0, "u0").when(F.col("user_id") % 5 == 1, "").otherwise("u2")
    records = e.select(k.alias("memory_id"), k.alias("observation_id"), F.when(k % 4 == 0, "closed").otherwise("active").alias("state"), F.lit("p").alias("project_id"), user.alias("user_id"), F.lit(None).cast("string").alias("session_id"), (k * 3600.0).alias("updated_at"))
    return memory.scoped(base, records, memory.in_scope("p", "u0"), 20).select("memory_id", F.round("score", 6).alias("score"))


_SESSION = _WORDS.format("text", "[\\p{L}\\p{N}_./:-]+", 2)


@query(f"""WITH e AS (SELECT conv_id, turn + 1 AS sequence, len(list_intersect(['that', 'idea'], {_SESSION})) / 2 AS share, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
c AS (SELECT conv_id, 'event' AS kind, CAST(sequence AS VARCHAR) AS reference, share * 65 + sequence / n * 15 + CASE WHEN sequence % 5 = 0 THEN 15 ELSE 0 END AS score FROM e WHERE share > 0
UNION ALL SELECT conv_id, 'summary', 'first', len(list_intersect(['that', 'idea'], {_SESSION})) / 2 * 70 + 8 FROM conversations WHERE turn = 0 AND len(list_intersect(['that', 'idea'], {_SESSION})) > 0)
SELECT conv_id AS session, kind, reference, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, reference, kind) AS place FROM c) WHERE place <= 3""")
def session_memory_retrieve(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    events = c.select(F.col("conv_id").alias("session"), (F.col("turn") + 1).alias("sequence"), "text")
    summaries = c.where("turn = 0").select(F.col("conv_id").alias("session"), F.lit("first").alias("summary_id"), "text")
    pinned = memory.payload_weight(F.lit(0.0), F.col("sequence") % 5 == 0, F.lit(False))
    found = memory.session_hits(events, summaries, ["that", "idea"], 3, pinned)
    return found.withColumn("score", F.round("score", 6)).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT event_id AS sequence, CAST(3 * len(list_intersect(['click', 'error'], [event_type])) + CASE WHEN contains(event_type || ' ' || props, 'click error') THEN 4 ELSE 0 END AS INT) AS score FROM events WHERE event_type IN ('click', 'error') ORDER BY score DESC, event_id DESC LIMIT 15")
def session_recall(spark, sf_dir):
    captures = table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), "event_type", "props")
    return memory.recall(captures, ["event_type", "props"], "click error", 15).select("sequence", "score")


_TRANSCRIPT = "replace(replace(text, '. ', '.' || chr(10) || 'decision: '), ', ', chr(10) || 'never ')"


@query(f"""SELECT conv_id, kind, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS said FROM (
SELECT conv_id, 'decision' AS kind, trim(unnest(regexp_extract_all(t, '(?im)^\\s*(?:decision|decided|we will|keep|use)\\s*[:\\-]?\\s*(.+)$', 1)), ' ') AS s FROM (SELECT conv_id, {_TRANSCRIPT} AS t FROM conversations)
UNION ALL SELECT conv_id, 'constraint', trim(unnest(regexp_extract_all(t, '(?im)^\\s*(?:constraint|must|never)\\s*[:\\-]?\\s*(.+)$', 1)), ' ') FROM (SELECT conv_id, {_TRANSCRIPT} AS t FROM conversations)) WHERE s <> '' GROUP BY conv_id, kind""")
def memory_statements(spark, sf_dir):
    """Decisions and constraints that lines of transcripts state."""
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".\ndecision: ")), F.lit(", "), F.lit("\nnever "))
    found = memory.statements(table(spark, sf_dir, "conversations").select("conv_id", t.alias("text")), "conv_id", "text").where("kind in ('decision', 'constraint')")
    return found.groupBy("conv_id", "kind").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "\n")).alias("said"))


# jobs


def _jobs(spark, sf_dir):
    """Orders as jobs: their customer is the project; some run with leases that have run out."""
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when((F.col("o_orderstatus") == "P") & (k % 3 > 0), "running").otherwise("queued")
    o = table(spark, sf_dir, "orders").select(
        k.alias("job_id"), F.col("o_custkey").alias("project_id"), state.alias("state"), (k % 7).cast("int").alias("priority"), (k * 1.0).alias("created_at"), (k % 1000 * 1.0).alias("scheduled_at"), (k * 2.0).alias("updated_at"),
        (k % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), F.when(state == "running", "w").otherwise("").alias("lease_owner"), F.when(state == "running", k % 2000 * 1.0).otherwise(0.0).alias("lease_until"), F.lit("cpu").alias("resource_class"),
    )
    d = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") - 1).alias("dependency_id"))
    return o, d


_JOBS_SQL = """WITH j0 AS (SELECT o_orderkey AS job_id, o_custkey AS project_id, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' AND o_orderkey % 3 > 0 THEN 'running' ELSE 'queued' END AS state, o_orderkey % 7 AS priority, o_orderkey % 1000 AS scheduled_at, o_orderkey * 2.0 AS updated_at, o_orderkey % 4 AS attempt, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 > 0 THEN o_orderkey % 2000 ELSE 0 END AS lease_until FROM orders),
j AS (SELECT job_id, project_id, priority, attempt, CASE WHEN over AND attempt < 3 THEN 'queued' WHEN over THEN 'dead-letter' ELSE state END AS state, CASE WHEN over THEN 900 ELSE scheduled_at END AS scheduled_at, CASE WHEN over THEN 900 ELSE updated_at END AS updated_at FROM (SELECT *, state = 'running' AND lease_until > 0 AND lease_until <= 900 AS over FROM j0)),
d AS (SELECT DISTINCT l_orderkey AS job_id, l_orderkey - 1 AS dependency_id FROM lineitem WHERE l_quantity > 45),
c AS (SELECT j.*, coalesce((SELECT max(updated_at) FROM j p WHERE p.project_id = j.project_id AND p.state IN ('running', 'succeeded', 'failed')), 0) AS served FROM j WHERE state = 'queued' AND scheduled_at <= 900 AND NOT EXISTS (SELECT 1 FROM d JOIN j x ON x.job_id = d.dependency_id WHERE d.job_id = j.job_id AND x.state <> 'succeeded') AND (SELECT count(*) FROM j a WHERE a.project_id = j.project_id AND a.state = 'running') < 2)
"""


@query(_JOBS_SQL + "SELECT job_id, priority, CAST(served AS DOUBLE) AS served FROM c")
def job_candidates(spark, sf_dir):
    """All jobs that a worker may claim after expired leases are reaped."""
    o, d = _jobs(spark, sf_dir)
    return jobs.claimable(jobs.reap(o, 900.0), d, 900.0).select("job_id", F.col("priority").cast("bigint").alias("priority"), "served")


@query(_JOBS_SQL + ", one AS (SELECT job_id FROM c ORDER BY priority DESC, served, job_id LIMIT 1) SELECT CASE WHEN job_id IN (SELECT job_id FROM one) THEN 'running' ELSE state END AS state, count(*) AS n, CAST(sum(attempt + CASE WHEN job_id IN (SELECT job_id FROM one) THEN 1 ELSE 0 END) AS BIGINT) AS attempts FROM j GROUP BY 1")
def job_claim(spark, sf_dir):
    """The queue after one claim: a state, its jobs and attempts."""
    after, _ = jobs.claim(*_jobs(spark, sf_dir), "worker", 900.0)
    return after.groupBy("state").agg(F.count("*").alias("n"), F.sum("attempt").alias("attempts"))


@query(_JOBS_SQL + """, r AS (SELECT c.*, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, job_id) AS place, (SELECT count(*) FROM j a WHERE a.project_id = c.project_id AND a.state = 'running') AS running FROM c),
o AS (SELECT job_id, project_id, priority, row_number() OVER (ORDER BY priority DESC, CASE WHEN place = 1 THEN served ELSE greatest(served, 900) END, job_id) AS turn FROM r WHERE place + running <= 2)
SELECT job_id, project_id, priority, 'w' || lpad(CAST(turn AS VARCHAR), 3, '0') AS lease_owner FROM o WHERE turn <= 200""")
def job_claim_batch(spark, sf_dir):
    """Two hundred workers claim a job each, with fair shares of the projects."""
    _, took = jobs.claim_batch(*_jobs(spark, sf_dir), [f"w{i:03}" for i in range(1, 201)], 900.0)
    return took.select("job_id", "project_id", F.col("priority").cast("bigint").alias("priority"), "lease_owner")


@query(_JOBS_SQL + "SELECT state, count(*) AS n FROM j GROUP BY state")
def lease_reap(spark, sf_dir):
    return jobs.reap(_jobs(spark, sf_dir)[0], 900.0).groupBy("state").agg(F.count("*").alias("n"))


# plans


def _plan_events(spark, sf_dir):
    """Turns as events: pairs of subjects, some that name an earlier one as superseded, some revoked."""
    t = F.col("turn")
    kind = F.when(t % 4 == 1, "decision").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), (t + 1).alias("sequence"), kind.alias("event_type"), "text", F.when(t % 3 == 0, F.concat(F.lit("s"), (t % 2).cast("string"))).alias("subject"),
        F.array(F.concat(F.lit("d"), t.cast("string"))).alias("identifiers"), F.when(t % 5 == 4, F.array(F.concat(F.lit("d"), (t - 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("supersedes"), (t % 7 == 6).alias("revoked"),
    )


_STATUS_SQL = """WITH e AS (SELECT conv_id, turn, turn + 1 AS sequence, CASE WHEN turn % 4 = 1 THEN 'decision' ELSE role END AS kind, text, CASE WHEN turn % 3 = 0 THEN turn % 2 END AS subject FROM conversations),
st AS (SELECT e.*, CASE WHEN subject IS NOT NULL AND sequence <> (SELECT max(sequence) FROM e x WHERE x.conv_id = e.conv_id AND x.subject = e.subject) THEN 'superseded' WHEN EXISTS (SELECT 1 FROM e x WHERE x.conv_id = e.conv_id AND x.turn % 5 = 4 AND x.turn - 3 = e.turn) THEN 'superseded' WHEN turn % 7 = 6 THEN 'revoked' ELSE 'current' END AS status FROM e)
"""


@query(_STATUS_SQL + "SELECT conv_id AS session, sequence, status FROM st")
def temporal_status(spark, sf_dir):
    return planning.temporal_status(_plan_events(spark, sf_dir)).select("session", "sequence", "status")


_PLAN_WORDS = _WORDS.format("concat_ws(' ', kind, text)", "[a-z0-9_./:-]+", 2)


@query(_STATUS_SQL + f""", sc AS (SELECT conv_id, sequence, status, kind, len(list_intersect(['that', 'idea'], w)) AS shared, len(list_distinct(list_concat(w, ['that', 'idea']))) AS u, max(sequence) OVER (PARTITION BY conv_id) AS last FROM (SELECT *, {_PLAN_WORDS} AS w FROM st))
SELECT conv_id AS session, sequence, round(shared / u * 10 + sequence / last * 2 + CASE WHEN status = 'current' THEN 2 ELSE -2.5 END + CASE WHEN kind = 'decision' THEN 2 ELSE 0 END, 6) AS score, sequence > last - 2 OR (kind = 'decision' AND status = 'current') AS mandatory FROM sc
WHERE status = 'current' OR sequence > last - 2 OR shared > 0""")
def long_session_plan(spark, sf_dir):
    """Scores of a plan with room for all candidates."""
    plan = planning.session_plan(_plan_events(spark, sf_dir), ["that", "idea"], planning.Policy(budget=10**9, recent=2))
    return plan.select("session", "sequence", F.round("score", 6).alias("score"), "mandatory")


@query()
def session_plan_budget(spark, sf_dir):
    """What fits 600 tokens a session; tests hold it against a fold in Python."""
    c = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("session"), F.lit("first").alias("summary_id"), "text")
    return planning.session_plan(_plan_events(spark, sf_dir), ["that", "idea"], planning.Policy(budget=600, recent=2), c).select("session", "role", "sequence", "mandatory", "status", "tokens")


def _segments(spark, sf_dir):
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("artifact"), t.alias("segment"), F.col("role").alias("kind"), (1.0 + t % 3).alias("salience"), (t % 4 == 3).alias("critical"), F.col("text").alias("body"), F.concat(F.lit("logs/"), F.col("conv_id") % 10, F.lit(".txt")).alias("path"), F.lit(1).alias("start_line"))


_SEG = _WORDS.format("text", "[a-z_][a-z0-9_.:/-]{1,}", 2)


@query(f"""SELECT conv_id AS artifact, turn AS segment, 3.0 * n + 1 + turn % 3 + CASE WHEN contains(lower(text), 'of the') THEN 6 ELSE 0 END + CASE WHEN turn % 4 = 3 THEN 3 ELSE 0 END + 2 AS score
FROM (SELECT *, len(list_intersect(['of', 'the'], {_SEG})) AS n FROM conversations WHERE role = 'user' AND conv_id % 10 < 10) WHERE n > 0 ORDER BY score DESC, artifact, segment LIMIT 40""")
def segment_search(spark, sf_dir):
    """A query with filters in line."""
    hits = planning.segment_hits(_segments(spark, sf_dir), "kind:user of path:LOGS/ the", 40)
    return hits.select("artifact", "segment", "score")


@query()
def search_pack(spark, sf_dir):
    """Sections of the best hits in one text of 4 KiB; a test holds it against Python."""
    return planning.search_pack(planning.segment_hits(_segments(spark, sf_dir), "kind:assistant that idea", 32), 4096)


# tools


def _tools(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws(".", F.lower("p_brand"), "p_partkey").alias("name"), F.lower("p_brand").alias("family"), F.lower("p_name").alias("description"), (F.col("p_size") + 10).cast("bigint").alias("tokens"))


_TOOL = "5 * len(list_intersect(['brand', '13', 'small', 'ring'], regexp_extract_all(lower(p_brand), '[a-z0-9]+'))) + 3 * len(list_intersect(['brand', '13', 'small', 'ring'], regexp_extract_all(lower(p_brand) || '.' || p_partkey, '[a-z0-9]+'))) + len(list_intersect(['brand', '13', 'small', 'ring'], regexp_extract_all(lower(p_name), '[a-z0-9]+')))"


@query(f"""WITH s AS (SELECT lower(p_brand) AS family, lower(p_brand) || '.' || p_partkey AS name, {_TOOL} AS score FROM part),
f AS (SELECT family, max(score) AS score, count(*) AS tool_count, md5(string_agg(name, ',' ORDER BY name)) AS tools FROM s WHERE score > 0 GROUP BY family)
SELECT family, score, tool_count, tools, CASE WHEN (SELECT count(*) FROM f WHERE score = (SELECT max(score) FROM f)) > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM f
WHERE (SELECT count(*) FROM f WHERE score = (SELECT max(score) FROM f)) = 1 OR score = (SELECT max(score) FROM f) ORDER BY score DESC, family LIMIT 8""")
def tool_family_search(spark, sf_dir):
    found = planning.tool_families(_tools(spark, sf_dir), "Brand 13 small ring")
    return found.select("family", F.col("score").cast("bigint").alias("score"), "tool_count", F.md5(F.array_join("tools", ",")).alias("tools"), "status")


@query(f"""WITH one AS (SELECT min(lower(p_brand)) AS b FROM part), s AS (SELECT lower(p_brand) || '.' || p_partkey AS name, {_TOOL} AS score, p_size + 10 AS tokens FROM part, one WHERE lower(p_brand) = b ORDER BY score DESC, name LIMIT 16)
SELECT name, score, CAST(tokens AS BIGINT) AS tokens, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(tokens) OVER (ORDER BY score DESC, name) AS used FROM s) WHERE used <= 300""")
def tool_selection(spark, sf_dir):
    family = table(spark, sf_dir, "part").agg(F.min(F.lower("p_brand"))).first()[0]
    found = planning.tool_selection(_tools(spark, sf_dir), family, "Brand 13 small ring", 300)
    return found.withColumn("score", F.col("score").cast("bigint"))


# several graphs


def _layers(spark, sf_dir):
    """Parts as code and suppliers as entities; the same items again as tasks; some are tainted or denied."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    node = lambda df, layer, kind, key, item, text, trust, fresh, taint, bad: df.select(F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), key.cast("string").alias("node"), item.alias("item_id"), F.lit("").alias("uri"), text.alias("label"), F.lower(text).alias("text"), trust.alias("trust"), fresh.alias("freshness"), taint.alias("tainted"), bad.alias("disposition"))
    k, z = F.col("p_partkey"), F.col("s_suppkey")
    item, none = F.concat(F.lit("p"), k), F.lit("")
    nodes = node(p, "code", "code", k, item, F.col("p_name"), F.when(k % 3 == 0, "verified").otherwise("unknown"), F.when(k % 5 == 0, "stale").otherwise("current"), k % 41 == 0, none)
    nodes = nodes.unionByName(node(p.where("p_size < 20"), "tasks", "task", k, item, F.concat_ws(" ", "p_name", "p_type"), F.lit("trusted"), F.lit("current"), F.lit(False), none))
    nodes = nodes.unionByName(node(s, "people", "entity", z, none, F.col("s_name"), F.lit("trusted"), F.lit("current"), F.lit(False), none))
    nodes = nodes.unionByName(node(p.where("p_partkey % 53 = 0"), "guard", "security", k, item, F.lit("rule"), F.lit("trusted"), F.lit("current"), F.lit(False), F.lit("deny")))
    edges = p.select(F.lit("code").alias("layer"), k.cast("string").alias("src"), (k + 1 + k % 7).cast("string").alias("dst"), F.lit("calls").alias("relation"), F.lit(0.9).alias("confidence"))
    return nodes, edges.unionByName(p.select(F.lit("code"), k.cast("string"), (k + 3).cast("string"), F.lit("imports"), F.lit(0.6)).toDF(*edges.columns))


@query()
def multi_graph_search(spark, sf_dir):
    """Held against a breadth-first search in Python by the tests."""
    return multigraph.retrieve(*_layers(spark, sf_dir), "small ring").select("identity", "score", F.array_join("kinds", ",").alias("kinds"))


@query("""WITH n AS (SELECT 'p' || p_partkey AS item, p_name AS label, 'code' AS kind, lower(p_name) AS text, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.78 END * CASE WHEN p_partkey % 5 = 0 THEN 0.55 ELSE 1.0 END AS w, p_partkey FROM part
UNION ALL SELECT 'p' || p_partkey, p_name, 'task', lower(p_name || ' ' || p_type), 1.12 * 0.96, p_partkey FROM part WHERE p_size < 20),
m AS (SELECT item, kind, w * (len(list_intersect(['small', 'ring'], regexp_extract_all(text, '[a-z0-9_./:@-]+'))) / 2 * 10 + CASE WHEN contains(text, 'small ring') THEN 5 ELSE 0 END + CASE WHEN kind = 'task' AND len(list_intersect(['small', 'ring'], regexp_extract_all(text, '[a-z0-9_./:@-]+'))) > 0 THEN 2 ELSE 0 END) AS score FROM n WHERE p_partkey % 41 <> 0 AND p_partkey % 53 <> 0)
SELECT 'item:' || item AS identity, round(sum(score) + CASE WHEN count(DISTINCT kind) > 1 THEN 1.25 ELSE 0 END, 6) AS score FROM m WHERE score > 0 GROUP BY item ORDER BY 2 DESC, 1 LIMIT 30""")
def multi_graph_seeds(spark, sf_dir):
    """Without hops: words, trust, freshness and fusion, without what is blocked."""
    return multigraph.retrieve(*_layers(spark, sf_dir), "small ring", 30, 0).select("identity", "score")


@query("""WITH s AS (SELECT p_brand AS path, split_part(p_name, ' ', 2) AS name, p_name AS q, p_partkey AS line FROM part),
f AS (SELECT path, n, arg_max(path || ':' || q || ':' || line, line) AS node FROM (SELECT path, name AS n, q, line FROM s UNION SELECT path, q, q, line FROM s) GROUP BY path, n),
e AS (SELECT a.p_brand AS sp, a.p_name AS ss, b.p_brand AS tp, split_part(b.p_name, ' ', 2) AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT x.node AS src, y.node AS dst, count(*) AS n FROM e JOIN f x ON x.path = sp AND x.n = ss JOIN f y ON y.path = tp AND y.n = t WHERE x.node <> y.node GROUP BY 1, 2""")
def structural_import(spark, sf_dir):
    """Parts as symbols of files by their brands, each calling the next one by its plain name."""
    p = table(spark, sf_dir, "part")
    plain = F.split_part("p_name", F.lit(" "), F.lit(2))
    symbols = p.select(F.col("p_brand").alias("path"), plain.alias("name"), F.col("p_name").alias("qualified_name"), F.lit("function").alias("kind"), F.col("p_partkey").alias("line"), F.lit(0.8).alias("confidence"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("target_path"), plain.alias("target"))
    calls = p.select("p_partkey", F.col("p_brand").alias("source_path"), F.col("p_name").alias("source_symbol")).join(b, "p_partkey").select("source_path", "source_symbol", "target_path", "target", F.lit("calls").alias("edge_type"), F.lit(0.9).alias("confidence"))
    _, edges = multigraph.structural_layer(symbols, calls, "code", "r")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


# outputs


def _by_stream():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN first(text) OVER (PARTITION BY conv_id ORDER BY turn) ELSE text || chr(10) || 'error: x' END AS text FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS scope, turn AS sequence, CASE conv_id % 3 WHEN 0 THEN 'test-output' WHEN 1 THEN 'git-log' ELSE CASE WHEN left(ltrim(text), 1) IN ('{', '[') THEN 'json' WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)\\b(error|failed|failure|panic|assertion|traceback|exception|fatal|denied|timeout|critical|segfault)\\b'))) >= 2 THEN 'log' ELSE 'text' END END AS family, row_number() OVER w > 1 AS repeated, row_number() OVER w AS seen, strlen(text) AS n_bytes FROM p WINDOW w AS (PARTITION BY conv_id, text ORDER BY turn)""")
def externalized(spark, sf_dir):
    """Payloads by stream: families, and which repeat; tests hold previews and gates against Python."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    text = F.when(t % 3 == 2, F.first("text").over(_by_stream())).otherwise(F.concat(F.col("text"), F.lit("\nerror: x")))
    command = F.when(F.col("conv_id") % 3 == 0, "pytest -q").when(F.col("conv_id") % 3 == 1, "git log").otherwise("cat x")
    p = c.select(F.col("conv_id").cast("string").alias("scope"), t.alias("sequence"), F.lit("shell").alias("tool"), command.alias("command"), F.lit("").alias("path"), text.alias("text"))
    return ext.externalize(p).select("scope", "sequence", "family", "repeated", "seen", "n_bytes")


_BAD = "(?i)\\b(error|failed|failure|panic|assertion|traceback|exception|fatal|denied|timeout|critical|segfault)\\b"
_LINES = "string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10))"
_DIFF = "len(list_filter(l[1:{0}], lambda x: starts_with(x, 'diff --git') OR starts_with(x, '@@ ') OR starts_with(x, '--- ') OR starts_with(x, '+++ '))) > 0"
_ERRORS = f"len(list_filter(l[1:{{0}}], lambda x: regexp_matches(x, '{_BAD}'))) >= 2"


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'git-status' WHEN doc_id % 4 = 1 THEN 'code' WHEN left(t, 1) IN ('{{', '[') AND doc_id % 4 = 3 THEN 'json' WHEN doc_id % 4 = 2 THEN CASE WHEN left(t, 1) IN ('{{', '[') THEN 'json' ELSE 'table' END WHEN {_DIFF.format(30)} THEN 'diff' WHEN len(l) > 120 OR {_ERRORS.format(300)} THEN 'log' ELSE 'text' END AS family FROM (SELECT doc_id, ltrim(text, ' ') AS t, {_LINES.format("ltrim(text, ' ')")} AS l FROM documents)")
def family_detect(spark, sf_dir):
    k = F.col("doc_id") % 4
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ext.tool_family(F.when(k == 0, "cd x && Git  status"), F.when(k == 1, "a/b.PY").when(k == 2, "c.tsv"), F.col("text")).alias("family"))


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'json' WHEN 3 THEN 'stack-trace' ELSE CASE WHEN {_DIFF.format(20)} THEN 'diff' WHEN doc_id % 4 = 0 THEN 'xml' WHEN left(t, 1) = '<' AND contains(left(t, 500), '>') THEN 'xml' WHEN {_ERRORS.format(100)} OR len(l) > 200 THEN 'log' ELSE 'text' END END AS family FROM (SELECT doc_id, ltrim(text, ' ') AS t, {_LINES.format("CASE WHEN doc_id % 4 = 0 THEN '<p>' || text ELSE text END")} AS l FROM documents)")
def content_families(spark, sf_dir):
    """Texts as they are, as markup, as JSON and behind the frames of a stack."""
    k = F.col("doc_id") % 4
    frames = F.lit('File "a.py", line 3\nFile "b.py", line 4\n')
    body = F.when(k == 0, F.concat(F.lit("<p>"), "text")).when(k == 1, F.to_json(F.struct("text"))).when(k == 3, F.concat(frames, "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", ext.content_family(body, F.lit(None).cast("string"), F.lit("")).alias("family"))


# Merkle trees: a layer of the tree is a query over the one below


def _merkle_sql(levels: int) -> str:
    parts = ["WITH l0 AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, sha256(text) AS h FROM conversations)"]
    for i in range(levels):
        parts.append(f"l{i + 1} AS (SELECT conv_id, p // 2 AS p, sha256(unhex(arg_min(h, p) || arg_max(h, p))) AS h FROM l{i} WHERE conv_id IN (SELECT conv_id FROM l{i} GROUP BY conv_id HAVING count(*) > 1) GROUP BY conv_id, p // 2)")
    every = " UNION ALL ".join(f"SELECT conv_id, {i} AS level, p, h FROM l{i}" for i in range(levels + 1))
    return ", ".join(parts) + f" SELECT conv_id, arg_max(h, level) AS root, count_if(level = 0) AS leaves FROM ({every}) GROUP BY conv_id"


@query(_merkle_sql(8))
def merkle_roots(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    return views.merkle_roots(c, "conv_id", "turn", "h").select("conv_id", "root", "leaves")


@query("SELECT conv_id, turn, turn % 5 <> 4 AS holds, CAST(CASE WHEN n = 1 THEN 0 ELSE ceil(log2(n)) END AS INT) AS steps FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) WHERE r = turn")
def merkle_proofs(spark, sf_dir):
    """Proofs of all turns against their roots, every fifth one for a forged leaf."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    p = views.merkle_proofs(c, "conv_id", "turn", "h")
    leaf = F.when(F.col("position") % 5 == 4, F.sha2("leaf", 256)).otherwise(F.col("leaf"))
    out = p.select("conv_id", F.col("position").alias("turn"), views.proof_holds(leaf, F.col("proof"), F.col("root")).alias("holds"), F.size("proof").alias("steps"))
    return out.join(c.select("conv_id", F.col("turn").alias("t")), (F.col("turn") == F.col("t")) & (out.conv_id == c.conv_id), "left_semi")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'json' END AS family, CASE WHEN doc_id % 2 = 0 THEN 'Rows: 3 | Columns: 2' || chr(10) || 'k | lang' || chr(10) || repeat('-', greatest(3, length(CAST(doc_id AS VARCHAR)))) || ' | ----' || chr(10) || doc_id || ' | ' || lang || chr(10) || doc_id || ' | x' || chr(10) || '7 | y' ELSE '{' || chr(10) || '  \"a\": [' || chr(10) || '    ' || doc_id || ',' || chr(10) || '    null' || chr(10) || '  ],' || chr(10) || '  \"lang\": \"' || lang || '\"' || chr(10) || '}' END AS view FROM documents")
def content_view(spark, sf_dir):
    """Small views of tables and of JSON; tests hold those of the other families."""
    k = F.col("doc_id")
    text = F.when(k % 2 == 0, F.concat(F.lit("k,lang\n"), k, F.lit(","), "lang", F.lit("\n"), k, F.lit(",x\n7,y\n"))).otherwise(F.concat(F.lit('{"lang": "'), "lang", F.lit('", "a": ['), k, F.lit(", null]}")))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return ext.content_views(d, "doc_id", "text", F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, "a.csv").otherwise(""))
