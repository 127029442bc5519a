"""Work of agents: states of jobs, routes of tasks, packs of code and chains of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, lifecycle, routing, taskpack
from ..sources.tables import table
from .q_graph import _EDGES, _edges, _seed
from .registry import query

_ALLOWED = ",".join(f"{s}>{t}" for s, to in lifecycle.ALLOWED.items() for t in to)
_ASKED = "CASE WHEN kind = 'view' THEN CASE WHEN value < 50 THEN 'claimed' ELSE 'running' END WHEN kind = 'click' THEN CASE WHEN value < 50 THEN 'queued' ELSE 'verifying' END WHEN kind = 'error' THEN 'failed' WHEN kind = 'purchase' THEN CASE WHEN value < 95 THEN 'cancelled' ELSE 'completed' END WHEN kind = 'signup' THEN 'blocked' END"


@query(f"""WITH a AS (SELECT client_id, click_id, {_ASKED} AS state, CAST(click_id % 7 AS VARCHAR) AS who FROM clicks WHERE client_id IS NOT NULL),
l AS (SELECT client_id, count(*) AS n_asked, list({{'s': state, 'who': who, 'runs': 0::BIGINT, 'n': 0::BIGINT, 'total': click_id::BIGINT}} ORDER BY click_id NULLS FIRST, state NULLS FIRST) AS rows FROM a GROUP BY client_id),
f AS (SELECT client_id, n_asked, list_reduce(rows, lambda a, x: CASE WHEN coalesce(contains(',{_ALLOWED},', ',' || a.s || '>' || x.s || ','), false)
THEN {{'s': x.s, 'who': coalesce(x.who, a.who), 'runs': a.runs + CASE WHEN x.s = 'running' THEN 1 ELSE 0 END, 'n': a.n + 1, 'total': a.total + coalesce(x.total, 0)}} ELSE a END,
{{'s': 'queued', 'who': '', 'runs': 0::BIGINT, 'n': 0::BIGINT, 'total': 0::BIGINT}}) AS r FROM l)
SELECT client_id, r.s AS state, r.runs AS attempts, r.who AS claimed_by, n_asked, r.n AS n_accepted, r.total AS accepted_ids FROM f""")
def job_transitions(spark, sf_dir):
    """A job for each client, whose clicks ask for transitions."""
    c = table(spark, sf_dir, "clicks").where("client_id IS NOT NULL")
    asked = c.select(F.col("client_id").alias("job_id"), F.col("click_id").alias("seq"), F.expr(_ASKED).alias("state"), (F.col("click_id") % 7).cast("string").alias("claimed_by"))
    jobs = asked.select("job_id").distinct().select("job_id", F.lit("queued").alias("state"), F.lit(0).cast("bigint").alias("attempts"), F.lit("").alias("claimed_by"))
    log = lifecycle.cut(lifecycle.transitions(jobs, asked))
    counts = log.groupBy("job_id").agg(F.count("*").alias("n_asked"), F.count_if("accepted").alias("n_accepted"), F.coalesce(F.sum(F.when(F.col("accepted"), F.col("seq"))), F.lit(0)).alias("accepted_ids"))
    return lifecycle.advanced(jobs, log).join(counts, "job_id").withColumnRenamed("job_id", "client_id")


def _said(terms: list[str]) -> str:
    return "CASE WHEN " + " OR ".join(f"contains(t, '{x}')" for x in terms) + " THEN 1 ELSE 0 END"


@query(f"SELECT doc_id, CASE WHEN points >= 4 THEN 'reasoning' WHEN points >= 2 THEN 'complex' WHEN points = 1 THEN 'medium' ELSE 'simple' END AS complexity FROM (SELECT doc_id, 2 * ({_said(routing.HARD)}) + {_said(routing.SOME)} + CASE WHEN lines >= 8 THEN 1 ELSE 0 END + CASE WHEN n_chars * 10 >= 16000 THEN 1 ELSE 0 END AS points FROM (SELECT doc_id, n_chars, lower(text) AS t, len(string_split(text, '.')) AS lines FROM documents))")
def task_complexity(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", routing.complexity(F.col("text"), F.size(F.split("text", r"\.")), F.col("n_chars") * 10).alias("complexity"))


_OFFERS = "SELECT n_name AS provider, r_name AS model, CAST(n_nationkey * 15000 + 20000 AS BIGINT) AS max_context, CAST(sum(CAST(s_suppkey AS BIGINT)) % 997 AS BIGINT) AS cost_micros, CAST(count(*) % 5 AS BIGINT) AS latency_ms, n_nationkey % 2 = 0 AS supports_tools FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name, n_nationkey"


@query(f"WITH c AS ({_OFFERS}), t AS (SELECT o_orderkey, floor(o_totalprice) AS need, o_orderkey % 1000 AS most, o_orderstatus = 'P' AS tools FROM orders), m AS (SELECT o_orderkey, count(*) AS eligible_count, min({{'a': cost_micros, 'b': latency_ms, 'c': provider, 'd': model}}) AS route FROM t JOIN c ON max_context >= need AND cost_micros <= most AND (supports_tools OR NOT tools) GROUP BY o_orderkey) SELECT o_orderkey, coalesce(eligible_count, 0) AS eligible_count, coalesce(route.c, '') AS provider, coalesce(route.d, '') AS model, coalesce(route.a, -1) AS cost_micros FROM t LEFT JOIN m USING (o_orderkey)")
def provider_routes(spark, sf_dir):
    """Orders as tasks; nations, with what their suppliers make of them, as candidates."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    offers = rows.groupBy(F.col("n_name").alias("provider"), F.col("r_name").alias("model"), "n_nationkey").agg((F.sum(F.col("s_suppkey").cast("bigint")) % 997).alias("cost_micros"), (F.count("*") % 5).alias("latency_ms"))
    offers = offers.withColumn("max_context", F.col("n_nationkey").cast("bigint") * 15000 + 20000).withColumn("supports_tools", F.col("n_nationkey") % 2 == 0)
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("required_context"), (F.col("o_orderkey") % 1000).alias("max_cost_micros"), (F.col("o_orderstatus") == "P").alias("require_tools"))
    return routing.cheapest(tasks, offers).select("o_orderkey", F.col("eligible_count").cast("bigint"), F.coalesce("route.provider", F.lit("")).alias("provider"), F.coalesce("route.model", F.lit("")).alias("model"), F.coalesce("route.cost_micros", F.lit(-1)).alias("cost_micros"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(3 AS BIGINT) AS entry, CAST(3 AS BIGINT) AS node, 0 AS depth, [CAST(3 AS BIGINT)] AS chain UNION ALL SELECT 7, 7, 0, [7] UNION ALL SELECT entry, e.dst, depth + 1, list_append(chain, e.dst) FROM r JOIN e ON e.src = r.node WHERE depth < 3), b AS (SELECT entry, node, min({{'d': depth, 'c': chain}}) AS x FROM r GROUP BY entry, node) SELECT entry, node, x.d AS depth, array_to_string(x.c, '>') AS chain FROM b WHERE x.d > 0")
def call_chains(spark, sf_dir):
    found = graph.chains(_edges(spark, sf_dir), _seed(spark, 3, 7), 3)
    return found.select("entry", "node", "depth", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


@query()
def task_pack(spark, sf_dir):
    """A pack for each source: first lines of its long documents are definitions, those behind them other symbols, and English documents those that are affected."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("path"), "lang", "n_chars", "text")
    lines = d.select("path", F.posexplode(tx.lines(F.col("text"))).alias("_at", "text")).select("path", (F.col("_at") + 1).alias("line"), "text")
    definitions = d.where("n_chars >= 1500").select("source", "path", F.lit(1).alias("line"), F.lit(None).cast("int").alias("end_line"))
    symbols = d.select("source", "path", F.lit(2).alias("line"), F.lit(2).alias("end_line"))
    ranges = taskpack.candidates(definitions, symbols, d.where("lang = 'en'"), "source")
    items = taskpack.excerpts(ranges, lines, "source")
    out = taskpack.packed(items, "source", 1000)
    return out.select("source", F.col("path").alias("doc_id"), "start", "end", "tier", "tokens", "clipped", F.sha2("text", 256).alias("text_sha256"))
