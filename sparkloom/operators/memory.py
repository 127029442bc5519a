"""Memories and sessions: ranked search, scoped retrieval, session events and summaries, and what transcripts state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import rank

# Weights of a memory's score, days in which recency falls to 1/e, relation weight that counts in full.
WEIGHTS = {"lexical": 0.55, "confidence": 0.25, "recency": 0.12, "relations": 0.08}
RECENCY_DAYS, RELATIONS_FULL = 90.0, 5.0
# Weights of a scoped record's score beside its search score, and days in which its recency runs out.
SCOPED = {"importance": 5.0, "confidence": 3.0, "validity": 2.0, "recency": 4.0}
SCOPED_DAYS = 30.0
# Words that a scoped query is widened by.
EXPANSIONS = {
    "decision": ["chosen", "decided", "constraint"],
    "failure": ["error", "root-cause", "regression"],
    "procedure": ["steps", "workflow", "runbook"],
    "project": ["repository", "codebase", "workspace"],
    "user": ["preference", "constraint"],
    "time": ["temporal", "recent", "timeline"],
}
# Lines that state something, by kind, with how important it is; and the confidence of what is found so.
STATEMENTS = {
    "decision": (r"(?im)^\s*(?:decision|decided|we will|keep|use)\s*[:\-]?\s*(.+)$", 0.8),
    "failure": (r"(?im)^\s*(?:root cause|failure|error cause)\s*[:\-]?\s*(.+)$", 0.75),
    "constraint": (r"(?im)^\s*(?:constraint|must|never)\s*[:\-]?\s*(.+)$", 0.85),
    "preference": (r"(?im)^\s*(?:preference|prefer)\s*[:\-]?\s*(.+)$", 0.65),
}
STATED = 0.65
# Points of session events and summaries.
EVENT_POINTS, RECENCY_POINTS, SUMMARY_POINTS, SUMMARY_BASE = 65.0, 15.0, 70.0, 8.0


def alive(now: float, classes: tuple[str, ...] = (), superseded: bool = False, expired: bool = False) -> Column:
    """Memories that a search sees."""
    out = F.lit(True)
    if not superseded:
        out = out & F.col("superseded_by").isNull()
    if not expired:
        out = out & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return out & F.col("memory_class").isin(*classes) if classes else out


def search(memories: DataFrame, relations: DataFrame, query: str, now: float, limit: int = 10, tokens: Column | None = None, **seen) -> DataFrame:
    """The best memories (memory_id, text, memory_class, confidence, created_at in seconds, superseded_by, expires_at) for a query, with mode and score.

    Full-text rank over all memories, of which the best 4 x limit that are alive compete; a query that no token of any memory matches is sought as it is written
    (mode substring). Relations (target_id, weight) add to a memory. Corpus counts are one row; the competitors are a top-k, and only they meet the relations.
    """
    words = list(dict.fromkeys(t.lower() for t in query.replace('"', "").split()))[:32]
    own = tx.tokens(F.col("text"), "memory", 1) if tokens is None else tokens
    ranks = rank.bm25(memories, "memory_id", own, words, saturate=False, floor=True) if words else memories.select("memory_id", F.lit(0.0).alias("score"))
    hits = memories.where(alive(now, **seen)).join(ranks.where("score > 0").withColumnRenamed("score", "lexical_rank"), "memory_id")
    best = hits.orderBy(F.desc("lexical_rank"), "memory_id").limit(4 * limit).withColumn("mode", F.lit("full-text"))
    if not best.take(1):
        found = memories.where(alive(now, **seen) & F.lower("text").contains(query.lower())).withColumn("lexical_rank", F.lit(0.0))
        best = found.orderBy(F.desc("created_at"), "memory_id").limit(4 * limit).withColumn("mode", F.lit("substring"))
    weights = relations.groupBy(F.col("target_id").alias("memory_id")).agg(F.sum("weight").alias("_w"))
    both = best.join(weights, "memory_id", "left")
    age = F.greatest(F.lit(now) - F.col("created_at"), F.lit(0.0)) / 86400.0
    parts = {"lexical": 1 / (1 + F.col("lexical_rank")), "confidence": F.col("confidence"), "recency": F.exp(-age / RECENCY_DAYS), "relations": F.least(F.lit(1.0), F.coalesce("_w", F.lit(0.0)) / RELATIONS_FULL)}
    score = sum((w * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return both.withColumn("score", score).drop("_w").orderBy(F.desc("score"), F.desc("created_at"), "memory_id").limit(limit)


def in_scope(project: str, user: str = "", session: str = "") -> Column:
    """Whether a record's scope (project_id, user_id, session_id; empty or null: of all) is seen by a request: one without a user or session sees only records
    without."""
    level = lambda c, asked: F.coalesce(F.col(c), F.lit("")).isin("", asked)
    return (F.col("project_id") == project) & level("user_id", user) & level("session_id", session)


def expanded(query: str) -> list[str]:
    """The query's words, then those it is widened by, sorted."""
    words = query.lower().split()
    return words + sorted({x for w in words for x in EXPANSIONS.get(w, ())})


def observed(observations: DataFrame, tokens: Column, words: list[str], cosine: Column, limit: int) -> DataFrame:
    """The best valid observations (observation_id, importance, confidence, validity, roi) with bm25, cosine and score; a top-k."""
    ranks = rank.bm25(observations, "observation_id", tokens, words, saturate=False).withColumnRenamed("score", "bm25")
    scored = observations.withColumn("cosine", cosine).where("validity > 0").join(ranks, "observation_id")
    scored = scored.withColumn("base", F.col("bm25") * 4 + F.col("cosine") * 25 + F.col("roi") * 5).where("base > 0")
    return scored.orderBy(F.desc("base"), "observation_id").limit(limit)


def scoped(base: DataFrame, records: DataFrame, scope: Column, limit: int = 12) -> DataFrame:
    """Active records (memory_id, observation_id, state, project_id, user_id, session_id, updated_at) in scope of the observations found, best first. The
    observations are a top-k, so that records are filtered by them where they are read."""
    limit = max(1, min(100, limit))
    found = records.where(F.col("state") == "active").where(scope).join(F.broadcast(base), "observation_id")
    latest = found.agg(F.max("updated_at").alias("_latest"))
    age = (F.col("_latest") - F.col("updated_at")) / 86400.0
    recency = F.when(F.col("_latest") > 0, F.greatest(1 - age / SCOPED_DAYS, F.lit(0.0))).otherwise(0.0)
    ranked = found.crossJoin(F.broadcast(latest)).withColumn("recency", recency)
    score = F.col("base") + sum((w * F.col(c) for c, w in SCOPED.items()), F.lit(0.0))
    return ranked.withColumn("score", score).drop("_latest").orderBy(F.desc("score"), "memory_id").limit(limit)


def payload_weight(importance: Column, pinned: Column, stale: Column) -> Column:
    """What an event's payload adds to its score, within -40 and 30."""
    flag = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0.0)
    return F.greatest(F.lit(-40.0), F.least(F.lit(30.0), F.coalesce(importance, F.lit(0.0)) * 10.0 + flag(pinned, 15.0) - flag(stale, 35.0)))


def session_hits(events: DataFrame, summaries: DataFrame, query: list[str], limit: int = 12, weight: Column | None = None) -> DataFrame:
    """The best events (session, sequence, text) and summaries (session, summary_id, text) of each session that share a word with the query: session, kind,
    reference, score, place. A share of the query's words, where the event stands among its session's, and `weight`."""
    n = max(1, len(set(query)))
    share = lambda df: tx.overlap(F.array_distinct(tx.tokens(F.col("text"), "session")), query) / n if query else F.lit(0.0)
    total = events.groupBy("session").agg(F.count("*").alias("_n"))
    e = events.withColumn("_share", share(events)).withColumn("_weight", F.lit(0.0) if weight is None else weight)
    if query:
        e = e.where("_share > 0")
    e = e.join(total, "session").select("session", F.lit("event").alias("kind"), F.col("sequence").cast("string").alias("reference"), (F.col("_share") * EVENT_POINTS + F.col("sequence") / F.col("_n") * RECENCY_POINTS + F.col("_weight")).alias("score"))
    s = summaries.withColumn("_share", share(summaries))
    if query:
        s = s.where("_share > 0")
    s = s.select("session", F.lit("summary").alias("kind"), F.col("summary_id").cast("string").alias("reference"), (F.col("_share") * SUMMARY_POINTS + SUMMARY_BASE).alias("score"))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "reference", "kind"))
    return e.unionByName(s).withColumn("place", place).where(F.col("place") <= max(1, limit))


def recall(captures: DataFrame, fields: list[str], query: str, limit: int = 8) -> DataFrame:
    """The best captures (sequence and text fields) for a query: 3 a shared word, 4 for the phrase; newer ones first among equals."""
    hay = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    words = [w for w in query.lower().split() if len(w) > 1]
    score = tx.overlap(F.array_distinct(tx.tokens(hay, "segment")), words) * 3 + F.when(F.contains(F.lower(hay), F.lit(query.lower())), 4).otherwise(0)
    return captures.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("sequence")).limit(max(1, limit))


def statements(transcripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, text, importance, confidence): decisions, failures, constraints and preferences that lines of a transcript state."""
    found = [
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _stated(kind, importance))
        for kind, (pattern, importance) in STATEMENTS.items()
    ]
    rows = transcripts.select(key, F.explode(F.concat(*found)).alias("_s")).select(key, "_s.*")
    return rows.where("text <> ''").withColumn("confidence", F.lit(STATED))


def _stated(kind: str, importance: float):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("text"), F.lit(importance).alias("importance"))
