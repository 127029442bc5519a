"""Plans under a budget: long sessions, packs of search hits, tools in two stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import security
from .context import inline_filters
from .windows import pack_skipping

# Types of events that a plan keeps while they are current.
CRITICAL = ["decision", "error", "failure", "security", "verification", "claim", "checkpoint", "session-fork", "session-merge", "task-result"]
PREVIEW_MARK = "\n[… exact section available by reference …]"
SEPARATOR = "\n---\n"


@dataclass(frozen=True)
class Policy:
    """Bounds of a plan; the candidates of a session are its last events."""

    budget: int = 32_000
    recent: int = 24
    chars_per_token: float = 4.0
    event_chars: int = 2_000
    summary_chars: int = 12_000
    candidates: int = 512
    forced: tuple[str, ...] = ()


def temporal_status(events: DataFrame) -> DataFrame:
    """Events (session, sequence, subject, identifiers, supersedes, revoked) with status: superseded where a later event has the subject or any event
    names one of the identifiers as superseded; revoked; else current. Subjects and names are aggregates; nothing is gathered by session."""
    newest = events.where("subject is not null and subject <> ''").groupBy("session", "subject").agg(F.max("sequence").alias("_newest"))
    named = events.select("session", F.explode("supersedes").alias("_id")).distinct()
    old = events.select("session", "sequence", F.explode("identifiers").alias("_id")).join(named, ["session", "_id"], "left_semi").select("session", "sequence").distinct().withColumn("_old", F.lit(True))
    out = events.join(newest, ["session", "subject"], "left").join(old, ["session", "sequence"], "left")
    behind = F.coalesce(F.col("_newest") != F.col("sequence"), F.lit(False)) | F.coalesce("_old", F.lit(False))
    return out.withColumn("status", F.when(behind, "superseded").when(F.coalesce("revoked", F.lit(False)), "revoked").otherwise("current")).drop("_newest", "_old")


def preview(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(max(0, limit - len(PREVIEW_MARK))))), F.lit(PREVIEW_MARK)))


def session_plan(events: DataFrame, query: list[str], policy: Policy = Policy(), summaries: DataFrame | None = None) -> DataFrame:
    """What of each session goes into its context: session, role, sequence, score, mandatory, status, tokens.

    Events (session, sequence, event_type, text, subject, identifiers, supersedes, revoked) score by shared words, place, status and type; the last ones, forced
    types and current critical ones come first; then the best of the rest, those that don't fit skipped. Summaries (session, summary_id, text) may join. Each
    session folds its bounded candidates.
    """
    told = temporal_status(events)
    last = events.groupBy("session").agg(F.max("sequence").alias("_last"))
    w = Window.partitionBy("session").orderBy(F.desc("sequence"))
    near = told.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(policy.candidates, policy.recent)).join(last, "session")
    own = F.array_distinct(tx.tokens(F.concat_ws(" ", "event_type", "text"), "plan"))
    shared = tx.overlap(own, query)
    union = F.greatest(F.size(F.array_union(own, F.array(*map(F.lit, query)) if query else F.array().cast("array<string>"))), F.lit(1))
    critical, current = F.lower("event_type").isin(CRITICAL), F.col("status") == "current"
    near = near.withColumn("_shared", shared).withColumn("mandatory", F.lower("event_type").isin(*[t.lower() for t in policy.forced] or [""]) | (F.col("sequence") > F.col("_last") - policy.recent) | (critical & current))
    score = F.col("_shared") / union * 10.0 + F.col("sequence") / F.greatest(F.col("_last"), F.lit(1)) * 2.0 + F.when(current, 2.0).otherwise(-2.5) + F.when(critical, 2.0).otherwise(0.0)
    body = preview(F.col("text"), policy.event_chars)
    rows = near.withColumn("score", score).where(current | F.col("mandatory") | (F.col("_shared") > 0)).select("session", F.lit("event").alias("role"), F.col("sequence").cast("bigint").alias("sequence"), F.lit(None).cast("string").alias("summary_id"), "score", "mandatory", "status", body.alias("text"))
    if summaries is not None:
        long = last.where(F.col("_last") > policy.recent).select("session")
        more = summaries.join(long, "session", "left_semi").select("session", F.lit("summary").alias("role"), F.lit(0).cast("bigint").alias("sequence"), F.col("summary_id").cast("string").alias("summary_id"), F.lit(1.5).alias("score"), F.lit(False).alias("mandatory"), F.lit("aggregate").alias("status"), preview(F.col("text"), policy.summary_chars).alias("text"))
        rows = rows.unionByName(more)
    rows = rows.withColumn("tokens", F.greatest(F.ceil(F.octet_length(F.to_json(F.struct(*rows.columns))) / policy.chars_per_token), F.lit(1)).cast("bigint"))
    rows = rows.withColumn("_item", F.concat_ws(":", "role", "sequence", F.coalesce("summary_id", F.lit(""))))
    ordered = rows.withColumn("_o1", F.when(F.col("mandatory"), 0).otherwise(1)).withColumn("_o2", -F.col("score")).withColumn("_o3", F.when(F.col("mandatory") & (F.col("status") == "current"), 0).otherwise(1)).withColumn("_o4", -F.col("sequence")).withColumn("_cost", F.col("tokens") + 1)
    packed = pack_skipping(ordered, ["session"], ["_o1", "_o2", "_o3", "_o4"], "_cost", policy.budget - 2, "_item").select("session", F.explode("items").alias("_item"))
    return rows.join(packed, ["session", "_item"], "left_semi").drop("_item", "text")


def segment_hits(segments: DataFrame, query: str, limit: int = 8, window: int = 3) -> DataFrame:
    """The best segments (artifact, segment, kind, salience, critical, body, path, start_line) for a query with filters in line (kind:, path:, error:): score,
    reasons, and the lines around the best one. 3 a shared word, the salience, 6 for the phrase, 3 if critical, 2 for the path. A top-k; lines are cut for it alone.
    """
    plain, filters = inline_filters(query)
    words = [w for w in dict.fromkeys(tok.lower() for tok in _words(plain)) if len(w) > 1]
    if not words and not filters:
        return segments.limit(0).withColumn("score", F.lit(0.0)).withColumn("reasons", F.array().cast("array<string>")).withColumn("text", F.lit(""))
    rows, low = segments, F.lower("body")
    if "kind" in filters:
        rows = rows.where(F.col("kind") == filters["kind"])
    if "path" in filters:
        rows = rows.where(F.contains(F.lower("path"), F.lit(filters["path"].lower())))
    if "error" in filters:
        rows = rows.where(F.contains(low, F.lit(filters["error"].lower())))
    shared = tx.overlap(F.array_distinct(tx.tokens(F.col("body"), "segment")), words) if words else F.lit(0)
    phrase = F.contains(low, F.lit(plain.lower())) if plain else F.lit(False)
    rows = rows.withColumn("_shared", shared).withColumn("_phrase", phrase)
    if words:
        rows = rows.where("_shared > 0")
    score = F.col("_shared") * 3.0 + F.col("salience") + F.when(F.col("_phrase"), 6.0).otherwise(0.0) + F.when(F.col("critical"), 3.0).otherwise(0.0) + (2.0 if "path" in filters else 0.0)
    names = [F.when(F.col("_shared") > 0, "token-overlap"), F.when(F.col("_phrase"), "exact-phrase"), F.when(F.col("critical"), "critical"), F.lit("path-filter" if "path" in filters else None)]
    best = rows.withColumn("score", score).orderBy(F.desc("score"), "artifact", "segment").limit(max(1, limit))
    line_score = lambda x: (tx.overlap(F.array_distinct(tx.tokens(x, "segment")), words) if words else F.lit(0)) + (F.when(F.contains(F.lower(x), F.lit(plain.lower())), 2).otherwise(0) if plain else F.lit(0))
    best = best.withColumn("_l", tx.lines(F.col("body"))).withColumn("_s", F.transform("_l", line_score))
    best = best.withColumn("_at", F.array_position("_s", F.array_max("_s")).cast("int")).withColumn("_from", F.greatest(F.col("_at") - window, F.lit(1)))
    text = F.array_join(F.slice("_l", F.col("_from"), F.col("_at") + window - F.col("_from") + 1), "\n")
    out = best.withColumn("text", text).withColumn("first_line", F.col("start_line") + F.col("_from") - 1).withColumn("last_line", F.col("start_line") + F.least(F.col("_at") + window, F.size("_l")) - 1)
    return out.withColumn("reasons", F.filter(F.array(*names), lambda x: x.isNotNull())).drop("_shared", "_phrase", "_l", "_s", "_at", "_from")


def _words(text: str) -> list[str]:
    import re

    return re.findall(tx.TOKEN_PATTERNS["segment"], text)


def search_pack(hits: DataFrame, budget: int = 4096) -> DataFrame:
    """One row of segment_hits(): content, n_hits, complete. Hits whose shapes repeat are left out; sections are redacted and taken in order up to the first
    that doesn't fit. Hits are a top-k, so that one task folds them."""
    if budget < 256:
        raise ValueError("a pack takes 256 bytes at least")
    order = [F.desc("score"), F.col("artifact"), F.col("segment")]
    first = F.row_number().over(Window.partitionBy(F.sha2(tx.log_shape(F.col("text")), 256)).orderBy(*order))
    section = F.concat(F.format_string("[artifact=%s segment=%s lines=%d-%d kind=%s score=%.2f]\n", F.col("artifact").cast("string"), F.col("segment").cast("string"), "first_line", "last_line", "kind", "score"), security.redacted(F.col("text")))
    rows = hits.withColumn("_first", first).where("_first = 1").withColumn("_section", section)
    by = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_end", F.sum(F.octet_length("_section") + len(SEPARATOR)).over(by) - len(SEPARATOR))
    fits = F.col("_end") <= budget
    got = rows.agg(F.array_sort(F.collect_list(F.when(fits, F.struct("_n", "_section")))).alias("a"), F.count("*").alias("all"), F.count_if(fits).alias("n_hits"))
    return got.select(F.array_join(F.transform("a", lambda x: x["_section"]), SEPARATOR).alias("content"), "n_hits", (F.col("all") == F.col("n_hits")).alias("complete"))


def _tool_score(words: list[str]) -> Column:
    share = lambda c, points: points * tx.overlap(F.array_distinct(tx.tokens(F.coalesce(F.col(c), F.lit("")), "tool", 1)), words)
    return share("family", 5) + share("name", 3) + share("description", 1) if words else F.lit(0)


def tool_families(tools: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Stage one of a selection over tools (name, family, description): family, score, tool_count, tools, status. Equal best families make it ambiguous, and
    only they are given."""
    import re

    words = list(dict.fromkeys(re.findall(tx.TOKEN_PATTERNS["tool"], query.lower())))
    scored = tools.withColumn("_s", _tool_score(words)).where("_s > 0")
    families = scored.groupBy("family").agg(F.max("_s").alias("score"), F.count("*").alias("tool_count"), F.array_sort(F.collect_list("name")).alias("tools"))
    top = families.groupBy("score").agg(F.count("*").alias("_ties")).orderBy(F.desc("score")).limit(1).withColumnRenamed("score", "_top")
    both = families.crossJoin(F.broadcast(top)).where("_ties = 1 or score = _top")
    out = both.withColumn("status", F.when(F.col("_ties") > 1, "ambiguous").otherwise("ok")).drop("_top", "_ties")
    return out.orderBy(F.desc("score"), "family").limit(max(1, limit))


def tool_selection(tools: DataFrame, selector: str, query: str, budget: int, most: int = 16) -> DataFrame:
    """Stage two: the tools (name, family, description, tokens) that a selector names - a tool, else a family, else a namespace - best first, up to the first
    that doesn't fit the budget: name, score, tokens, used."""
    import re

    name = selector.strip()
    if not name:
        raise ValueError("a selector names a tool, a family or a namespace")
    words = list(dict.fromkeys(re.findall(tx.TOKEN_PATTERNS["tool"], query.lower())))
    level = F.when(F.col("name") == name, 0).when(F.col("family") == name, 1).when(F.col("name").startswith(name.rstrip(".") + "."), 2)
    named = tools.withColumn("_level", level).where("_level is not null")
    least = named.agg(F.min("_level").alias("_least"))
    best = named.crossJoin(F.broadcast(least)).where("_level = _least").withColumn("score", _tool_score(words)).orderBy(F.desc("score"), "name").limit(most)
    used = F.sum("tokens").over(Window.orderBy(F.desc("score"), "name").rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("used", used).where(F.col("used") <= budget).select("name", "score", "tokens", "used")
