"""Retrieval over several graph layers: lexical seeds, spread over edges, fused by identity; blocked and tainted nodes take no part.

Nodes: layer, kind, node, item_id, uri, label, text, trust, freshness, tainted, disposition. Edges: layer, src, dst, relation, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .graph import cut

# Weights of the kinds of graphs, of trust and of freshness.
KINDS = {"task": 1.12, "code": 1.00, "semantic": 0.98, "causal": 0.96, "entity": 0.92, "provenance": 0.90, "temporal": 0.88, "security": 0.86}
TRUST = {"verified": 1.00, "trusted": 0.96, "unknown": 0.78, "untrusted": 0.42, "denied": 0.0}
FRESHNESS = {"current": 1.0, "fresh": 1.0, "aging": 0.82, "stale": 0.55, "expired": 0.0}
# Points for all words and for the phrase, for a task; what a reverse edge and each hop keep; bonus of a further kind of graph.
WORDS, PHRASE, TASK, BACKWARD, DECAY, FURTHER = 10.0, 5.0, 2.0, 0.72, 0.42, 1.25
DENIED = ["deny", "block", "quarantine"]


def _weight(column: str, weights: dict[str, float], other: float) -> Column:
    out = None
    for name, w in weights.items():
        hit = F.lower(F.col(column)) == name
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return out.otherwise(other)


def identity() -> Column:
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return F.when(some("item_id"), F.concat(F.lit("item:"), "item_id")).when(some("uri"), F.concat(F.lit("uri:"), "uri")).otherwise(F.concat(F.lit("node:"), "kind", F.lit(":"), "node"))


def unblocked(nodes: DataFrame, tainted: bool = False) -> DataFrame:
    """Nodes without those that a security layer denies or, unless `tainted`, that are tainted, nor any with their identity, item or address."""
    named = nodes.withColumn("identity", identity())
    denied = (F.col("kind") == "security") & F.lower(F.coalesce("disposition", F.lit(""))).isin(DENIED)
    bad = named.where(denied if tainted else denied | F.coalesce("tainted", F.lit(False)))
    out = named
    for c in ("identity", "item_id", "uri"):
        out = out.join(bad.where(f"{c} <> ''").select(c).distinct(), c, "left_anti")
    return out.select(*named.columns)


def lexical(nodes: DataFrame, task: str, words: list[str]) -> Column:
    own = F.array_distinct(tx.tokens(F.col("text"), "graph", 1))
    shared = tx.overlap(own, words)
    score = shared / max(1, len(set(words))) * WORDS + F.when(F.contains(F.lower("text"), F.lit(task.lower().strip())), PHRASE).otherwise(0.0) + F.when((F.col("kind") == "task") & (shared > 0), TASK).otherwise(0.0)
    return score * _weight("kind", KINDS, 1.0) * _weight("trust", TRUST, 0.0) * _weight("freshness", FRESHNESS, 0.9)


def retrieve(nodes: DataFrame, edges: DataFrame, task: str, limit: int = 20, hops: int = 2, tainted: bool = False, required: tuple[str, ...] = ()) -> DataFrame:
    """The best identities for a task: identity, score, labels, kinds, layers.

    Nodes score by shared words; the best of them are seeds, which spread along edges and, weaker, against them, a hop a level. A node goes on once, from the
    way that comes first: fewest hops, then the order of its seed and of the nodes on the way. What nodes of one identity have in all layers is added up, with
    a bonus for each further kind. Only the frontier meets the edges, which are written once, and a level is an aggregate.
    """
    import re

    task = task.strip()
    if not task:
        raise ValueError("a task is a text")
    if missing := set(required) - {r[0] for r in nodes.select("kind").distinct().collect()} if required else ():
        raise ValueError(f"no layer of {sorted(missing)}")
    limit, hops = max(1, min(limit, 100)), max(0, min(hops, 4))
    words = list(dict.fromkeys(re.findall(tx.TOKEN_PATTERNS["graph"], task.lower())))
    live = unblocked(nodes, tainted)
    live = cut(live.withColumn("key", F.concat("layer", F.lit(":"), "node")).withColumn("score", lexical(live, task, words)))
    keyed = edges.select(F.concat("layer", F.lit(":"), "src").alias("a"), F.concat("layer", F.lit(":"), "dst").alias("b"), "relation", F.col("confidence").cast("double").alias("f"))
    for end in ("a", "b"):
        keyed = keyed.join(live.select(F.col("key").alias(end)), end, "left_semi")
    both = keyed.select("a", "b", "relation", "f").unionAll(keyed.select(F.col("b").alias("a"), F.col("a").alias("b"), F.concat(F.lit("reverse:"), "relation").alias("relation"), F.col("f") * BACKWARD))
    step = cut(both.groupBy("a", "b").agg(F.min_by("f", "relation").alias("f")))
    seeds = live.where("score > 0").orderBy(F.desc("score"), "key").limit(max(4 * limit, 16))
    place = F.format_string("%06d", F.row_number().over(Window.orderBy(F.desc("score"), "key")))
    frontier = cut(seeds.select("key", "score", F.array(place).alias("way")))
    given, done = live.select("key", "score"), frontier.select("key")
    for depth in range(1, hops + 1):
        moved = cut(frontier.join(step, F.col("key") == F.col("a")).select(F.col("b").alias("key"), (F.col("score") * F.col("f") * DECAY**depth).alias("score"), F.concat("way", F.array("b")).alias("way")).where("score > 0"))
        given = given.unionByName(moved.select("key", "score"))
        if depth < hops:
            frontier = cut(moved.groupBy("key").agg(F.min_by("score", "way").alias("score"), F.min("way").alias("way")).join(done, "key", "left_anti"))
            done = done.unionByName(frontier.select("key"))
    total = given.groupBy("key").agg(F.sum("score").alias("score")).where("score > 0")
    fused = live.drop("score").join(total, "key").groupBy("identity").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("layer")).alias("layers"))
    scored = fused.withColumn("score", F.round(F.col("score") + F.greatest(F.size("kinds") - 1, F.lit(0)) * FURTHER, 6))
    return scored.orderBy(F.desc("score"), "identity").limit(limit)


def structural_layer(symbols: DataFrame, edges: DataFrame, layer: str, repository: str, kind: str = "code") -> tuple[DataFrame, DataFrame]:
    """A code index as nodes and edges of a layer. Symbols: path, name, qualified_name, kind, line, confidence; edges: source_path, source_symbol, target_path,
    target, edge_type, confidence. Ends are resolved by path and the qualified or plain name, else by its last part; those that aren't found or are one drop out."""
    if kind not in ("code", "semantic"):
        raise ValueError("an index fills code and semantic layers")
    s = symbols.withColumn("q", F.coalesce(F.when(F.col("qualified_name") != "", F.col("qualified_name")), F.col("name"))).where("path <> '' and q <> ''")
    s = s.withColumn("node", F.concat_ws(":", "path", "q", F.coalesce("line", F.lit(1)).cast("string")))
    trust = F.when(F.col("confidence") >= 0.9, "verified").when(F.col("confidence") >= 0.7, "trusted").otherwise("unknown")
    uri = F.concat(F.lit(f"repository://{repository}/"), "path", F.lit("#"), "q")
    nodes = s.select(F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), "node", F.lit("").alias("item_id"), uri.alias("uri"), F.col("q").alias("label"), F.lower(F.concat_ws(" ", "q", "kind", uri, "path")).alias("text"), trust.alias("trust"), F.lit("current").alias("freshness"), F.lit(False).alias("tainted"), F.lit("").alias("disposition"))
    order = F.struct(F.coalesce("line", F.lit(1)), "node")
    last = lambda name: F.regexp_extract(F.regexp_replace(name, "::", "."), r"([^.]*)$", 1)
    by = s.select("path", F.explode(F.array_distinct(F.array("q", "name"))).alias("n"), "node", order.alias("o")).groupBy("path", "n").agg(F.max_by("node", "o").alias("node"))
    short = s.select("path", last(F.col("q")).alias("n"), "node", order.alias("o")).groupBy("path", "n").agg(F.max_by("node", "o").alias("node"))

    def found(df: DataFrame, path: str, name: str, out: str) -> DataFrame:
        full = by.select(F.col("path").alias(path), F.col("n").alias(name), F.col("node").alias("_f"))
        part = short.select(F.col("path").alias(path), F.col("n").alias("_n"), F.col("node").alias("_s"))
        df = df.join(full, [path, name], "left").withColumn("_n", last(F.col(name))).join(part, [path, "_n"], "left")
        return df.withColumn(out, F.coalesce("_f", "_s")).drop("_f", "_s", "_n")

    e = found(found(edges, "source_path", "source_symbol", "src"), "target_path", "target", "dst").where("src is not null and dst is not null and src <> dst")
    bounded = F.greatest(F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return nodes, e.select(F.lit(layer).alias("layer"), "src", "dst", F.coalesce("edge_type", F.lit("related")).alias("relation"), bounded.alias("confidence"))
