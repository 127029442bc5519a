"""Symbols and edges of source code: seeds, resolution, contracts, smells, summaries as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph

# Words that say nothing about a task.
STOP = ["the", "and", "for", "with", "from", "into", "that", "this", "fix", "add", "remove", "update", "change", "make", "use", "using", "system", "feature", "code", "file", "test", "tests"]
# Smells by name and severity.
SMELLS = {
    "hardcoded-secret": ("critical", r"""(?i)(?:api[_-]?key|password|secret)\s*[:=]\s*["'][^"']{8,}"""),
    "shell-true": ("high", r"subprocess\.(?:run|Popen).*shell\s*=\s*True|exec\s*\(|eval\s*\("),
    "empty-catch": ("medium", r"except\s*(?:Exception)?\s*:\s*(?:pass|continue)\b|catch\s*\([^)]*\)\s*\{\s*\}"),
    "todo-security": ("medium", r"(?i)TODO.*(?:auth|security|secret|permission)"),
    "unbounded-retry": ("medium", r"while\s+True\s*:|for\s*\(\s*;;\s*\)"),
}


def short(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:/#]*)$", 1)


def seeds(symbols: DataFrame, query: str, k: int) -> DataFrame:
    """The symbols (path, name, qualified_name, confidence) that a task's text points at: 20 for an exact name, 8 if the whole text is in it, 3 or 1 a
    word. A top-k, whatever the number of symbols."""
    words = [w for w in dict.fromkeys(query.lower().replace("_", " ").split()) if len(w) > 2 and w not in STOP]
    name, qualified = F.lower("name"), F.lower("qualified_name")
    hay = F.concat_ws(" ", F.lower("path"), name, qualified)
    score = F.when((name == query.lower()) | (qualified == query.lower()), 20.0).otherwise(0.0) + F.when(F.contains(hay, F.lit(query.lower())), 8.0).otherwise(0.0)
    for w in words:
        score = score + F.when((name == w) | (short(qualified) == w), 3.0).when(F.contains(hay, F.lit(w)), 1.0).otherwise(0.0)
    found = symbols.withColumn("seed_score", score).where("seed_score > 0")
    return found.withColumn("seed_score", F.col("seed_score") + F.coalesce("confidence", F.lit(0.0))).orderBy(F.desc("seed_score"), "path", "qualified_name").limit(k)


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """target_path of each edge (column target): by the qualified name, else by the short one, where exactly one path has it."""
    only = lambda name, out: symbols.groupBy(name.alias("_n")).agg(F.count_distinct("path").alias("_k"), F.min("path").alias(out)).where("_k = 1").select("_n", out)
    full = only(F.col("qualified_name"), "_full")
    part = only(short(F.col("qualified_name")), "_part")
    out = edges.join(full, F.col("target") == F.col("_n"), "left").drop("_n").join(part, short(F.col("target")) == F.col("_n"), "left").drop("_n")
    return out.withColumn("target_path", F.coalesce("_full", "_part")).drop("_full", "_part")


def untested(symbols: DataFrame, tests: DataFrame, text: str) -> DataFrame:
    """Symbols whose names no test mentions: tests are cut into words once, and an anti join on the word serves."""
    words = tests.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name")).distinct()
    return symbols.join(words, "name", "left_anti")


def shared_contracts(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Exported symbols (name) that others import (module paths, column imported) by their last part."""
    return exports.join(imports.select(short(F.col("imported")).alias("name")).distinct(), "name", "left_semi")


def implementations(edges: DataFrame) -> DataFrame:
    """(contract, implementations) of edges (src inherits dst)."""
    return edges.groupBy(F.col("dst").alias("contract")).agg(F.array_sort(F.collect_set("src")).alias("implementations"))


def smells(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, kind, severity, line, snippet): lines that match, by number."""
    rows = files.select(path, F.posexplode(tx.lines(F.col(text))).alias("_i", "_l"))
    hits = F.array(*[F.when(F.col("_l").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, (s, p) in SMELLS.items()])
    found = rows.select(path, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("_h"), (F.col("_i") + 1).alias("line"), F.left("_l", F.lit(240)).alias("snippet"))
    return found.select(path, "_h.kind", "_h.severity", "line", "snippet")


def deletable(nodes: DataFrame, edges: DataFrame, exported: str) -> DataFrame:
    """Each node's inbound edges and whether it can go: nothing points at it and it isn't exported."""
    inbound = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    out = nodes.join(inbound, "node", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    return out.withColumn("safe", (F.col("inbound") == 0) & ~F.expr(exported))


def expand_summaries(parents: DataFrame, sources: DataFrame, seeds_: DataFrame) -> DataFrame:
    """Event numbers below summaries: parents (summary, parent), sources (summary, events as an array), seeds (node)."""
    reached = graph.closure(parents.select(F.col("summary").alias("src"), F.col("parent").alias("dst")), seeds_)
    return reached.join(sources, F.col("node") == F.col("summary")).select("seed", F.explode("events").alias("event")).distinct()


def replace_owned(store: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """The store (owner, ...) with an owner's rows replaced."""
    return store.where(F.col("owner") != owner).unionByName(rows.withColumn("owner", F.lit(owner)).select(*store.columns))


def capped_confidence(df: DataFrame, stale: Column, cap: float = 0.6) -> DataFrame:
    return df.withColumn("confidence", F.when(stale, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")))


def repository_map(ranked: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The best symbols that fit a budget of tokens, by a running sum."""
    used = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", used).where(F.col("used") <= budget)


def node_hits(nodes: DataFrame, edges: DataFrame, query: list[str], limit: int) -> DataFrame:
    """The best nodes (node, name, text) for a query: 65 times the shared part of its words, 20 for the whole in the text, 5 for the exact name, and half a point
    an edge up to 10. Degrees are one aggregate; a top-k."""
    whole = " ".join(query)
    own = F.array_distinct(tx.tokens(F.concat_ws(" ", "name", "text"), "table"))
    share = tx.overlap(own, query) / max(1, len(set(query)))
    base = share * 65.0 + F.when(F.contains(F.lower(F.concat_ws(" ", "name", "text")), F.lit(whole)), 20.0).otherwise(0.0) + F.when(F.lower("name") == whole, 5.0).otherwise(0.0)
    both = nodes.join(graph.degrees(edges), "node", "left")
    scored = both.withColumn("_base", base).where("_base > 0")
    return scored.withColumn("score", F.col("_base") + F.least(F.lit(10.0), 0.5 * F.coalesce("degree", F.lit(0)))).drop("_base", "degree").orderBy(F.desc("score"), "node").limit(limit)


def refactor_plan(nodes: DataFrame, edges: DataFrame, seeds_: DataFrame, depth: int = 4) -> DataFrame:
    """(path, symbols, nearest): the files (nodes: node, path) of all that calls the seeds or that they call within some hops, and of themselves."""
    near = graph.reach(edges, seeds_, depth).unionByName(graph.reach(edges, seeds_, depth, reverse=True)).groupBy("node").agg(F.min("depth").alias("depth"))
    return near.join(nodes, "node").groupBy("path").agg(F.count("*").alias("symbols"), F.min("depth").alias("nearest"))


def refreshed(index: DataFrame, seen: DataFrame, files: DataFrame, parse, path: str = "path", text: str = "text") -> DataFrame:
    """An index (path, ...) brought up to date with the files that are there (path, text), by what was seen last (path, hash): rows of unchanged files stay, those
    of changed and new ones are parsed anew (parse: files to rows of the index), those of files that are gone go. Only changed files are parsed."""
    now = files.withColumn("_hash", F.sha2(F.col(text), 256))
    old = seen.select(F.col(path), F.col("hash").alias("_old"))
    changed = now.join(old, path, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("_hash"))).drop("_hash", "_old")
    same = now.join(old, path).where(F.col("_old") == F.col("_hash")).select(path)
    return index.join(same, path, "left_semi").unionByName(parse(changed).select(*index.columns))


def _ended(paths: DataFrame, modules: DataFrame, path: str, module: str, parts: bool) -> DataFrame | None:
    """modules with each of the different paths that theirs ends with, as _sl_end; None where there are no paths."""
    wanted = paths.select(F.col(path).alias("_sl_end")).distinct()
    lengths = sorted(r[0] for r in wanted.select(F.length("_sl_end")).distinct().collect())
    if not lengths:
        return None
    whole = F.length(module)
    ends = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when((n == whole) | ((n < whole) & ((F.substring(F.col(module), whole - n, F.lit(1)) == "/") if parts else F.lit(True))), F.right(F.col(module), n)))
    tails = modules.select("*", F.explode(F.array_compact(ends)).alias("_sl_end"))
    return tails.join(wanted, "_sl_end")


def suffix_matches(imports: DataFrame, modules: DataFrame, path: str = "path", module: str = "module", parts: bool = False) -> DataFrame:
    """imports joined with the modules whose path ends with theirs: all columns of both. With parts, only where a whole part of the path begins there.

    Not a comparison of all pairs: a module gives its endings of the lengths that imports have, of which there are no more than the longest path has letters, as
    keys of an equi join with the different import paths. Those are a row each, so that an ending that very many modules share is split by adaptive execution;
    what matched then meets the imports by path. Empty and null paths match nothing. Columns other than the paths have different names.
    """
    asked = imports.where(F.length(path) > 0)
    found = _ended(asked.select(path), modules, path, module, parts)
    if found is None:
        return asked.crossJoin(modules).where("false")
    return asked.join(found, F.col(path) == F.col("_sl_end")).drop("_sl_end")


def suffix_summary(imports: DataFrame, modules: DataFrame, importer: str, imported: str, path: str = "path", module: str = "module", parts: bool = False) -> DataFrame:
    """(importer, n, least, most): how many of the matches of suffix_matches() each importer has, with the least and the greatest id of a module, its own id left out.

    Pairs aren't made: modules are summed up by the different paths, and an importer takes its path's sums. What its own id adds to these is a sum by path and id, and
    where that is the least or the greatest, the next one stands in for it.
    """
    asked = imports.where(F.length(path) > 0).select(F.col(importer).alias("_sl_me"), F.col(path).alias("_sl_end"))
    found = _ended(asked, modules.select(F.col(imported).alias("_sl_id"), F.col(module).alias("_sl_module")), "_sl_end", "_sl_module", parts)
    names = [F.col("_sl_me").alias(importer), F.col("n"), F.col("least"), F.col("most")]
    if found is None:
        return asked.crossJoin(modules.select(F.lit(0).cast("bigint").alias("n"), F.col(imported).alias("least"), F.col(imported).alias("most"))).where("false").select(*names)
    found = graph.cut(found.where("_sl_id IS NOT NULL").groupBy("_sl_end", "_sl_id").agg(F.count("*").alias("c")))
    all_ = found.groupBy("_sl_end").agg(F.sum("c").alias("_all"), F.min("_sl_id").alias("_l1"), F.max("_sl_id").alias("_m1"))
    next_ = found.join(all_, "_sl_end").groupBy("_sl_end").agg(F.first("_all").alias("_all"), F.first("_l1").alias("_l1"), F.first("_m1").alias("_m1"), F.min(F.when(F.col("_sl_id") != F.col("_l1"), F.col("_sl_id"))).alias("_l2"), F.max(F.when(F.col("_sl_id") != F.col("_m1"), F.col("_sl_id"))).alias("_m2"))
    own = found.select("_sl_end", F.col("_sl_id").alias("_sl_me"), F.col("c").alias("_own"))
    lines = asked.where("_sl_me IS NOT NULL").groupBy("_sl_me", "_sl_end").agg(F.count("*").alias("_times")).join(next_, "_sl_end").join(own, ["_sl_end", "_sl_me"], "left")
    lines = lines.withColumn("_left", F.col("_all") - F.coalesce("_own", F.lit(0))).where("_left > 0")
    least = F.when(F.col("_l1") == F.col("_sl_me"), F.col("_l2")).otherwise(F.col("_l1"))
    most = F.when(F.col("_m1") == F.col("_sl_me"), F.col("_m2")).otherwise(F.col("_m1"))
    return lines.groupBy("_sl_me").agg(F.sum(F.col("_left") * F.col("_times")).alias("n"), F.min(least).alias("least"), F.max(most).alias("most")).select(*names)


#: Rows of either side in a cell of pairs, pairs of a task.
CELL, PAIRS = 2048, 1 << 22


def linked(nodes: DataFrame, node: str, by: list[str]) -> DataFrame:
    """(src, dst): all pairs of different nodes that are equal in the columns `by`, once each; nulls equal nothing.

    As many pairs as there are: rows grow as squares of groups. Nodes meet in cells of a group, so that no task has more than about PAIRS pairs however large a group is, and
    there are tasks enough for all pairs. Pairs are only made distinct where a node is in several groups.
    """
    own = nodes.select(F.col(node).alias("_n"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]).dropna().distinct()
    keys = [f"_b{i}" for i in range(len(by))]
    sizes = own.groupBy(*keys).agg(F.count("*").alias("_c"))
    own = graph.cut(own.join(sizes, keys).withColumn("_k", F.ceil(F.col("_c") / CELL).cast("int")))
    rows, all_, pairs = own.agg(F.count("*"), F.count_distinct("_n"), F.sum(F.col("_c") - 1)).first()
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-(pairs or 0) // PAIRS))
    cells = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    at = F.pmod(F.xxhash64("_n"), F.col("_k")).cast("int")
    on = [*keys, "_x", "_y"]
    a = own.select("*", cells.alias("_y")).select(*keys, at.alias("_x"), "_y", F.col("_n").alias("src")).repartition(parts, *on)
    b = own.select("*", cells.alias("_x")).select(*keys, "_x", at.alias("_y"), F.col("_n").alias("dst")).repartition(parts, *on)
    out = a.join(b, on).where("src <> dst").select("src", "dst")
    return out if rows == all_ else out.distinct()
