"""Edges of source code under changes: only what may resolve otherwise is resolved again, and only impacts that may differ are stale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .symbols import resolve, short


@dataclass(frozen=True)
class Linked:
    """Symbols (path, qualified_name, ...) and edges (path, target, ..., target_path) of an index, and the edges that its last change resolved again."""

    symbols: DataFrame
    edges: DataFrame
    redone: DataFrame


def link(symbols: DataFrame, edges: DataFrame) -> Linked:
    """An index from scratch: every edge (path, target, ...) with target_path, see symbols.resolve()."""
    done = resolve(edges, symbols)
    return Linked(symbols, done, done)


def _names(symbols: DataFrame) -> DataFrame:
    """(name, path) once each of the names by which edges find symbols: whole ones (kind 0) and short ones (kind 1)."""
    whole = symbols.select(F.lit(0).alias("kind"), F.col("qualified_name").alias("name"), "path")
    part = symbols.select(F.lit(1).alias("kind"), short(F.col("qualified_name")).alias("name"), "path")
    return whole.unionByName(part).distinct()


def relink(index: Linked, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> Linked:
    """The index after some files changed, came or went. files: their paths (column path); symbols, edges: all that those hold now, none for files that went.

    An edge resolves otherwise only if its file changed, or if the paths that have its target's whole or short name did. So the names whose paths differ between the old
    and the new symbols of the changed files are found first; edges to them, and those of the changed files, are resolved again against the symbols of their names alone; all
    others stay as they are. Everything is an equi join on paths or names, with one row a key on the side of the change; nulls match nothing.
    """
    changed = files.select("path").distinct()
    old = index.symbols.join(changed, "path", "left_semi")
    now = index.symbols.join(changed, "path", "left_anti").unionByName(symbols)
    before, after = _names(old), _names(symbols)
    # Pairs of name and path that only one side has; the name's other paths don't matter here.
    moved = before.select("*", F.lit(-1).alias("by")).unionByName(after.select("*", F.lit(1).alias("by"))).groupBy("kind", "name", "path").agg(F.sum("by").alias("by"))
    names = graph.cut(moved.where("by != 0").select("kind", "name").distinct())
    kept = index.edges.join(changed, "path", "left_anti")
    hit = lambda kind, c: names.where(F.col("kind") == kind).select(F.col("name").alias(c), F.lit(True).alias(f"{c}_hit"))
    marked = kept.join(hit(0, "_whole"), F.col("target") == F.col("_whole"), "left").join(hit(1, "_part"), short(F.col("target")) == F.col("_part"), "left")
    marked = graph.cut(marked.withColumn("_again", F.coalesce("_whole_hit", F.lit(False)) | F.coalesce("_part_hit", F.lit(False))).drop("_whole", "_part", "_whole_hit", "_part_hit"))
    own = [c for c in index.edges.columns if c != "target_path"]
    again = marked.where("_again").select(*own).unionByName(edges.select(*own))
    asked = again.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("target").alias("name")), F.struct(F.lit(1).alias("kind"), short(F.col("target")).alias("name")))).alias("x")).select("x.*").distinct()
    # Only symbols of the names that are asked for can decide; the others of a path don't change how many paths a name has.
    near = now.withColumn("_names", F.array(F.struct(F.lit(0).alias("kind"), F.col("qualified_name").alias("name")), F.struct(F.lit(1).alias("kind"), short(F.col("qualified_name")).alias("name"))))
    near = near.select("*", F.explode("_names").alias("_x")).select(*now.columns, F.col("_x.kind").alias("kind"), F.col("_x.name").alias("name")).join(asked, ["kind", "name"], "left_semi").drop("kind", "name")
    redone = graph.cut(resolve(again, near).select(*index.edges.columns))
    return Linked(graph.cut(now), marked.where("not _again").select(*index.edges.columns).unionByName(redone), redone)


def stale_impacts(before: DataFrame, now: DataFrame, depth: int) -> DataFrame:
    """(node) whose reverse impact up to `depth` hops may differ between two graphs (src, dst): what the ends of the edges that differ lead to, in either graph.

    An edge counts for a node's impact only if a path from the edge leads to the node, so that all other nodes' impacts stay as they are.
    """
    either = before.select("src", "dst").distinct().withColumn("by", F.lit(-1)).unionByName(now.select("src", "dst").distinct().withColumn("by", F.lit(1)))
    pairs = graph.cut(either.groupBy("src", "dst").agg(F.sum("by").alias("by")))
    ends = pairs.where("by != 0").select(F.col("dst").alias("node"))
    return graph.reach(pairs.select("src", "dst"), ends, max(depth - 1, 0)).select("node")
