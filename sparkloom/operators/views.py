"""Text as segments, families and facets; Merkle roots over ordered hashes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.jsonbound import Bounds, bound
from .graph import cut as cut_lineage
from .profile import PRIORITY

ERROR = re.compile(tx.ERROR_LINE)
WARNING = re.compile(tx.WARNING_LINE)
LOCATION = re.compile(tx.LOCATION)


def family(text: Column) -> Column:
    """What kind of payload a text is."""
    own = tx.lines(text)
    diff = F.exists(F.slice(own, 1, 30), lambda x: x.startswith("diff --git") | x.startswith("@@ ") | x.startswith("--- ") | x.startswith("+++ "))
    bad = F.size(F.filter(F.slice(own, 1, 300), lambda x: x.rlike(tx.ERROR_LINE)))
    start = F.left(F.ltrim(text), F.lit(1))
    return F.when(F.contains(text, F.lit("\0")), "binary").when(start.isin("{", "["), "json").when(diff, "diff").when((F.size(own) > 120) | (bad >= 2), "log").otherwise("text")


def cut(data: bytes, target: int) -> list[tuple[int, int, bytes]]:
    """Runs of whole lines of up to `target` bytes; an error line begins a run; longer lines are cut on their own."""
    out, start, at = [], 0, 0
    for line in data.splitlines(keepends=True):
        begins = ERROR.search(line.decode("utf-8", "replace"))
        if at > start and (at - start + len(line) > target or begins):
            out.append((start, at, data[start:at]))
            start = at
        at += len(line)
        while at - start > target:
            out.append((start, start + target, data[start : start + target]))
            start += target
    if at > start:
        out.append((start, at, data[start:at]))
    return out


def grade(text: str) -> tuple[str, float, bool]:
    """Kind, salience and whether it is critical."""
    place = bool(LOCATION.search(text))
    if ERROR.search(text):
        return "critical", 12.0 + 2.0 * place, True
    if WARNING.search(text):
        return "warning", 6.0 + place, False
    return "text-window", 1.0, False


#: Bytes of segments that are held at once, beside a batch of texts.
HELD = 1 << 20


def segments(df: DataFrame, key: str, text: str, target: int) -> DataFrame:
    """(key, segment, start_byte, end_byte, content_hash, kind, salience, critical, body, raw). A narrow pass in Arrow batches, as cuts depend on order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "segment", "start_byte", "end_byte", "content_hash", "kind", "salience", "critical", "body", "raw"]
        for b in batches:
            rows, held = [], 0
            for k, t in zip(b[key], b[text], strict=True):
                for i, (start, end, raw) in enumerate(cut((t or "").encode(), target)):
                    if held >= HELD:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                    body = raw.decode("utf-8", "replace")
                    rows.append((k, i, start, end, hashlib.sha256(raw).hexdigest(), *grade(body), body, raw))
                    held += len(raw)
            yield pd.DataFrame(rows, columns=names)

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, segment bigint, start_byte bigint, end_byte bigint, content_hash string, kind string, salience double, critical boolean, body string, raw binary")


def verify_segments(df: DataFrame, key: str) -> DataFrame:
    """Per artifact: whether its segments join without gaps from 0, and the bytes that they cover."""
    before = F.lag("end_byte", 1, 0).over(Window.partitionBy(key).orderBy("segment"))
    return df.withColumn("_ok", before == F.col("start_byte")).groupBy(key).agg(F.bool_and("_ok").alias("contiguous"), F.max("end_byte").alias("n_bytes"))


def merkle_root(hashes: list[str]) -> str:
    """The SHA-256 tree over hexadecimal hashes, the last of an odd layer paired with itself; that of no bytes over none."""
    if not hashes:
        return hashlib.sha256(b"").hexdigest()
    h = [bytes.fromhex(x) for x in hashes]
    while len(h) > 1:
        h += h[-1:] * (len(h) % 2)
        h = [hashlib.sha256(a + b).digest() for a, b in zip(h[::2], h[1::2], strict=True)]
    return h[0].hex()


def _joined(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(F.concat(left, right)), 256)


def merkle_layers(df: DataFrame, key: str, order: str, leaf: str) -> DataFrame:
    """(key, level, position, hash) of all nodes of each key's tree, leaves on level 0: a layer is an aggregate of the one below by half its positions, so that
    no key is gathered. As many rounds as the largest tree has levels."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    layer = cut_lineage(df.select(key, position.alias("position"), F.lower(F.col(leaf)).alias("hash")))
    most = layer.agg(F.max("position")).first()[0]
    out = layer.withColumn("level", F.lit(0))
    sizes = layer.groupBy(key).agg(F.max("position").alias("_last"))
    for level in range(1, int(most or 0).bit_length() + 1):
        # A tree of one node on the level below is at its root already.
        below = layer.join(sizes.where(F.shiftright(F.col("_last"), level - 1) > 0).select(key), key, "left_semi")
        pairs = below.groupBy(key, F.floor(F.col("position") / 2).cast("int").alias("position")).agg(F.min_by("hash", "position").alias("_a"), F.max_by("hash", "position").alias("_b"))
        layer = cut_lineage(pairs.select(key, "position", _joined(F.col("_a"), F.col("_b")).alias("hash")))
        out = out.unionByName(layer.withColumn("level", F.lit(level)))
    return out.select(key, "level", "position", "hash")


def merkle_roots(df: DataFrame, key: str, order: str, leaf: str) -> DataFrame:
    """(key, leaves, root): SHA-256 trees over each key's ordered hexadecimal hashes, the last of an odd layer paired with itself."""
    layers = merkle_layers(df, key, order, leaf)
    return layers.groupBy(key).agg(F.count_if(F.col("level") == 0).alias("leaves"), F.max_by("hash", "level").alias("root"))


def merkle_proofs(df: DataFrame, key: str, order: str, leaf: str) -> DataFrame:
    """(key, position, leaf, root, proof) of every leaf: the siblings (side, hash) on its way to the root. One equi join of the leaves, a row for each of their
    levels, with the layers."""
    layers = cut_lineage(merkle_layers(df, key, order, leaf))
    roots = layers.groupBy(key).agg(F.max("level").alias("_top"), F.max_by("hash", "level").alias("root"))
    leaves = layers.where("level = 0").select(key, F.col("position"), F.col("hash").alias("leaf")).join(roots, key)
    ways = leaves.select("*", F.explode(F.when(F.col("_top") > 0, F.sequence(F.lit(0), F.col("_top") - 1)).otherwise(F.array(F.lit(None).cast("int")))).alias("level"))
    at = F.expr("shiftright(position, level)")
    ways = ways.withColumn("_at", at).withColumn("_sibling", at.bitwiseXOR(F.lit(1)))
    last = layers.groupBy(key, "level").agg(F.max("position").alias("_end"))
    ways = ways.join(last, [key, "level"], "left").withColumn("_other", F.least("_sibling", "_end"))
    other = layers.select(key, "level", F.col("position").alias("_other"), F.col("hash").alias("_hash"))
    met = ways.join(other, [key, "level", "_other"], "left")
    step = F.when(F.col("level").isNotNull(), F.struct("level", F.when(F.col("_sibling") < F.col("_at"), "left").otherwise("right").alias("side"), F.col("_hash").alias("hash")))
    gathered = met.groupBy(key, "position", "leaf", "root").agg(F.array_sort(F.collect_list(step)).alias("_p"))
    return gathered.select(key, "position", "leaf", "root", F.transform("_p", lambda x: F.struct(x["side"].alias("side"), x["hash"].alias("hash"))).alias("proof"))


def proof_holds(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether a leaf and its siblings give the root."""
    up = F.aggregate(proof, leaf, lambda h, x: F.when(x["side"] == "left", _joined(x["hash"], h)).when(x["side"] == "right", _joined(h, x["hash"])))
    return F.coalesce(up == root, F.lit(False))


def facets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per text: lines by class, distinct shapes, code symbols and to-dos, in one pass over its lines without an explode."""
    own = df.select(key, tx.lines(F.col(text)).alias("l"))
    n = lambda p: F.size(F.filter("l", lambda x: x.rlike(p)))
    shapes = F.size(F.array_distinct(F.transform(F.filter("l", lambda x: F.trim(x) != ""), tx.log_shape)))
    return own.select(key, F.size("l").alias("lines"), n(tx.ERROR_LINE).alias("errors"), n(tx.WARNING_LINE).alias("warnings"), n(tx.LOCATION).alias("locations"), n(tx.CODE_SYMBOL).alias("symbols"), n("TODO|FIXME").alias("todos"), shapes.alias("shapes"))


def _structure(value: object, depth: int = 0, deepest: int = 6, keys: int = 64) -> dict:
    if depth >= deepest:
        return {"truncated": True}
    if isinstance(value, dict):
        names = sorted(map(str, value))
        return {"fields": {k: _structure(value[k], depth + 1, deepest, keys) for k in names[:keys]}, "key_count": len(names), "keys": names[:keys], "truncated": len(names) > keys, "type": "object"}
    if isinstance(value, list):
        return {"items": [_structure(v, depth + 1, deepest, keys) for v in value[:8]], "length": len(value), "truncated": len(value) > 8, "type": "array"}
    if isinstance(value, str):
        return {"chars": len(value), "lines": value.count("\n") + 1 if value else 0, "sha256": hashlib.sha256(value.encode("utf-8", "replace")).hexdigest(), "type": "string"}
    return {"type": "null" if value is None else "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number"}


@F.pandas_udf(T.StringType())
def structure(texts: pd.Series) -> pd.Series:
    """JSON that says what a JSON text is made of - types, keys, sizes, hashes of strings - without any of its values; null for other texts."""

    def of(text: str | None) -> str | None:
        try:
            return json.dumps(_structure(json.loads(text or "")), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(of)


@F.pandas_udf(T.StringType())
def pruned(texts: pd.Series) -> pd.Series:
    """JSON within bounds of depth, width, list items and characters, priority keys first; null for other texts."""

    def of(text: str | None) -> str | None:
        try:
            return json.dumps(bound(json.loads(text or ""), NESTED), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(of)


# Bounds of nested values; keys that matter most come first.
NESTED = Bounds(keys=8, items=8, head=8, chars=160, lead=160, depth=4, deep=lambda value: {"bounded": True, "reason": "max-depth"}, scalars=True, order=lambda key: (key.lower() not in PRIORITY, key))
