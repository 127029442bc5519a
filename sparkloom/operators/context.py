"""Packs and pages of context: dependency-aware packing, lenses, pages by bytes, deltas, collection within a budget."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import utf8_prefix
from ..functions.jsonbound import Bounds, bound
from .align import matching, unified
from .graph import cut
from .windows import pack_skipping


class Pack:
    """Items of one pack: what must be in it with all it depends on, then the best worth a token, then one swap of each kind."""

    def __init__(self, rows: list[dict], budget: int):
        self.rows = {r["item"]: r for r in rows}
        self.budget, self.chosen, self.used = budget, set(), 0

    def needs(self, item: str) -> set[str]:
        """The item and what it depends on, as far as it isn't chosen; unknown items are left out, cycles are fine."""
        out, work = set(), [item]
        while work:
            x = work.pop()
            if x in self.rows and x not in out and x not in self.chosen:
                out.add(x)
                work += self.rows[x]["depends"]
        return out

    def cost(self, items: set[str]) -> int:
        return sum(max(0, self.rows[x]["tokens"]) for x in items)

    def worth(self, items: set[str]) -> float:
        return sum(max(0.0, self.rows[x]["utility"]) for x in items)

    def take(self, items: set[str]) -> bool:
        if self.used + self.cost(items) > self.budget:
            return False
        self.used += self.cost(items)
        self.chosen |= items
        return True

    def fill(self) -> bool:
        """False, and an empty pack, if what must be in it doesn't fit."""
        must = set().union(*(self.needs(x) for x, r in self.rows.items() if r["mandatory"]))
        if not self.take(must):
            return False
        while True:
            options = []
            for x in self.rows.keys() - self.chosen:
                items = self.needs(x)
                options.append((-self.worth(items) / max(1, self.cost(items)), -self.worth(items), self.cost(items), x))
            if not any(self.take(self.needs(x)) for *_, x in sorted(options)):
                break
        for x in sorted(self.rows.keys() - self.chosen, key=lambda x: (-self.rows[x]["utility"], x)):
            self._swap(x, must)
        return True

    def _swap(self, incoming: str, must: set[str]) -> None:
        items = self.needs(incoming)
        if incoming in self.chosen:
            return
        free = [x for x in self.chosen - must if not any(x in self.rows[y]["depends"] for y in self.chosen if y != x)]
        for old in sorted(free, key=lambda x: (self.rows[x]["utility"] / max(1, self.rows[x]["tokens"]), x)):
            room = self.budget - self.used + self.rows[old]["tokens"]
            if self.worth(items) > self.rows[old]["utility"] and self.cost(items) <= room and old not in set().union(*(self.rows[y]["depends"] for y in items)):
                self.chosen.remove(old)
                self.used -= self.rows[old]["tokens"]
                self.take(items)
                return


def pack_dependent(df: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, used, ok, items) of packs of rows (key, item, tokens, utility, mandatory, depends). A pack is a bounded set of candidates, folded in one task."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, "depends": list(r["depends"]) if r["depends"] is not None else []} for r in f.to_dict("records")]
        pack = Pack(rows, budget)
        ok = pack.fill()
        return pd.DataFrame({key: [f[key].iloc[0]], "used": [pack.used], "ok": [ok], "items": [sorted(pack.chosen)]})

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col("item").cast("string"), F.col("tokens").cast("bigint"), F.col("utility").cast("double"), "mandatory", "depends").groupBy(key).applyInPandas(run, f"{key} {kind}, used bigint, ok boolean, items array<string>")


def lens(segments: DataFrame, key: str, name: str, query: Column | None = None) -> DataFrame:
    """Segments by a lens: all, critical (or failures, the most salient first), changes (a boolean column changed), head, tail, salient or query (a boolean column)."""
    by = lambda *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if name == "all":
        return segments
    if name in ("critical", "failures"):
        return segments.where("critical").withColumn("place", by(F.desc("salience"), F.col("segment")))
    if name in ("changes", "delta"):
        return segments.where("changed")
    if name == "query":
        return segments.where(query)
    order, n = {"head": ([F.col("segment")], 4), "tail": ([F.desc("segment")], 4), "salient": ([F.desc("salience"), F.col("segment")], 16)}[name]
    return segments.withColumn("_r", by(*order)).where(F.col("_r") <= n).drop("_r")


def pages(segments: DataFrame, key: str, order: list[Column], size: str, page_bytes: int) -> DataFrame:
    """page of each segment: which pages of `page_bytes` its bytes lie on, by a running sum; a token for a page is its key and number."""
    end = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = segments.withColumn("_end", end).withColumn("first_page", F.floor((F.col("_end") - F.col(size)) / page_bytes)).withColumn("last_page", F.floor(F.greatest(F.col("_end") - 1, F.lit(0)) / page_bytes))
    return out.drop("_end")


def issued(tokens: DataFrame, token: str, position: int, now: float, ttl: float) -> DataFrame:
    """The table of continuation tokens (token, position, expires_at, used) with one more."""
    new = tokens.sparkSession.createDataFrame([(token, position, now + ttl, False)], tokens.schema)
    return tokens.unionByName(new)


def redeemed(tokens: DataFrame, token: str, now: float) -> tuple[DataFrame, int]:
    """The table after a token is used, and where it leads. A token serves once and until it expires; others are an error."""
    row = tokens.where((F.col("token") == token) & ~F.col("used") & (F.col("expires_at") > now)).first()
    if row is None:
        raise ValueError("the token is unknown, used or expired")
    return tokens.withColumn("used", F.col("used") | (F.col("token") == token)), row["position"]


def after(df: DataFrame, cursor: str, seen: int, n: int) -> DataFrame:
    """A page by key: the n rows after the last one seen."""
    return df.where(F.col(cursor) > seen).orderBy(cursor).limit(n)


def collectable(df: DataFrame, order: list[str], size: str, item: str, live: Column, budget: int) -> DataFrame:
    """Dead items, oldest first, that fit a budget of bytes; too large ones are skipped and the next ones tried, to the end.

    Rounds instead of a fold of all items: of the items that still fit what is left of the budget, all up to the first that doesn't by a running sum are
    taken; that one is passed over. The running sums are windows over an ordered prefix: candidates whose sizes add up to the budget, which a
    range partition by order finds from the sums of its partitions.
    """
    rows = df.where(~live).select(*dict.fromkeys([*order, size, item])).withColumn("_n", F.col(size).cast("bigint"))
    taken, left, after, kinds = None, budget, None, dict(df.dtypes)
    while True:
        fit = rows.where(F.col("_n") <= left)
        if after is not None:
            fit = fit.where(F.struct(*order) > F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, after, strict=True)]))
        # Whole partitions of a range order sum up; only the one that crosses the budget is looked into.
        fit = cut(fit.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
        sums = fit.groupBy("_p").agg(F.sum("_n").alias("s")).orderBy("_p").toLocalIterator()
        used, cross = 0, None
        for p, s in sums:
            if used + s > left:
                cross = p
                break
            used += s
        if cross is None:
            new = fit
        else:
            end = F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            inside = fit.where(F.col("_p") == cross).withColumn("_end", end + used)
            new = fit.where(F.col("_p") < cross).unionByName(inside.where(F.col("_end") <= left).drop("_end"))
            stop = inside.where(F.col("_end") > left).orderBy(*order).first()
        taken = new.select(item) if taken is None else taken.unionByName(new.select(item))
        if cross is None:
            return taken
        left -= new.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        after = [stop[c] for c in order]


def deltas(df: DataFrame, key: str, before: str, now: str, share: float = 0.75) -> DataFrame:
    """(key, is_delta, body): a unified diff to the text before, where it is shorter than `share` of the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, a, b in zip(f[key], f[before], f[now], strict=True):
                a, b = a or "", b or ""
                diff = "\n".join(unified(a.splitlines(), b.splitlines())) if a and a != b else ""
                short = bool(diff) and len(diff) < share * len(b)
                rows.append((k, short, diff if short else b))
            yield pd.DataFrame(rows, columns=[key, "is_delta", "body"])

    return df.select(key, before, now).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, is_delta boolean, body string")


def changed_segments(df: DataFrame, key: str, before: str, now: str) -> DataFrame:
    """(key, changed): places in `now` (arrays of hashes) that a longest common subsequence with `before` doesn't match; a null array is an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, a, b in zip(f[key], f[before], f[now], strict=True):
                a, b = [[] if x is None else list(x) for x in (a, b)]
                kept = {i for _, j, n in matching(a, b) for i in range(j, j + n)}
                rows.append((k, [i for i in range(len(b)) if i not in kept]))
            yield pd.DataFrame(rows, columns=[key, "changed"])

    return df.select(key, before, now).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, changed array<int>")


def bounded(value: object, depth: int = 5, width: int = 12, items: int = 12, chars: int = 640) -> object:
    """A JSON value within bounds of depth, keys, list items and characters."""
    return bound(value, Bounds(keys=width, items=items, head=items, chars=chars, lead=chars, depth=depth))


def envelope(value: dict, budget: int) -> str:
    """JSON of a small result within a budget of bytes: bounds get tighter until it fits. For results that are on the driver already."""
    for depth, width, items, chars in ((6, 24, 24, 640), (5, 12, 12, 320), (4, 8, 6, 120), (3, 6, 3, 60), (2, 4, 1, 30), (1, 2, 1, 10)):
        out = json.dumps(bounded(value, depth, width, items, chars), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        if len(out.encode()) <= budget:
            return out
    return '{"bounded":true}'


# Columns that each level of disclosure adds to those before it.
LEVELS = {
    "L0": ["uri", "item_id", "label", "kind", "content_sha256", "parent_uri", "child_count", "tags"],
    "L1": ["reason", "provenance", "trust", "freshness"],
    "L2": ["structure", "metadata_keys"],
    "L3": ["content", "metadata"],
}


def disclosed(items: DataFrame, level: str, content: str = "content") -> DataFrame:
    """What a level shows of items: the columns of it and of those before, as far as they are there; hashes and structures are made from the content where asked
    for, so that nothing else of it is read below L3."""
    from .views import structure

    names = list(LEVELS)
    if level not in names:
        raise ValueError(f"levels are {names}")
    asked = [c for n in names[: names.index(level) + 1] for c in LEVELS[n]]
    made = {"content_sha256": F.sha2(content, 256), "structure": structure(content)}
    shown = [made[c].alias(c) if c in made and c not in items.columns else F.col(c) for c in asked if c in items.columns or c in made]
    return items.select(F.lit(level).alias("level"), *shown)


def recent_context(events: DataFrame, key: str, order: str, size: Column, budget: int, last: int) -> DataFrame:
    """The last events of each key, from the newest back while they fit the budget; the newest one always. Rank limits drop the older ones before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    rows = events.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last).withColumn("_used", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("_used") <= budget) | (F.col("_r") == 1)).drop("_r", "_used")


def active_context(rows: DataFrame, key: str, tokens: Column, query: list[str], critical: Column, current: Column, generation: Column, limit: int) -> DataFrame:
    """The best rows of each key for a query: 100 times the shared part of its words, 50 if critical, 20 if current, and a little for later generations."""
    share = F.size(F.array_intersect(F.array_distinct(tokens), F.array(*map(F.lit, query)))) / max(1, len(set(query)))
    score = share * 100 + F.when(critical, 50.0).otherwise(0.0) + F.when(current, 20.0).otherwise(0.0) + F.log1p(generation) / 5
    scored = rows.withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), *[F.col(c) for c in rows.columns if c != key]))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


# Filters that a query may have in line.
FILTERS = ("kind", "path", "error", "scope")


def inline_filters(query: str) -> tuple[str, dict[str, str]]:
    """A query without its filters, and those."""
    plain, filters = [], {}
    for word in query.split():
        name, colon, value = word.partition(":")
        if colon and value and name in FILTERS:
            filters[name] = value
        else:
            plain.append(word)
    return " ".join(plain), filters


# The layers of a compiled context, in order.
LAYERS = ["system", "repository", "tools", "memory", "task", "user"]


def compiled(items: DataFrame, key: str, budget: int, previous: DataFrame | None = None, shown: int = 8192) -> DataFrame:
    """One row per pack: used, n_items, items (ids in order), n_omitted, prefix_hash.

    Items (key, place, item_id, layer, source, content, priority, stable) count once by content, the first one; those that were sent before (previous: key, item_id, before)
    are sent as a diff where that is short, and no more than `shown` bytes of each. By layer, stable ones first, then priority, they are taken while they
    fit the budget of tokens, and those that don't are passed over. The hash of the stable ones taken is what a cached prefix goes by.
    """
    text = F.replace("content", F.lit("\r\n"), F.lit("\n"))
    rows = items.withColumn("content", text).withColumn("_hash", F.sha2("content", 256))
    first = F.row_number().over(Window.partitionBy(key, "_hash").orderBy("place"))
    rows = rows.withColumn("_first", first).where("_first = 1").drop("_first")
    if previous is not None:
        rows = rows.withColumn("_id", F.concat_ws(":", key, "item_id"))
        sent = deltas(rows.join(previous.select(key, "item_id", "before"), [key, "item_id"], "left").select("_id", "before", "content"), "_id", "before", "content").select("_id", "body")
        rows = rows.join(sent, "_id").withColumn("content", F.col("body")).drop("body", "_id")
    layer = F.coalesce(F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")), F.lit(0))
    bounded_ = F.when(F.octet_length("content") > shown, utf8_prefix(F.col("content"), shown, "…")).otherwise(F.col("content"))
    rows = rows.withColumn("content", bounded_).withColumn("_l", F.when(layer == 0, 99).otherwise(layer)).withColumn("_s", F.when(F.col("stable"), 0).otherwise(1)).withColumn("_p", -F.greatest(F.least("priority", F.lit(1.0)), F.lit(0.0)))
    rows = rows.withColumn("tokens", F.ceil(F.octet_length("content") / 4).cast("bigint"))
    packed = pack_skipping(rows, [key], ["_l", "_s", "_p", "source", "item_id"], "tokens", max(1, budget), "item_id")
    taken = packed.select(key, F.posexplode("items").alias("_at", "item_id")).join(rows.select(key, "item_id", "stable", "content"), [key, "item_id"])
    prefix = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("stable"), F.struct("_at", F.sha2("content", 256).alias("h"))))), lambda x: x["h"]), "")
    hashes = taken.groupBy(key).agg(F.sha2(prefix, 256).alias("prefix_hash"))
    counts = rows.groupBy(key).agg(F.count("*").alias("_all"))
    out = packed.join(hashes, key, "left").join(counts, key)
    return out.select(key, "used", "n_items", "items", (F.col("_all") - F.col("n_items")).alias("n_omitted"), F.coalesce("prefix_hash", F.sha2(F.lit(""), 256)).alias("prefix_hash"))
