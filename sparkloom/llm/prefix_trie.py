"""The prefix trie of conversations: owned chains by binary search over prefix digests, aggregated bottom-up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, in_arrow, materialize, table

#: A node is hot from this many member conversations on, or from this share of all turns where that is more: no more than MANY of them are broadcast.
HOT, MANY = 1000, 10_000
#: Ids of conversations that end at a node travel in texts of so many.
IDS = 65_536
#: Words, as the tables' contract has them.
WORDS = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Narrow rows of the turns: conv, turn, same (a digest of role and text, null as empty) and words in the text. Rows without a conversation take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    same = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), same.alias("same"), F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words"))


def running(rows: DataFrame, key: str, order: list[Column], take: dict[str, tuple[Column, str]]) -> DataFrame:
    """rows with running totals within each key in the given order: take maps a new column to what is totalled, by `sum` or `bit_xor`, the row itself included.

    Rows are dealt by ranges of key and order, so that one key may have any share of them: each range totals its own rows, and what the ranges before it have
    of a key that straddles their ends, at most a row for each range, is added.
    """
    cut = materialize(rows.repartitionByRange(key, *order).withColumn("_sl_range", F.spark_partition_id()), "ranges")
    kinds = {"sum": F.sum, "bit_xor": F.bit_xor}
    totals = cut.groupBy(key, "_sl_range").agg(*[kinds[kind](x).alias(c) for c, (x, kind) in take.items()], F.count("*").alias("_sl_n"))
    before = Window.partitionBy(key).orderBy("_sl_range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = totals.select(F.col(key).alias("_sl_key"), F.col("_sl_range").alias("_sl_from"), *[kinds[kind](c).over(before).alias(f"_sl_{c}") for c, (_, kind) in take.items()])
    cuts = cuts.where(F.col(f"_sl_{next(iter(take))}").isNotNull())
    inside = Window.partitionBy(key, "_sl_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumns({c: kinds[kind](x).over(inside) for c, (x, kind) in take.items()})
    met = own.join(F.broadcast(cuts), (F.col(key) == F.col("_sl_key")) & (F.col("_sl_range") == F.col("_sl_from")), "left")
    whole = {c: F.col(c) + F.coalesce(f"_sl_{c}", F.lit(0)) if kind == "sum" else F.col(c).bitwiseXOR(F.coalesce(f"_sl_{c}", F.lit(0).cast("bigint"))) for c, (_, kind) in take.items()}
    return met.withColumns(whole).select(*rows.columns, *take)


def placed(rows: DataFrame) -> DataFrame:
    """turns() with at, the place of a turn in its conversation from 0: by turn, null first, turns that tie by their digest."""
    return running(rows, "conv", [F.asc_nulls_first("turn"), F.asc("same")], {"at": (F.lit(1).cast("bigint"), "sum")}).withColumn("at", F.col("at") - 1).drop("turn")


def shared_heads(rows: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt behind shared heads: the first h turns of conversation c - c % group (the multiple of group below c), then c's own turns after its first h; h = crc32(c) % (most + 1).

    rows: placed(). Gives (conv, at, same, words) of the rebuilt turns, and every conversation (conv, n turns), those without turns too.
    """
    h = F.crc32(F.col("conv").cast("string")) % (most + 1)
    convs = rows.groupBy("conv").agg(F.max("at").alias("last"))
    first = rows.where((F.col("conv") % group == 0) & (F.col("at") < most)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "same", "words"))).alias("head"))
    met = convs.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(group))).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,same:string,words:bigint>>")), F.lit(1), h.cast("int"))
    met = materialize(met.select("conv", h.alias("h"), head.alias("head"), F.greatest(F.col("last") + 1 - h, F.lit(0)).alias("own")), "heads")
    heads = met.select("conv", F.explode("head").alias("t")).select("conv", "t.at", "t.same", "t.words")
    # A conversation's own turns follow its head: a bounded row for each conversation meets them, split where one has very many.
    own = rows.where(F.col("at") >= h).join(met.select("conv", F.size("head").cast("bigint").alias("k")), "conv").select("conv", (F.col("at") - h + F.col("k")).alias("at"), "same", "words")
    return heads.unionByName(own), met.select("conv", (F.size("head") + F.col("own")).alias("n"))


def prefixes(rows: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: conv, depth from 1, node (120 bits of digest) and words of its last turn.

    A prefix's digest is the exclusive or of SHA-256 of place and digest of its turns: a running total, so that a long conversation is worked on by many tasks.
    """
    bits = lambda i: F.conv(F.substring(F.sha2(F.concat(F.col("at").cast("string"), F.lit(":"), F.col("same")), 256), 1 + 15 * i, 15), 16, 10).cast("bigint")
    out = running(rows, "conv", [F.asc("at")], {"one": (bits(0), "bit_xor"), "two": (bits(1), "bit_xor")})
    return out.select("conv", (F.col("at") + 1).alias("depth"), F.concat_ws("-", F.hex("one"), F.hex("two")).alias("node"), "words")


def _owners(convs: DataFrame, rows: DataFrame, nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """For each conversation the first depth that it owns (n + 1 if none), and who owns the depth before it (null: the root's owner).

    A conversation owns a prefix if no smaller one has it, and then all its longer prefixes. So a binary search over depths finds the first: in each round
    the open conversations ask for the digest of their middle prefix, and that for the smallest conversation. Both tables lie in buckets; what is shuffled
    is a row for each open conversation. Hot nodes, of which there are few, answer by broadcast.
    """
    open_ = convs.where("n > 0").select("conv", F.lit(1).cast("bigint").alias("low"), (F.col("n") + 1).alias("high"), F.lit(None).cast("bigint").alias("above"))
    done = [convs.where("n = 0").select("conv", F.lit(1).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("above"))]
    while True:
        asked = open_.withColumn("depth", F.expr("(low + high) div 2")).join(rows.select("conv", "depth", "node"), ["conv", "depth"])
        asked = materialize(asked, "asked")
        few = asked.join(F.broadcast(hot.select("node", "owner")), "node")
        rest = asked.join(F.broadcast(hot.select("node")), "node", "left_anti").join(nodes.select("node", "owner"), "node")
        own = F.col("owner") == F.col("conv")
        told = few.unionByName(rest).select("conv", F.when(own, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(own, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(own, F.col("above")).otherwise(F.col("owner")).alias("above"))
        told = materialize(told, "searched")
        done.append(told.where("low = high").select("conv", F.col("low").alias("first"), "above"))
        open_ = told.where("low < high")
        if open_.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _whole_chains(chains: DataFrame, take: list[str]) -> DataFrame:
    """chains (conv, up: the chain that it hangs on, values) with the values summed over all chains below each, itself included.

    Bottom-up by doubling: after k rounds a chain has the sums of those fewer than 2^k steps below it and knows the one 2^k steps above, so that a trie of
    any depth takes the logarithm of its depth in rounds.
    """
    now = materialize(chains.select("conv", "up", *take), "chains")
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(F.col("up").alias("conv")).agg(*[F.sum(c).alias(f"_sl_{c}") for c in take])
        above = now.select(F.col("conv").alias("up"), F.col("up").alias("next"))
        moved = now.join(below, "conv", "left").select("conv", "up", *[(F.col(c) + F.coalesce(f"_sl_{c}", F.lit(0))).alias(c) for c in take])
        climbed = moved.where("up is not null").join(above, "up", "left").select("conv", F.col("next").alias("up"), *take)
        now = materialize(climbed.unionByName(moved.where("up is null")), "chains")
    return now.drop("up")


def ends(rows: DataFrame) -> DataFrame:
    """rows (node, conv) as (node, ends_sha256): the SHA-256 of the decimal ids in ascending order, joined by commas.

    Ids are sorted by ranges of node and id, so that a node's ids are on many tasks; each sends texts of IDS of them, which one task streams through the
    digest, the one step that can't be split, in the memory of a text.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, node, first, ids = ["node", "first", "ids"], None, None, []
        full = lambda: pa.RecordBatch.from_arrays([pa.array([node]), pa.array([first]), pa.array([",".join(ids)])], names)
        for b in batches:
            for x, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x != node or len(ids) == IDS:
                    if ids:
                        yield full()
                    node, first, ids = x, c, []
                ids.append(str(c))
        if ids:
            yield full()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out = []
            for x, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x == node:
                    state.update(b",")
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = x, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    texts = in_arrow(rows.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv"), packed, "node string, first bigint, ids string")
    return in_arrow(texts.repartition("node").sortWithinPartitions("node", "first").select("node", "ids"), hashed, "node string, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes from rows (conv, at from 0, same, words; see placed()) and all conversations (conv, n turns): conv_id (the smallest member), depth,
    parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A node is a distinct sequence of the first `depth` turns; turns are the same if their role and text are. No conversations: no nodes. Conversations may have
    any number of turns and be copies in any number.
    """
    convs = materialize(convs, "conversations")
    told = prefixes(rows)
    held = bucketed(told, "prefixes", ["conv", "depth"])
    nodes = bucketed(held.groupBy("node").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("words").alias("words")), "nodes", ["node"])
    size = convs.agg(F.count("*").alias("n"), F.min("conv").alias("first"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns")).first()
    # The members of all nodes are as many as the turns, so that MANY of them at most are as large as this.
    hot = materialize(nodes.where(F.col("n_convs") >= max(HOT, -(-size.turns // MANY))).select("node", "owner"), "hot-nodes")
    found = materialize(_owners(convs, held, nodes, hot), "owners")
    # Chains: the nodes that one conversation owns, from its first on. A chain hangs on the node before its first, which `above` owns; null is the root.
    own = materialize(nodes.select(F.col("owner").alias("conv"), "depth", "node", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "owned")
    chains = materialize(convs.join(found, "conv").where("n >= first").select("conv", "n", "first", "above"), "chain-tops")
    hang = chains.where("above is not null").select(F.col("above").alias("conv"), (F.col("first") - 1).alias("depth"), F.col("conv").alias("child"))
    at_end = hang.groupBy("conv", "depth").agg(F.count("*").alias("more")).join(chains.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select("conv", "more")
    sums = own.groupBy("conv").agg(F.sum("saved").alias("saved"))
    values = chains.join(sums, "conv").join(at_end, "conv", "left").select("conv", F.col("above").alias("up"), "saved", F.when(F.col("more").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"))
    whole = materialize(_whole_chains(values, ["saved", "leaves"]), "whole-chains")
    hung = hang.join(whole.withColumnRenamed("conv", "child"), "child").groupBy("conv", "depth").agg(F.count("*").alias("more"), F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    each = own.join(hung, ["conv", "depth"], "left").join(chains.select("conv", "n", "first", "above"), "conv")
    last = F.col("depth") == F.col("n")
    each = each.select("conv", "depth", "node", "n_convs", "first", "above", (none("more") + F.when(last, 0).otherwise(1)).alias("n_children"), (F.col("saved") + none("saved_below")).alias("saved"), F.when(last & F.col("more").isNull(), 1).otherwise(none("leaves_below")).alias("leaves"))
    each = running(each, "conv", [F.desc("depth")], {"n_leaves": (F.col("leaves"), "sum"), "saved_tokens": (F.col("saved"), "sum")})
    stops = convs.where("n > 0").join(held.select("conv", F.col("depth").alias("n"), "node"), ["conv", "n"]).select("node", "conv")
    empty = hashlib.sha256(b"").hexdigest()
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.coalesce("above", F.lit(size.first)))
    rest = each.join(ends(stops), "node", "left").select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    # The root: its children are the chains that hang on nothing.
    tops = chains.where("above is null").select("conv").join(whole, "conv").agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    turnless = ends(convs.where("n = 0").select(F.lit("").alias("node"), "conv")).agg(F.max("ends_sha256").alias("ends"))
    root = tops.crossJoin(F.broadcast(turnless)).where(F.lit(size.n > 0)).select(
        F.lit(size.first).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(size.n).cast("bigint").alias("n_convs"), F.col("n").alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("bigint")).alias("n_leaves"), none("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(empty)).alias("ends_sha256"),
    )
    return root.unionByName(rest)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations rebuilt behind shared heads. Rows without a conv_id take no part; null roles and texts are empty."""
    return prefix_trie(*shared_heads(placed(turns(table(spark, sf_dir, "conversations")))))
