"""Context packs for tasks: pieces of files in tiers, each range once, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import utf8_prefix
from .graph import cut

# Tiers in order, lines around a definition and around another symbol, and the most tokens of a pack.
TIERS = ["mandatory", "likely", "optional"]
AROUND_DEFINITION, AROUND_SYMBOL = 2, 1
MOST = 1500
#: White space that a clipped text doesn't end with.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def tokens(text: Column) -> Column:
    """Four bytes a token."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def candidates(definitions: DataFrame, symbols: DataFrame, affected: DataFrame, key: str) -> DataFrame:
    """(key, path, start, end, tier): ranges of lines that may go into each pack, each range once.

    Definitions (key, path, line, end_line) are mandatory; other symbols (same columns) likely where their path is one of those affected (key, path), else optional. A null
    end is the line itself, a null line the first. A range that several give is of its best tier; that is an aggregate, so copies combine before the shuffle.
    """

    def ranges(df: DataFrame, around: int, tier: Column) -> DataFrame:
        line = F.coalesce("line", F.lit(1))
        return df.select(key, "path", F.greatest(line - around, F.lit(1)).cast("bigint").alias("start"), (F.coalesce("end_line", line) + around).cast("bigint").alias("end"), tier.alias("_tier"))

    hit = symbols.join(affected.select(key, "path").distinct().withColumn("_hit", F.lit(1)), [key, "path"], "left")
    rows = ranges(definitions, AROUND_DEFINITION, F.lit(0)).unionByName(ranges(hit, AROUND_SYMBOL, F.when(F.col("_hit").isNotNull(), 1).otherwise(2)))
    once = rows.groupBy(key, "path", "start", "end").agg(F.min("_tier").alias("_tier"))
    return once.select(key, "path", "start", "end", F.get(F.array(*map(F.lit, TIERS)), F.col("_tier")).alias("tier"))


def excerpts(ranges: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """The ranges with their text and tokens, from the lines of files (path, line, text): a join by path and block of lines, so that long files split and no
    line meets ranges that are far from it."""
    block = 64
    ranges = cut(ranges)
    low, high = ranges.agg(F.min("start"), F.max("end")).first()
    lines = lines.where(F.col("line").between(low or 0, high or 0))  # what no range comes near isn't shuffled
    wide = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    rows = lines.select("path", F.col("line").cast("bigint").alias("_line"), F.col("text").alias("_text"), F.floor(F.col("line") / block).alias("_block"))
    met = wide.join(rows, ["path", "_block"]).where(F.col("_line").between(F.col("start"), F.col("end")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", F.coalesce("_text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return met.groupBy(key, "path", "start", "end", "tier").agg(text.alias("text")).withColumn("tokens", tokens(F.col("text")))


def packed(items: DataFrame, key: str, budget: int, most: int = MOST) -> DataFrame:
    """(key, path, start, end, tier, text, tokens, clipped) of the items (without clipped) that each pack takes within min(budget, most) tokens.

    By tier, then the smallest first, then path and start. As items of a tier come by size, the first that doesn't fit ends the tier: what is taken whole are running sums over
    windows, tier by tier, each on what the one before left. An item has a token at least, so that only so many of a key's smallest can count, however many it has: those are chosen in
    parts of a key first. Mandatory items that don't fit are clipped to what is left, one after the other, without white space at
    the end; those that leave nothing are passed over. Those that may count are folded as one array of texts of no more than the budget each.
    """
    if budget < 256:
        raise ValueError("a pack has at least 256 tokens")
    room = min(budget, most)
    order = ["tokens", "path", "start", "end"]
    cols = [key, "path", "start", "end", "tier", "text", "tokens"]
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    items = items.where(F.col("tier").isin(TIERS)).select(*cols)
    items = cut(_smallest(items.where("tokens > 0"), key, order, room).unionByName(items.where("tokens = 0")))
    tier = lambda name: items.where(F.col("tier") == name).withColumn("_sum", F.sum("tokens").over(upto))

    first = tier(TIERS[0])
    taken = first.where(F.col("_sum") <= room).drop("_sum").withColumn("clipped", F.lit(False))
    clipped = _clipped(first, key, room, order, cols)
    taken = taken.unionByName(clipped)
    for name in TIERS[1:]:
        used = taken.groupBy(key).agg(F.sum("tokens").alias("_used"))
        end = F.col("_sum") + F.coalesce("_used", F.lit(0))
        fit = tier(name).join(used, key, "left").where((end <= room) & (end - F.col("tokens") < room))
        taken = taken.unionByName(fit.select(*cols, F.lit(False).alias("clipped")))
    return taken


def _smallest(items: DataFrame, key: str, order: list[str], room: int) -> DataFrame:
    """The items of at least a token that a pack of so much room may take.

    What is taken whole is among the first `room` items. Items to clip are all behind those; one gives a text only where the room left holds its first letter that isn't
    white space. Items before it that need no more room for theirs gave texts too, of a token at least: there are fewer than `room`. So the first 2 x room of each such need are enough.
    """
    bare = F.ltrim("text", F.lit(SPACE))
    need = F.when((F.col("tier") != TIERS[0]) | (bare == ""), 0).otherwise(F.ceil((F.octet_length("text") - F.octet_length(bare) + F.octet_length(F.left(bare, F.lit(1)))) / 4))
    of = [key, "tier", "_need"]
    place = lambda *by: F.row_number().over(Window.partitionBy(*of, *by).orderBy(*order))
    dealt = items.withColumn("_need", need.cast("bigint")).withColumn("_salt", F.pmod(F.xxhash64("path", "start", "end"), F.lit(64)))
    few = dealt.withColumn("_place", place("_salt")).where(F.col("_place") <= 2 * room)
    return few.withColumn("_place", place()).where(F.col("_place") <= 2 * room).drop("_place", "_salt", "_need")


def _clipped(first: DataFrame, key: str, room: int, order: list[str], cols: list[str]) -> DataFrame:
    """Mandatory items beyond the first that doesn't fit, cut to what is left. A row's text has no more than the room's bytes in the fold."""
    whole = first.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_sum") <= room, F.col("_sum"))), F.lit(0)).alias("_whole"))
    over = first.where((F.col("_sum") > room) & (F.col("tokens") > 0)).withColumn("text", utf8_prefix(F.col("text"), 4 * room))
    row = F.struct(*order, "text")
    folded = over.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_rows")).join(whole, key)
    text = lambda left, x: F.when(left <= 0, "").otherwise(F.rtrim(F.coalesce(*[F.try_validate_utf8(F.substring(x["text"].cast("binary"), F.lit(1), (4 * left - i).cast("int")).cast("string")) for i in range(4)]), F.lit(SPACE)))
    zero = F.struct((F.lit(room) - F.col("_whole")).cast("bigint").alias("left"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        t = text(a["left"], x)
        return F.struct((a["left"] - tokens(t)).alias("left"), F.concat(a["out"], F.array(t)).alias("out"))

    texts = F.aggregate("_rows", zero, step)["out"]
    out = folded.select(key, F.explode(F.arrays_zip(F.col("_rows").alias("r"), texts.alias("t"))).alias("_x")).where("_x.t <> ''")
    made = {"tier": F.lit(TIERS[0]), "text": F.col("_x.t"), "tokens": tokens(F.col("_x.t"))}
    return out.select(key, *[made.get(c, F.col(f"_x.r.{c}")).alias(c) for c in cols[1:]], F.lit(True).alias("clipped"))


def recoverable(affected: DataFrame, pack: DataFrame, key: str) -> DataFrame:
    """(key, path): affected paths of which the pack has nothing."""
    return affected.select(key, "path").distinct().join(pack.select(key, "path").distinct(), [key, "path"], "left_anti")
