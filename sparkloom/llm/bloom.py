"""Blocked Bloom filters as DataFrames, one row a block: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own

#: Bits in a block, as many as bitmap_construct_agg() keeps in its 4 KiB.
BLOCK = 32768
#: Filter bits for each key, and the most blocks of a filter, which bound what is broadcast to 32 MiB whatever the input. More keys than such a
#: filter is made for are worked through in slices, each with a filter of its own, so that none fills up.
BITS_EACH, MAX_BLOCKS = 16, 8192


def blocks_for(keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-keys * BITS_EACH // BLOCK)))


def slices_for(keys: int) -> int:
    return max(1, -(-keys * BITS_EACH // (BLOCK * MAX_BLOCKS)))


def _slots(key: str, blocks: int) -> list[Column]:
    """The block of a key, and its two bit positions there."""
    h = F.xxhash64(F.col(key))
    return [F.pmod(h, F.lit(blocks)), F.pmod(F.shiftrightunsigned(h, 17), F.lit(BLOCK)), F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(BLOCK))]


def _hits(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    block, one, two = _slots(key, blocks)
    return keys.select(block.alias("block"), F.explode(F.array_distinct(F.array(one, two))).alias("slot"))


def repeated(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of the slots that two or more rows hit: a key that occurs twice hits both its slots twice, so that it always passes.

    What is shuffled are counts of slots, combined on the map side, never rows.
    """
    hits = _hits(keys, key, blocks).groupBy("block", "slot").count().where("count >= 2")
    return hits.groupBy("block").agg(F.bitmap_construct_agg(F.col("slot")).alias("bits"))


def members(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of the keys' slots. Blocks combine on the map side."""
    return _hits(keys, key, blocks).groupBy("block").agg(F.bitmap_construct_agg(F.col("slot")).alias("bits"))


def _bit(bits: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (slot % 8).cast("int")) == 1


def probe(df: DataFrame, filt: DataFrame, blocks: int, key: str, flag: str) -> DataFrame:
    """df with a boolean column flag that is false only where the filter surely lacks the key."""
    block, one, two = _slots(key, blocks)
    side = filt.select(F.col("block").alias("_sl_block"), F.col("bits").alias("_sl_bits"))
    hit = _bit(F.col("_sl_bits"), one) & _bit(F.col("_sl_bits"), two)
    out = df.join(F.broadcast(side), block == F.col("_sl_block"), "left")
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_sl_block", "_sl_bits")


def _without(df: DataFrame, key: str, gone: DataFrame, gone_key: str, n: int) -> DataFrame:
    blocks = blocks_for(n)
    filt = materialize(members(gone, gone_key, blocks), "gone-filter")
    flagged = probe(df, filt, blocks, key, "_sl_maybe")
    maybe = flagged.where("_sl_maybe").join(gone.select(F.col(gone_key).alias("_sl_gone")), F.col(key) == F.col("_sl_gone"), "left_anti")
    return flagged.where("not _sl_maybe").select(*own(df)).unionByName(maybe.select(*own(df)))


def without(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """The rows of df, all columns, whose key (a bigint column without nulls) is not in gone. Both are written already.

    Only rows that the filter of the gone keys passes are anti-joined, all others go straight through. Where gone has more keys than a filter is made
    for, ranges of keys are worked through with a filter each; df's row numbers ascend in its files, so that a range reads its own files alone.
    """
    n = gone.count()
    slices = slices_for(n)
    cuts = sorted({int(x) for x in gone.approxQuantile(gone_key, [i / slices for i in range(1, slices)], 0.2 / slices)}) if slices > 1 else []
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = lambda c: (F.lit(True) if low is None else F.col(c) >= low) & (F.lit(True) if high is None else F.col(c) < high)  # noqa: B023, E731
        own_gone = gone.where(inside(gone_key))
        part = _without(df.where(inside(key)), key, own_gone, gone_key, n if not cuts else own_gone.count())
        out = part if out is None else out.unionByName(part)
    return out
