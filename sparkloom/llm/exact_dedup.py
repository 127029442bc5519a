"""Exact dedup: two-pass Bloom filtering, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import materialize, numbered, scratch_path, table

#: A text is hot from this many copies on, or from this share of the rows where that is more: so there are at most 1 / HOT_SHARE hot texts.
HOT, HOT_SHARE = 1000, 1e-5


def _sha(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _decided(digests: DataFrame, n: int) -> DataFrame:
    """Written digests (doc_id, tie, _sl_row, text_sha256) with keep_id, group_size and kept, by one filter of n keys.

    Pass one counts the filter's slots, combined on the map side; pass two sends the rows that the filter passes, and the rest go straight through.
    """
    blocks = bloom.blocks_for(n)
    flagged = bloom.probe(digests, bloom.repeated(digests, "text_sha256", blocks), blocks, "text_sha256", "_sl_maybe")
    maybe = materialize(flagged.where("_sl_maybe").drop("_sl_maybe"), "possibly-repeated")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "tie", "_sl_row")).alias("best"), F.count("*").alias("group_size"))
    groups = materialize(groups, "groups")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "_sl_row"]
    told = lambda df: df.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("_sl_row") == F.col("best._sl_row")).alias("kept"), "text_sha256", "_sl_row")
    # Hot groups, which are few, meet their rows by broadcast; the rows of the others are shuffled, no key with more than a bounded share of them.
    hot = groups.where(F.col("group_size") >= max(HOT, int(n * HOT_SHARE)))
    few = told(maybe.join(F.broadcast(hot), "text_sha256"))
    rest = maybe.join(F.broadcast(hot), "text_sha256", "left_anti")
    shared = few.unionByName(told(rest.join(groups, "text_sha256")))
    single = flagged.where("not _sl_maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "_sl_row")
    return shared.select(*out).unionByName(single.select(*out))


def _all_decided(digests: DataFrame) -> DataFrame:
    """_decided() over slices of the hash space that a filter is made for each. A digest is written into its slice, without a shuffle."""
    digests = materialize(digests, "digests")
    n = digests.count()
    slices = bloom.slices_for(n)
    if slices == 1:
        return _decided(digests, n)
    spark, path, out = digests.sparkSession, scratch_path(digests.sparkSession, "sliced-digests"), None
    digests.withColumn("_sl_slice", F.pmod(F.xxhash64("text_sha256", F.lit(2)), F.lit(slices)).cast("int")).write.partitionBy("_sl_slice").parquet(path)
    sliced = spark.read.parquet(path)
    for i in range(slices):
        own_rows = sliced.where(F.col("_sl_slice") == i).drop("_sl_slice")
        part = materialize(_decided(own_rows, own_rows.count()), "decided")
        out = part if out is None else out.unionByName(part)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; null texts count as empty, null ids as the smallest. Where rows repeat
    an id and text, one of them is kept. An empty table gives no rows; other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("bigint").alias("tie"), F.monotonically_increasing_id().alias("_sl_row"), _sha(text_col).alias("text_sha256"))
    return _all_decided(rows).drop("_sl_row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts (null: empty) the one with the largest id (null: the smallest).

    Ties of rows with one id and text go to the row with the largest hash of all columns. Rows are written once with a number; digests decide which numbers
    go, and of the texts only those that the filter of these numbers passes are shuffled.
    """
    rows = numbered(docs, "exact-rows")
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    told = _all_decided(rows.select(F.col(id_col).alias("doc_id"), tie.alias("tie"), "_sl_row", _sha(text_col).alias("text_sha256")))
    gone = materialize(told.where("not kept").select(F.col("_sl_row").alias("_sl_gone")), "repeated-rows")
    return bloom.without(rows, "_sl_row", gone, "_sl_gone").drop("_sl_row")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
