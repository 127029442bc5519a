"""SimHash near-dedup by anchor-point covering: anchors are pairs of Golay codewords."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import without
from .common import id_back, id_key, in_arrow, local_components, materialize, numbered, table
from .components import connected_components

#: The binary Golay code: length, generator polynomial (x^11+x^10+x^6+x^5+x^4+x^2+1), covering radius. It is perfect.
LENGTH, GENERATOR, RADIUS = 23, 0b110001110101, 3
#: Fingerprints link at this many differing bits.
THRESHOLD = 2
#: Words in a shingle, and the seed of their hash.
SHINGLE, SEED = 3, 42
#: Most home fingerprints of an anchor that one task holds; anchors with more are salted.
MAX_HOMES = 20_000
#: Fingerprints that one task copies to their anchors.
SPREAD = 100_000
#: Pairs compared at once, and links kept before they are merged into a forest.
PAIRS, LINKS = 1 << 21, 1 << 20


def fingerprint(text: str | None) -> int:
    """64-bit SimHash: A-Z lower-cased, ASCII white space between words, 3-word shingles with repeats; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = ends - lens + 1
    n = max(1, len(words) - SHINGLE + 1)
    stops = ends[min(SHINGLE, len(words)) - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        pairs = zip(starts[at : min(n, at + (1 << 16))].tolist(), stops[at : at + (1 << 16)].tolist(), strict=False)
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator, 11 bits."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def _cosets() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndromes of all 23-bit words' low and high parts are linear, so a table by word serves; then for each excess e over the
    radius (0, 1, 2) the error patterns by syndrome: starts, counts, patterns. A word XOR such a pattern is a codeword."""
    single = _syndrome(1 << np.arange(LENGTH))
    by_excess = []
    for excess in range(THRESHOLD + 1):
        weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        patterns = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(LENGTH), w)], np.int64)
        order = np.argsort(s := _syndrome(patterns), kind="stable")
        counts = np.bincount(s, minlength=2048)
        by_excess.append((np.cumsum(counts) - counts, counts, patterns[order]))
    return single, by_excess


def _fold(words: np.ndarray) -> np.ndarray:
    """Syndromes by the sum of the single bits' syndromes."""
    single, _ = _cosets()
    out = np.zeros(len(words), np.int64)
    for bit in range(LENGTH):
        out ^= np.where(words >> bit & 1, single[bit], 0)
    return out


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fps.view(np.uint64)
    mask = np.uint64((1 << LENGTH) - 1)
    return (bits & mask).astype(np.int64), ((bits >> np.uint64(LENGTH)) & mask).astype(np.int64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors that the int64 fingerprints are copied to: index of the fingerprint, anchor, whether it is its home.

    An anchor is a pair of codewords for bits 0-22 and 23-45. A fingerprint's home is its nearest pair, at most 3 away in each
    half. Any fingerprint that differs from it in a and b bits of the halves, a + b <= 2, is within 3 + a and 3 + b
    of that anchor, hence copied there: every pair within the threshold meets at the homes of both.
    """
    low, high = _halves(fps)
    s1, s2 = _fold(low), _fold(high)
    _, table_ = _cosets()
    rows, keys, home = [], [], []
    for i, (starts1, counts1, errors1) in enumerate(table_):
        for j, (starts2, counts2, errors2) in enumerate(table_[: THRESHOLD + 1 - i]):
            n1, n2 = counts1[s1], counts2[s2]
            row = np.repeat(np.arange(len(fps)), n := n1 * n2)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            c1 = low[row] ^ errors1[starts1[s1[row]] + at // n2[row]]
            c2 = high[row] ^ errors2[starts2[s2[row]] + at % n2[row]]
            rows.append(row)
            keys.append(c1 << LENGTH | c2)
            home.append(np.full(len(row), i + j == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of an id, a text and other columns, which go along."""
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["id", "fp", *b.schema.names[2:]])


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        low, high = _halves(fps)
        starts, _, errors = _cosets()[1][0]
        key = (low ^ errors[starts[_fold(low)]]) << LENGTH | high ^ errors[starts[_fold(high)]]
        yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            row, key, home = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array((~home).astype(np.int8))], ["key", "fp", "visit"])


class _Forest:
    """Links of one task, kept as a spanning forest."""

    def __init__(self):
        self.u, self.v, self.n = [], [], 0

    def add(self, u, v):
        self.u.append(u)
        self.v.append(v)
        self.n += len(u)
        if self.n > LINKS:
            self.merge()

    def merge(self):
        if self.u:
            nodes, roots = local_components(np.concatenate(self.u), np.concatenate(self.v))
            keep = nodes != roots
            self.u, self.v, self.n = [nodes[keep]], [roots[keep]], 0
        return self


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in the order of (key, salt), homes first: compares the homes of each anchor with all that are there. Holds the homes of one anchor and a forest
    of the task's links; what visits streams past."""
    forest = _Forest()
    at, homes = None, np.empty(0, np.int64)  # of the anchor that the last batch ended in
    for b in batches:
        key, salt, fp, visit = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        new = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        counts = np.bincount(group, weights=visit == 0, minlength=len(first)).astype(np.int64)
        carried = len(homes) if at == (key[0], salt[0]) else 0
        pool = np.concatenate([homes[:carried], fp])
        starts = first + carried
        starts[0] = 0
        counts[0] += carried
        rows = np.flatnonzero(counts[group] > (visit == 0))  # else its own home alone
        n = counts[group[rows]]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            m = n[lo:hi]
            r = np.repeat(rows[lo:hi], m)
            k = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
            x, y = fp[r], pool[starts[group[r]] + k]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= THRESHOLD
            near &= x != y
            if near.any():
                forest.add(x[near], y[near])
            lo = hi
        last = first[-1]
        homes = pool[starts[-1] : starts[-1] + counts[-1]].copy()
        at = (key[last], salt[last])
    forest.merge()
    for u, v in zip(forest.u, forest.v, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["src", "dst"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): every row's id key and fingerprint as a signed long."""
    return in_arrow(docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string")), _fingerprints, "id bigint, fp bigint")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(src, dst): links between different fingerprints (column fp, distinct) at most THRESHOLD bits apart, as forests of tasks that keep every connection.

    Each fingerprint has one home anchor and about 61 copies of 17 bytes. There are 2^24 anchors, so that n fingerprints that are spread evenly make about
    61 n^2 / 2^24 comparisons: copies grow in proportion to n, and beyond some 10^9 fingerprints comparisons outgrow them. An anchor with more
    than MAX_HOMES homes gets salts: its homes are dealt out among them and what visits goes to all, so that no task holds more.
    """
    homes = in_arrow(distinct, _homes, "key bigint").groupBy("key").count()
    hot = materialize(homes.where(F.col("count") > MAX_HOMES).select("key", F.ceil(F.col("count") / MAX_HOMES).cast("int").alias("salts")), "hot-anchors")
    # Each row becomes about 61, so that tasks take a bounded number of them.
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // SPREAD))
    copies = in_arrow(distinct.repartition(tasks), _copies, "key bigint, fp bigint, visit tinyint")
    spread = copies.join(hot, "key", "left") if hot.take(1) else copies.withColumn("salts", F.lit(None).cast("int"))
    own = F.when(F.col("salts").isNull(), F.array(F.lit(0)))
    one = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    # A home is also seen by the homes under other salts.
    rows = spread.select("key", F.explode(F.coalesce(own, F.sequence(F.lit(0), F.col("salts") - 1))).alias("salt"), "fp", F.when(F.col("salts").isNotNull() & (F.col("visit") == 0) & (F.col("salt") != one), F.lit(1).cast("tinyint")).otherwise(F.col("visit")).alias("visit"))
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "visit")
    return in_arrow(rows.select("key", "salt", "fp", "visit"), _compare, "src bigint, dst bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): each row's id key, fingerprint and the smallest id that links reach.

    Null texts count as empty (fingerprint zero, linked like any other); null ids count as the smallest id. Rows that repeat an
    id are told apart by nothing and share its component. An empty table gives no rows; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    linked = connected_components(fingerprint_links(least.select("fp")))
    joined = least.join(linked, least.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(joined.join(roots, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def near_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one of each group of near copies: that of the smallest id (null ids are the smallest, ties go by the text's hash).

    Each row is decided on its own, by a key that is written with it: ids may repeat or be null.
    """
    rows = numbered(docs, "near-rows")
    text = F.col(text_col).cast("string")
    fps = in_arrow(rows.select(id_key(id_col).alias("id"), text, F.xxhash64(text).alias("tie"), "_sl_row"), _fingerprints, "id bigint, fp bigint, tie bigint, _sl_row bigint")
    fps = materialize(fps, "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min(F.struct("id", "tie", "_sl_row")).alias("first")), "distinct-fingerprints")
    linked = connected_components(fingerprint_links(least.select("fp")))
    joined = least.join(linked, least.fp == linked.node, "left").select("first", F.coalesce("component", "fp").alias("root"))
    stay = joined.groupBy("root").agg(F.min("first").alias("first")).select("first._sl_row")
    gone = materialize(fps.select("_sl_row").join(stay, "_sl_row", "left_anti").withColumnRenamed("_sl_row", "_sl_gone"), "near-copies")
    return without(rows, "_sl_row", gone, "_sl_gone").drop("_sl_row")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its group of near copies."""
    groups = near_groups(docs, id_col, text_col)
    gone = materialize(groups.where("id != component").select(F.col("id").alias("_sl_gone")).distinct(), "near-copies")
    keyed = materialize(docs.withColumn("_sl_key", id_key(id_col)), "near-keyed")
    return without(keyed, "_sl_key", gone, "_sl_gone").drop("_sl_key")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(id_back("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), id_back("component").alias("component_id"))
