"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeats merge into removal intervals.

One narrow pass hashes every window of every text. Hashes and places travel as arrays, a row for each part of the hash space and buffer, and are exploded
behind the shuffle, where Spark sorts the windows of a part by hash and place and keeps those that an equal one comes before. Texts aren't shuffled, but for
those with something to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from .common import id_back, id_key, in_arrow, materialize, partitions_for, table

#: Words in a window.
WINDOW = 20
#: Windows that are combined before they are shuffled, which bounds a worker's memory but for one text; texts that are taken up at once.
BUFFER, TEXTS = 1 << 18, 256
#: Bytes of the input, as files have them, for each shuffle partition of windows, which are about three times as many.
PART = 1 << 26
#: Odd bases of the two polynomial hashes modulo 2^64, over the halves of words' 128-bit hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Rows of a part: hash, id, tag (of the text, which tells apart rows that share an id) and start of each window; last is -1, or else these are
#: runs of windows (start to last) that are known to come late.
SENT = "part int, h array<bigint>, id array<bigint>, tag array<int>, start array<int>, last array<int>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Powers:
    """Powers of an odd base modulo 2^64, from 0 on, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.known):
            self.known = np.full(max(n, 2 * len(self.known)), self.base, np.uint64)
            self.known[0] = 1
            np.multiply.accumulate(self.known, out=self.known)
        return self.known[:n]


_POWERS: dict[int, tuple[_Powers, _Powers]] = {}


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of the values: sums of value times a power of the base, shifted to the same power."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if base not in _POWERS:
        _POWERS[base] = _Powers(base), _Powers(pow(base, -1, 1 << 64))
    powers, inverse = _POWERS[base]
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), dtype=np.uint64, out=prefix[1:])
    return _mix((prefix[size:] - prefix[:n]) * inverse(n))


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads the low bits' weakness of sums modulo 2^64 (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, one a row."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2).T


def _lists(offsets: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c)) for c in columns]


def _by_part(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows in the order that they came in, gathered by their parts."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), *_lists(cuts, *(c[order] for c in columns))], ["part", "h", "id", "tag", "start", "last"])


def _part(spread: np.ndarray, parts: int) -> np.ndarray:
    return ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _combined(held: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[pa.RecordBatch]:
    """Windows (two hashes, id, tag, start) of a buffer. Of equal ones only the earliest goes by its hash, so that a window sends one row a buffer however
    often it occurs; those behind it are known to come late and go as runs, spread by their documents."""
    h, g, key, tag, start = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    shared = np.sort(order[np.r_[same, False] | np.r_[False, same]])  # the few that share a hash with another
    sub = shared[np.lexsort([tag[shared], start[shared], key[shared], g[shared], h[shared]])]
    again = np.zeros(len(sub), bool)
    again[1:] = (h[sub][1:] == h[sub][:-1]) & (g[sub][1:] == g[sub][:-1])
    leader = np.maximum.accumulate(np.where(again, 0, np.arange(len(sub))))
    lead = sub[leader]
    # An equal place, of a row that repeats an id, is not an earlier one; one that repeats the text too is the same row.
    late = again & ((key[sub] != key[lead]) | (start[sub] != start[lead]))
    twin = np.zeros(len(sub), bool)
    twin[1:] = again[1:] & (key[sub][1:] == key[sub][:-1]) & (start[sub][1:] == start[sub][:-1]) & (tag[sub][1:] == tag[sub][:-1])
    goes = np.ones(len(h), bool)
    goes[sub[late | twin]] = False
    yield _by_part(_part(g[goes], parts), h[goes].view(np.int64), key[goes], tag[goes], start[goes], np.full(int(goes.sum()), -1, np.int32))
    known = sub[late & ~twin]
    if len(known):
        known = known[np.lexsort([start[known], tag[known], key[known]])]
        k, t, s = key[known], tag[known], start[known]
        new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)]
        first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(k)] - 1
        spread = _mix(k[first].view(np.uint64) * np.uint64(BASES[0]) + (t[first].astype(np.uint64) << np.uint64(32) | s[first].astype(np.uint64)))
        yield _by_part(_part(spread, parts), spread.view(np.int64), k[first], t[first], s[first], s[last])


def _windows(window: int, parts: int) -> Callable:
    """(id, tag, text) to rows of SENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                for key, tag, text in zip(*(b.column(i).slice(at, TEXTS).to_pylist() for i in range(3)), strict=True):
                    words = words_of(text)
                    if len(words) < window:
                        continue
                    one, two = word_hashes(words)
                    h, size = rolling(one, window, BASES[0]), len(words) - window + 1
                    held.append((h, rolling(two, window, BASES[1]), np.full(size, key, np.int64), np.full(size, tag, np.int32), np.arange(size, dtype=np.int32)))
                    n += size
                    if n >= BUFFER:
                        yield from _combined(held, parts)
                        held, n = [], 0
        if held:
            yield from _combined(held, parts)

    return run


def intervals(runs: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words that runs of windows (start << 32 | last, in any order) cover; what touches is one interval."""
    if not len(runs):
        return []
    runs = np.sort(runs)
    start, last = runs >> 32, np.maximum.accumulate(runs & 0xFFFFFFFF)
    cut = np.flatnonzero(start[1:] > last[:-1] + window)
    return list(zip(start[np.r_[0, cut + 1]].tolist(), (last[np.r_[cut, len(runs) - 1]] + window).tolist(), strict=True))


def _result(words: list[bytes], spans: list[tuple[int, int]], with_text: bool) -> tuple:
    kept, at = [], 0
    for x, y in spans:
        kept += words[at:x]
        at = y
    kept += words[at:]
    text = b" ".join(kept)
    row = (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), [v for span in spans for v in span])
    return (*row, text.decode("utf-8", "replace")) if with_text else row


def _kept(window: int, with_text: bool) -> Callable:
    """(id, text, runs of late windows) to the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()][: 4 + with_text]
        names = ["id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"][: 5 + with_text]
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                runs = part.column(2)
                spans = [intervals(runs[i].values.to_numpy(), window) if runs[i].is_valid else [] for i in range(len(runs))]
                out = [_result(words_of(text), x, with_text) for text, x in zip(part.column(1).to_pylist(), spans, strict=True)]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return run


def late_windows(texts: DataFrame, window: int) -> DataFrame:
    """(id, tag, runs) of texts (id, tag, text): the windows that an equal one comes before, by a smaller id or an earlier start, as start << 32 | last."""
    parts = partitions_for(texts, PART)
    sent = in_arrow(texts, _windows(window, parts), SENT)
    # Parts are numbers of shuffle partitions, of about as many windows each; behind the shuffle one sort serves to find the first of equal windows.
    each = sent.repartitionById(parts, F.col("part")).select("part", F.inline(F.arrays_zip("h", "id", "tag", "start", "last")))
    by = Window.partitionBy("h", "part").orderBy("id", "start").rowsBetween(Window.unboundedPreceding, 0)
    first = each.withColumn("first_id", F.first("id").over(by)).withColumn("first_start", F.first("start").over(by))
    late = first.where("last >= 0 or id <> first_id or start <> first_start")
    run = F.shiftleft(F.col("start").cast("bigint"), 32).bitwiseOR(F.greatest("start", "last").cast("bigint"))
    return late.groupBy("id", "tag").agg(F.collect_list(run).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row: id (key), n_words, n_removed, kept_sha256, removed (flat starts and ends of the removal intervals)
    and, unless with_text is off, kept_text.

    A word goes if a window of `window` consecutive words covers it whose words also start earlier: in a smaller id, or earlier
    in the document. Windows are judged on the input. Null texts have no words, texts shorter than the window keep all;
    null ids are the smallest. Rows that repeat an id are told apart by their texts; equal ones are the same place, not an earlier
    one. An empty table gives no rows; other columns are ignored. Windows are told apart by a 64-bit hash and the part that an independent one
    puts them in: 64 bits and as many as number the shuffle partitions.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(id_key(id_col).alias("id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag"), text.alias("text"))
    late = materialize(late_windows(texts, window), "late-windows")
    key = F.xxhash64("id", "tag")
    blocks = bloom.blocks_for(late.count())
    filt = materialize(bloom.members(late.select(key.alias("key")), "key", blocks), "late-filter")
    flagged = bloom.probe(texts.withColumn("_sl_key", key), filt, blocks, "_sl_key", "_sl_maybe")
    some = flagged.where("_sl_maybe").join(late, ["id", "tag"], "left").select("id", "text", "runs")
    rest = flagged.where("not _sl_maybe").select("id", "text", F.lit(None).cast("array<bigint>").alias("runs"))
    fields = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<bigint>" + ", kept_text string" * with_text
    return in_arrow(some.unionByName(rest), _kept(window, with_text), fields)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select(id_back("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT r, doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS k
    FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words)
), late AS (
    SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1
), gone AS (
    SELECT r, list(DISTINCT p) AS p FROM (SELECT r, unnest(range(s, s + 20)) AS p FROM late) GROUP BY r
), each AS (
    SELECT words.r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, p FROM words LEFT JOIN gone USING (r)
), kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each WHERE p IS NULL OR NOT list_contains(p, i) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""
