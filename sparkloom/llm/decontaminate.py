"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_back, id_key, in_arrow, materialize, table

#: Words in a shingle, and the containment from which on an item counts as found.
SHINGLE, THRESHOLD = 5, 0.8
#: Items and letters in a block of the stated query set; one block is on the driver and the executors at a time. A letter becomes some 20 bytes of shingles (50 where words
#: have one letter), so that what is broadcast is about 120 MB, or one item where that alone is longer.
ITEMS, LETTERS = 20_000, 6_000_000
#: Letters and digits, as the pattern [\p{L}\p{N}]+ has them.
TOKEN = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def shingles(words: list[str], size: int = SHINGLE) -> set[str]:
    """Distinct shingles; fewer words than the size are one shingle, no words are none."""
    if not words:
        return set()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _word_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def shingle_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, by their words' hashes."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ values[i : i + n]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return out


class Part:
    """The items of one size class, 2^(k-1) to 2^k - 1 distinct shingles, and what the class is searched with.

    An item's MinHash sketch is its `missing + need` least hashes, where missing is how many shingles it may lack at the threshold and need grows with
    the class: an item that is contained has at least `need` hashes of its sketch in the document. A document's sketch for the class is all its hashes
    up to the largest that any item's sketch has (`bound`): the least part of its hashes, however long it is.
    """

    def __init__(self, size: int, k: int, items: list[tuple[int, np.ndarray]], threshold: float):
        self.size, self.need = size, max(1, (1 << k - 1) // 8)
        sketches, owners = [], []
        self.wanted: dict[int, int] = {}
        for at, hashes in items:
            missing = int((1 - threshold) * len(hashes) + 1e-9)
            length = min(len(hashes), missing + self.need)
            sketches.append(hashes[:length])
            owners.append(np.full(length, at))
            self.wanted[at] = max(1, length - missing)
        h, o = np.concatenate(sketches), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners, self.bound = h[order], o[order], h.max()

    def candidates(self, own: np.ndarray) -> Iterator[int]:
        """Items of which a document with these sorted distinct hashes has as many sketch hashes as a contained one must."""
        sketch = own[: np.searchsorted(own, self.bound, "right")]
        if len(sketch) < len(self.hashes):
            lo, hi = np.searchsorted(self.hashes, sketch, "left"), np.searchsorted(self.hashes, sketch, "right")
            hit = hi > lo
            found = [self.owners[a:b] for a, b in zip(lo[hit].tolist(), hi[hit].tolist(), strict=True)]
            owners = np.concatenate(found) if found else self.owners[:0]
        else:
            at = np.searchsorted(sketch, self.hashes)
            owners = self.owners[sketch[np.minimum(at, len(sketch) - 1)] == self.hashes]
        items, n = np.unique(owners, return_counts=True)
        for item, shared in zip(items.tolist(), n.tolist(), strict=True):
            if shared >= self.wanted[item]:
                yield item


class Index:
    """MinHash sketches of items in parts by size (items of fewer words than a shingle: by their number of words). No contained item is missed."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items = [(key, shingles(words), min(SHINGLE, len(words))) for key, text in items if (words := tokens(text))]
        found: dict[tuple[int, int], list] = {}
        for at, (_, own, size) in enumerate(self.items):
            # Distinct shingles with one hash count once in the sketch, as they do in a document's.
            hashes = np.unique(np.array([int(shingle_hashes(_word_hashes(x.split(" ")), size)[0]) for x in own], np.uint64))
            found.setdefault((size, len(own).bit_length()), []).append((at, hashes))
        self.parts = [Part(size, k, members, threshold) for (size, k), members in sorted(found.items())]

    def candidates(self, values: np.ndarray) -> set[int]:
        by_size: dict[int, np.ndarray] = {}
        out: set[int] = set()
        for part in self.parts:
            if part.size not in by_size:
                by_size[part.size] = np.unique(shingle_hashes(values, part.size))
            out.update(part.candidates(by_size[part.size]))
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, shared shingles, the item's shingles) of the items contained in the text."""
        words = tokens(text)
        if not words:
            return []
        out, own = [], {}
        for at in sorted(self.candidates(_word_hashes(words))):
            key, of_item, size = self.items[at]
            if size not in own:
                own[size] = {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
            shared = len(of_item & own[size])
            if shared >= self.threshold * len(of_item) - 1e-9:
                out.append((key, shared, len(of_item)))
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ITEMS and LETTERS, one on the driver at a time; an item of more letters is a block of its own."""
    block: list = []
    held = 0
    for row in items.toLocalIterator():
        n = len(row[1] or "")
        if block and (len(block) == ITEMS or held + n > LETTERS):
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += n
    if block:
        yield block


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and contained item: id (key), item_id, n_shared, n_item.

    Words are runs of letters and digits in lower case; shingles of five words are sets; an item of fewer words is one shingle,
    held against the document's runs of as many words. Containment is the share of the item's shingles that the
    document has, anywhere in the whole text. Null and empty texts contain nothing and are contained nowhere; null ids pass; items
    that repeat an id count separately. Empty tables give no rows; other columns are ignored. The items are a stated query set:
    each block of ITEMS and LETTERS at most is broadcast and held against all documents in a narrow pass without a shuffle. What a block finds is written before the next one
    takes its place, so that no more than one is held.
    """
    rows = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    queries = items.select(F.col(item_col).cast("bigint"), F.col(item_text_col).cast("string"))
    schema = "id bigint, item_id bigint, n_shared bigint, n_item bigint"
    out = sent = None
    for block in _blocks(queries):
        if sent is not None:
            out = materialize(out, "contaminated")
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, threshold))
        part = in_arrow(rows, _finder(sent), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            found = [(key, *x) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in index.search(text)]
            cols = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item_id", "n_shared", "n_item"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that contain no item; each row on its own, ids may repeat or be null.

    Each block of items is a narrow pass that filters the rows; between two blocks what stayed is written, so that one index is held at a time.
    """
    out, at, sent = docs, docs.columns.index(text_col), None
    for block in _blocks(items.select(F.col(item_col).cast("bigint"), F.col(item_text_col).cast("string"))):
        if sent is not None:
            out = materialize(out, "clean-rows")
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, threshold))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                yield b.filter(pa.array([not index.search(text) for text in b.column(at).cast(pa.large_string()).to_pylist()], pa.bool_()))

        out = in_arrow(out, run, docs.schema)
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(id_back("id").alias("doc_id"), "item_id", "n_shared", "n_item")


OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), i AS (
    SELECT item_id, w, least(5, len(w)) AS size FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark)
    WHERE len(w) > 0
), si AS (
    SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS k
    FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM i)
), sizes AS (
    SELECT DISTINCT size FROM i
), sd AS (
    SELECT DISTINCT doc_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS k
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), n AS (
    SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS n_shared, n_item
FROM sd JOIN si USING (size, k) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item
HAVING count(*) >= 0.8 * n_item
"""
