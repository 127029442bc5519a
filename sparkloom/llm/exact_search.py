"""Exact top-k search by inner product: pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize, table

#: Rows among which pivots are chosen and first thresholds are found, and pivots. Both bound what the driver holds; results don't depend on them.
SAMPLE, PIVOTS = 1024, 32
#: Bytes of vectors in a packed row, and queries in one; candidates that are evaluated between two looks at the bound.
CHUNK, QUERIES, STEP = 1 << 20, 1024, 256
#: Components are cut to this, so that all arithmetic has an end; scores beyond a long are the nearest long.
FAR = 2**62
_PACKED = "block bigint, n int, ids binary, rows binary, width int, vectors binary, norms binary, distances binary"


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """id and v, floor(scale * x) for every component x, of the rows that take part: those with an id and a vector without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(x * scale).cast("double"), F.lit(-float(FAR))), F.lit(float(FAR))).cast("bigint"))
    return rows.where(fit).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("v"))


def _padded(vectors: list, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one width; missing components are zeros."""
    width = max(map(len, vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width), np.int64)
    for i, x in enumerate(vectors):
        out[i, : min(len(x), width)] = x[:width]
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in the fastest numbers that hold them."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(width, 1)
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width).astype(np.float64), _wide(b, width).astype(np.float64)
    return np.stack([np.sqrt(((a - x) ** 2).sum(axis=1)) for x in b], axis=1) if len(b) else np.zeros((len(a), 0))


def _floor(score):
    """A float that no higher or equal score is below, though longs beyond 2^53 are rounded."""
    return np.where(np.abs(score) < 2.0**53, score, np.nextafter(score, -np.inf))


def pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows of the sample that lie far from one another: each is the one farthest from those before it."""
    if not len(sample):
        return sample
    far = _distances(sample, sample[:1])[:, 0]
    chosen = [0]
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _sample(rows: DataFrame) -> tuple[np.ndarray, list[int]]:
    n = rows.count()
    if n == 0:
        return np.zeros((0, 0), np.int64), []
    drawn = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("row", F.lit(12)), F.lit(1 << 30)) < int(2 * SAMPLE / n * (1 << 30)) + 1)
    got = drawn.limit(SAMPLE).collect()
    return _padded([r.v for r in got]), [r.row for r in got]


def _packs(rows: DataFrame, pivot_rows: np.ndarray, most: int | None = None) -> DataFrame:
    """The pivot table: rows (id, row, v) in packed rows of about CHUNK bytes, each vector with its norm and its distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nums, vectors = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            width = max(map(len, vectors), default=0)
            each = max(1, min(most or b.num_rows, CHUNK // (8 * max(width, 1))))
            for at in range(0, b.num_rows, each):
                x = _padded(vectors[at : at + each])
                d = _distances(x, pivot_rows)
                cols = [ids[at : at + each], nums[at : at + each], x, (x.astype(np.float64) ** 2).sum(axis=1), d]
                one = [c.tobytes() for c in cols]
                yield pa.RecordBatch.from_pylist([{"block": int(nums[at]), "n": len(x), "ids": one[0], "rows": one[1], "width": x.shape[1], "vectors": one[2], "norms": one[3], "distances": one[4]}], schema)

    kinds = [("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary()), ("norms", pa.binary()), ("distances", pa.binary())]
    schema = pa.schema(kinds)
    return in_arrow(rows.select("id", "row", "v"), run, _PACKED)


class _Pack:
    def __init__(self, r: dict, prefix: str):
        n, get = r[f"{prefix}n"], lambda c, kind=np.int64: np.frombuffer(r[prefix + c], kind)
        self.ids, self.rows, self.norms = get("ids"), get("rows"), get("norms", np.float64)
        self.vectors, self.distances = get("vectors").reshape(n, r[f"{prefix}width"]), get("distances", np.float64).reshape(n, -1)
        self.low, self.high = self.distances.min(axis=0), self.distances.max(axis=0)


class _Best:
    """The best candidates of each query of a block so far: the k highest scores, ties to the smaller id, then row."""

    def __init__(self, queries: _Pack, k: int, sample: np.ndarray, sample_rows: np.ndarray):
        self.queries, self.k, self.evaluated = queries, k, 0
        self.found = [(np.zeros(0, np.int64),) * 3 for _ in queries.rows]
        self.least = np.full(len(queries.rows), -np.inf)
        if len(sample_rows) > k:
            # The k-th best of other rows of the sample bounds the k-th best of all from below.
            scores = _scores(queries.vectors, sample).astype(np.float64)
            scores[queries.rows[:, None] == sample_rows[None, :]] = -np.inf
            self.least = _floor(np.partition(scores, len(sample_rows) - k, axis=1)[:, len(sample_rows) - k])

    def take(self, q: int, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        ids, rows, scores = (np.concatenate(x) for x in zip(self.found[q], (ids, rows, scores), strict=True))
        best = np.lexsort((rows, ids, ~scores))[: self.k]
        self.found[q] = ids[best], rows[best], scores[best]
        if len(best) == self.k:
            self.least[q] = max(self.least[q], float(_floor(float(scores[best[-1]]))))

    def search(self, x: _Pack) -> None:
        """Looks through a pack of candidates: by its rings first, then by bounds of rows, best first, until the next bound is below what is wanted."""
        q = self.queries
        # |q - x| is at least the difference of their distances to any pivot, and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2. Slack covers rounding.
        slack = lambda norms: 1.0 + 1e-9 * norms
        ring = np.maximum(np.maximum(q.distances - x.high, x.low - q.distances), 0).max(axis=1, initial=0)
        top = x.norms.max(initial=0)
        reach = lambda norms, away: np.maximum((norms - away**2) / 2 + slack(norms), -(2.0**63))
        open_ = np.flatnonzero(reach(q.norms + top, ring) >= self.least)
        for i in open_:
            gap = np.abs(x.distances - q.distances[i]).max(axis=1, initial=0)
            bound = reach(q.norms[i] + x.norms, gap)
            left = np.flatnonzero((bound >= self.least[i]) & (x.rows != q.rows[i]))
            left = left[np.argsort(-bound[left], kind="stable")]
            for at in range(0, len(left), STEP):
                some = left[at : at + STEP]
                if bound[some[0]] < self.least[i]:
                    break
                self.evaluated += len(some)
                scores = _scores(q.vectors[i : i + 1], x.vectors[some])[0]
                good = scores >= self.least[i]
                self.take(i, x.ids[some[good]], x.rows[some[good]], scores[good])

    def batch(self) -> pa.RecordBatch:
        n = [len(x[0]) for x in self.found]
        joined = [np.concatenate([x[c] for x in self.found]) if self.found else np.zeros(0, np.int64) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.queries.rows, n)), pa.array(np.repeat(self.queries.ids, n)), *map(pa.array, joined)], ["query", "query_id", "vec_id", "row", "score"])


def exact_search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank from 1, vec_id and score: for each row that is_query (of the column id) holds for, the k rows with the highest inner products of floor(scale * x),
    itself left out; ties to the smaller vec_id. All of them where there are fewer.

    Vectors are kept in packed rows with their distances to the pivots, those near the same pivot together. A query skips packs, and rows of the others,
    whose distances to some pivot differ too much for the score that it needs, and evaluates the rest from the best bound down until the next bound can't
    enter. Whole blocks of queries meet whole packs, so that neither side is broadcast or collected, however many there are.

    Rows without an id, and vectors null or holding null or non-finite components take no part. Shorter vectors count as padded with zeros. Rows that repeat an id are
    candidates each, and as queries have k results each. No rows: no results. Other columns are ignored.
    """
    numbers = materialize(whole_numbers(rows, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample, sample_rows = _sample(numbers)
    pivot_rows, sample_ids = pivots(sample), np.array(sample_rows, np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_padded(b.column(2).to_pylist()), pivot_rows)
            place = [pa.array(d.argmin(axis=1) if d.shape[1] else np.zeros(len(d), np.int64), pa.int64()), pa.array(d.min(axis=1, initial=np.inf), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *place], ["id", "row", "v", "pivot", "away"])

    told = in_arrow(numbers.select("id", "row", "v"), near, "id bigint, row bigint, v array<bigint>, pivot bigint, away double")
    sort = ["pivot", "away", "row"]
    packs = materialize(_packs(told.repartitionByRange(*sort).sortWithinPartitions(*sort), pivot_rows), "pivot-table")
    blocks = materialize(_packs(numbers.where(is_query), pivot_rows, QUERIES), "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names) if not c.startswith("q_")}
                at = b.column(b.schema.names.index("q_block"))[i].as_py()
                if at != block:
                    if best:
                        yield best.batch()
                    own = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names) if c.startswith("q_")}
                    best, block = _Best(_Pack(own, "q_"), k, sample, sample_ids), at
                best.search(_Pack(r, ""))
        if best:
            yield best.batch()

    pairs = blocks.select(*[F.col(c).alias(f"q_{c}") for c in blocks.columns]).crossJoin(packs.hint("shuffle_replicate_nl"))
    found = in_arrow(pairs, search, "query bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP12_SQL = """
WITH fit AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
             WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM fit q JOIN fit c ON q.vec_id % 100 = 0 AND c.vec_id != q.vec_id),
     ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
