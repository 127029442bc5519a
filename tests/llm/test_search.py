import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_search as es

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, `row` string, block string, score string"


def frame(spark, rows):
    """Vectors with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, 1, "a", None, "b", "c", "d") for i, v in rows], SCHEMA)


def brute(rows, is_query, k=10):
    """Exact results in Python integers; repeated ids are rows of their own."""
    near = lambda s: max(-(2**63), min(2**63 - 1, s))
    fit = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(fit):
        if is_query(i):
            scored = sorted((-near(sum(a * b for a, b in zip(q, v))), j) for m, (j, v) in enumerate(fit) if m != n)[:k]  # noqa: B905
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, mod, k=10):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in es.exact_search(frame(spark, rows), F.col("id") % mod == 0, k=k).collect())


def vectors(seed, n, spread):
    rng = np.random.default_rng(seed)
    homes = rng.normal(size=(8, 12))
    return [[float(x) for x in homes[i % 8] + spread * rng.normal(size=12)] for i in range(n)]


@pytest.mark.parametrize("sample, chunk, queries, step", [(1024, 1 << 20, 1024, 256), (20, 800, 3, 2), (1, 200, 1, 1)])
def test_results_by_brute_force(spark, monkeypatch, sample, chunk, queries, step):
    for name, value in (("SAMPLE", sample), ("CHUNK", chunk), ("QUERIES", queries), ("STEP", step)):
        monkeypatch.setattr(es, name, value)
    rows = list(enumerate(vectors(1, 120, 0.1)))
    rows += [(200 + i, rows[7][1]) for i in range(15)] + [(7, rows[3][1]), (0, rows[0][1]), (300, [0.0] * 12), (301, []), (310, [0.5, -0.5]), (None, rows[1][1]), (302, None), (310, [1.0, None]), (320, [float("nan")] * 12), (330, [float("inf")]), (-10, rows[5][1])]
    random.Random(0).shuffle(rows)
    assert found(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_few_rows_and_none(spark):
    assert found(spark, [], 1) == [] and found(spark, [(0, [1.0])], 1) == []
    rows = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert found(spark, rows, 1) == brute(rows, lambda i: True)


def test_huge_components_are_exact(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [3e9, 0.0]), (3, [-2e9, 1e3]), (4, [1e9, 3.0])]
    assert found(spark, rows, 1, k=3) == brute(rows, lambda i: True, k=3)
    assert {r[3] for r in found(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])], 1)} == {2**63 - 1, -(2**63)}


def test_pivots_leave_most_rows_of_clusters_unread():
    """In clusters a query evaluates few of the rows."""
    x = es._padded([[int(1024 * a) for a in v] for v in vectors(3, 4000, 0.02)])
    pivot_rows = es.pivots(x[:200])
    pack = lambda rows: {"n": len(rows), "ids": rows.tobytes(), "rows": rows.tobytes(), "width": 12, "vectors": x[rows].tobytes(), "norms": (x[rows].astype(float) ** 2).sum(axis=1).tobytes(), "distances": es._distances(x[rows], pivot_rows).tobytes()}
    some = np.arange(16)
    best = es._Best(es._Pack({f"q_{c}": y for c, y in pack(some).items()}, "q_"), 10, x[:0], some[:0])
    for home in range(8):
        best.search(es._Pack(pack(np.arange(home, 4000, 8)), ""))
    scores = x[some] @ x.T
    scores[some, some] = -(2**62)
    for i in some:
        want = sorted(zip(-scores[i], range(4000), strict=True))[:10]
        assert [(-s, j) for s, j in want] == [(int(s), int(j)) for j, s in zip(best.found[i][0], best.found[i][2], strict=True)]
    assert best.evaluated < 0.6 * 16 * 4000
