import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import textindex as ti

def fields():
    return {c: F.filter(F.split(c, " "), lambda t: t != "") for c in "ab"}


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["x", "xa", "xab", "y", "ya", "z", "common", "rare"] + [f"w{i}" for i in range(30)]
    text = lambda: " ".join(["common"] * rng.randint(0, 2) + [rng.choice(words[:7]) for _ in range(rng.randint(0, 5))] + [rng.choice(words) for _ in range(rng.randint(0, 9))])
    rows = [(rng.choice([i, i * 7]) if i < 40 else i, text(), rng.choice([None, "", text()])) for i in range(n)]
    rows = list({r[0]: r for r in rows}.values())
    return [*rows, (-5, "x x x", "y"), (10**12, "xab", None), (None, "x", "x"), (90_001, rows[3][1], rows[3][2])]


def brute(rows, queries, k, weights, floor):
    docs = {i: [[t for t in (x or "").split(" ") if t] for x in (a, b)] for i, a, b in rows if i is not None}
    length = {i: sum(map(len, x)) for i, x in docs.items()}
    n, mean = len(docs), max(1, sum(length.values()) / max(1, len(docs)))
    scores = defaultdict(float)
    for (q, phrase, prefix), times in Counter(queries).items():
        if not phrase:
            continue
        tf = {i: sum(w * sum(t.startswith(phrase) if prefix else t == phrase for t in f) for w, f in zip(weights, x, strict=True)) for i, x in docs.items()}
        df = sum(any(t.startswith(phrase) if prefix else t == phrase for f in x for t in f) for x in docs.values())
        ratio = (n - df + 0.5) / (df + 0.5)
        for i, f in tf.items():
            if f > 0:
                scores[q, i] += times * (max(math.log(ratio), 1e-6) if floor else math.log(1 + ratio)) * 2.2 * f / (f + 1.2 * (0.25 + 0.75 * length[i] / mean))
    best = defaultdict(list)
    for (q, i), s in scores.items():
        best[q].append((-round(s, 9), i))
    return {(q, i): -s for q, found in best.items() for s, i in sorted(found)[:k]}


QUERIES = [(1, "x", False), (1, "common", False), (1, "common", False), (2, "x", True), (2, "y", True), (3, "rare", False), (3, "nowhere", False), (4, "x", False), (4, "x", True), (4, "", False), (5, "nowhere", True), (6, "common", False)]


@pytest.mark.parametrize("span, first, floor, weights", [(4096, 4, False, {}), (8, 1, False, {"a": 2.0}), (8, 2, True, {"b": 0.25}), (1, 1, False, {})])
def test_scores_by_brute_force(spark, tmp_path, monkeypatch, span, first, floor, weights):
    monkeypatch.setattr(ti, "SPAN", span)
    monkeypatch.setattr(ti, "FIRST", first)
    rows = corpus(span, 150)
    frame = lambda x: spark.createDataFrame(x, "id long, a string, b string")
    index = ti.TextIndex.build(frame(rows[:100]), "id", fields(), str(tmp_path / "index"))
    index.append(frame(rows[100:]), "id", fields())
    got = {(r["query"], r.doc): r.score for r in index.search(spark.createDataFrame(QUERIES, "query int, phrase string, prefix boolean"), 5, weights, floor).collect()}
    want = brute(rows, QUERIES, 5, [weights.get("a", 1.0), weights.get("b", 1.0)], floor)
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-8) for x in want)


def test_no_texts_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], "id long, a string, b string")
    index = ti.TextIndex.build(none, "id", fields(), str(tmp_path / "none"))
    asked = spark.createDataFrame(QUERIES, "query int, phrase string, prefix boolean")
    assert index.search(asked).count() == 0
    index.append(none.sparkSession.createDataFrame([(1, "x", None)], none.schema), "id", fields())
    assert [r.doc for r in index.search(asked.where("query = 1")).collect()] == [1] and index.search(asked.where("false")).count() == 0
    with pytest.raises(ValueError, match="has the fields a, b"):
        index.append(none, "id", {"a": fields()["a"]})


def test_bounds_hold_and_prune(spark, tmp_path, monkeypatch):
    """No text scores above the bound of its range, and ranges without good texts aren't unpacked."""
    monkeypatch.setattr(ti, "SPAN", 10)
    rows = [(i, "x " * (5 if i < 20 else 1) + "common", "pad " * (i % 7 + (40 if i >= 20 else 0))) for i in range(400)]
    index = ti.TextIndex.build(spark.createDataFrame(rows, "id long, a string, b string"), "id", fields(), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "x", False)], "query int, phrase string, prefix boolean")
    bounds = {r.span: r.bound for r in index.bounds(asked).collect()}
    every = {r.doc: r.score for r in index.search(asked, 1000).collect()}
    assert len(bounds) == 40 and len(every) == 400 and all(s <= bounds[i // 10] + 1e-9 for i, s in every.items())
    best = sorted(every.values(), reverse=True)[9]
    assert sum(b >= best for b in bounds.values()) == 2


def test_a_search_reads_its_terms_alone(spark, tmp_path):
    """Bytes that a search of a rare word reads are a small part of the index, and don't follow its size."""
    store = spark._jsc.sc().statusStore()

    def read():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.Double.TYPE, 0), None)
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    used = []
    for n in (2000, 20_000):
        docs = spark.range(n).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), (F.xxhash64("id", F.lit(i)) % 5000).cast("string")) for i in range(40)], F.when(F.col("id") % 1000 == 0, "needle")).alias("a"), F.lit(None).cast("string").alias("b"))
        index = ti.TextIndex.build(docs, "id", fields(), str(tmp_path / str(n)))
        postings = index._postings(index.expand(spark.createDataFrame([(1, "needle", False)], "query int, phrase string, prefix boolean")))
        before = read()
        assert postings.where("term = 'needle'").agg(F.sum("n")).first()[0] == n // 1000
        size = sum(f.stat().st_size for f in (tmp_path / str(n) / "postings").rglob("*.parquet"))
        used.append((read() - before, size))
    assert used[1][1] > 2 * used[0][1] and all(0 < u < 0.1 * size for u, size in used)
