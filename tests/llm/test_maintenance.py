import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import join_view as jv

SCHEMA = "k long, a string, b int, n long, key string, l string, place string, m long"


def frame(spark, rows):
    """Counted rows with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*x, "x", None, "y", 5) for x in rows], SCHEMA)


def joined(left, right):
    """The full outer join of two counters of (key, part), as a counter of (key, left part, right part)."""
    out = Counter()
    for (k, p), n in left.items():
        found = [(q, m) for (j, q), m in right.items() if j == k and k is not None and m]
        for q, m in found or [(None, 1)]:
            out[k, p, q] += n * m
    for (k, q), m in right.items():
        if k is None or not any(j == k and n for (j, _), n in left.items()):
            out[k, None, q] += m
    return Counter({x: n for x, n in out.items() if n})


def batches(seed, keys, rounds):
    """Random changes of both sides that never take away what isn't there."""
    rng = random.Random(seed)
    sides = [Counter(), Counter()]
    for t in range(rounds):
        change = [Counter(), Counter()]
        for side in (0, 1):
            for _ in range(rng.choice([0, 6, 25]) if t else 20):
                if rng.random() < 0.55 or not sides[side]:
                    x = rng.choice(keys), (rng.choice([None, "p", "q", "", "r"]), rng.choice([None, 0, 1]))
                    n = rng.choice([1, 1, 2])
                else:
                    x, n = rng.choice(list(sides[side])), -1
                change[side][x] += n
                sides[side][x] += n
                if not sides[side][x]:
                    del sides[side][x]
        yield change, [Counter(s) for s in sides]


def told(row):
    return row.key, row.l and tuple(row.l), row.r and tuple(row.r)


@pytest.mark.parametrize("seed, keys, salts, logs", [(0, [1, 2, 3, None], 16, 16), (1, [7], 3, 2), (3, [None, 5, *range(10)], 1, 1)])
def test_view_follows_its_tables(spark, monkeypatch, seed, keys, salts, logs):
    monkeypatch.setattr(jv, "SALTS", salts)
    monkeypatch.setattr(jv, "LOGS", logs)
    view, before = None, Counter()
    for change, sides in batches(seed, keys, 4):
        bags = [jv.bag(frame(spark, [(k, *p, n) for (k, p), n in c.items()]), "k", ["a", "b"], "n") for c in change]
        after = joined(*sides)
        if view is None:
            view = jv.JoinView(*bags)
        else:
            got = view.apply(*bags).collect()
            assert len({told(r) for r in got}) == len(got)
            assert {told(r): (r.weight, r.total) for r in got} == {x: (after[x] - before[x], after[x]) for x in after.keys() | before.keys() if after[x] != before[x]}
        before = after
    assert {told(r): r.n for r in view.rows().collect()} == dict(before)


def test_empty_tables_and_batches(spark):
    none = jv.bag(frame(spark, []), "k", ["a", "b"], "n")
    one = jv.bag(frame(spark, [(1, "p", 0, 2)]), "k", ["a", "b"], "n")
    view = jv.JoinView(none, none)
    assert view.apply(none, none).count() == 0 and view.rows().count() == 0
    assert [(told(r), r.weight, r.total) for r in view.apply(none, one).collect()] == [((1, None, ("p", 0)), 2, 2)]
    assert {(told(r), r.weight, r.total) for r in view.apply(one, none).collect()} == {((1, None, ("p", 0)), -2, 0), ((1, ("p", 0), ("p", 0)), 4, 4)}


def test_taking_what_is_not_there_is_an_error(spark):
    one = jv.bag(frame(spark, [(1, "p", 0, 2)]), "k", ["a", "b"], "n")
    view = jv.JoinView(one, one)
    with pytest.raises(Exception, match="aren't there"):
        view.apply(one.withColumn("n", F.lit(-3).cast("bigint")), one.where("false")).collect()


def test_a_batch_does_not_shuffle_what_is_stored(spark):
    """The stored rows are read in their buckets: only the places are shuffled."""
    rows = jv.bag(spark.range(2000).select(F.col("id").alias("k"), F.lit("p").alias("a")), "k", ["a"])
    view = jv.JoinView(rows, rows)
    plan = view.base.join(jv._places(rows.limit(5), "l").distinct().hint("merge"), "place", "left_semi")._jdf.queryExecution().executedPlan().toString()
    left = plan.split("FileScan parquet")[1] if "Bucketed: true" in plan else ""
    assert "Bucketed: true" in left and plan.count("Exchange hashpartitioning(place") <= 1
