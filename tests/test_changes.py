"""Edges, impacts and polls under changes, against rebuilding everything."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, relink
from sparkloom.streaming.polls import PollWatch

SYMBOLS, EDGES = "path string, qualified_name string", "id long, path string, target string"


def files(rng, paths):
    name = lambda: rng.choice(["m.a", "m.b", "n.a", "n.c", "x.d", "d", "a", None])
    return {p: ([name() for _ in range(rng.randint(0, 3))], [name() for _ in range(rng.randint(0, 4))]) for p in paths}


def frames(spark, held, at):
    symbols = [(p, n) for p, (s, _) in held.items() for n in s if n]
    edges = [(at * 10_000 + hash((p, i)) % 10_000, p, t) for p, (_, e) in held.items() for i, t in enumerate(e)]
    return spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES)


def told(df):
    return sorted(((r.path, r.target, r.target_path) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_relinking_is_linking_anew(spark, seed):
    rng = random.Random(seed)
    held = files(rng, [f"f{i}" for i in range(14)])
    index = relink.link(*frames(spark, held, 0))
    for step in range(1, 4):
        touched = rng.sample(sorted(held), 3) + ["new" + str(step)]
        changed = files(rng, touched[1:])
        held = {p: x for p, x in held.items() if p not in touched} | changed
        index = relink.relink(index, spark.createDataFrame([(p,) for p in touched], "path string"), *frames(spark, changed, step))
        whole = relink.link(*frames(spark, held, 9))
        assert told(index.edges) == told(whole.edges)


def test_only_edges_that_may_differ_are_resolved_again(spark):
    symbols = spark.createDataFrame([(f"f{i}", f"m.s{i}") for i in range(50)], SYMBOLS)
    edges = spark.createDataFrame([(i, f"f{i}", f"m.s{(i * 7) % 50}") for i in range(50)], EDGES)
    index = relink.link(symbols, edges)
    after = relink.relink(index, spark.createDataFrame([("f3",)], "path string"), spark.createDataFrame([("f3", "m.s3"), ("f3", "m.t")], SYMBOLS), edges.where("path = 'f3'"))
    assert [r.path for r in after.redone.collect()] == ["f3"]  # its own alone: who has m.s3 stays the same, and nobody asks for m.t
    after = relink.relink(index, spark.createDataFrame([("f3",)], "path string"), spark.createDataFrame([("f3", "m.u3")], SYMBOLS), edges.where("path = 'f3'"))
    assert sorted(r.path for r in after.redone.collect()) == ["f29", "f3"]  # 29 * 7 % 50 = 3


def test_other_impacts_stay(spark):
    rng = random.Random(4)
    edge = lambda: (rng.randrange(30), rng.randrange(30))
    old = [edge() for _ in range(40)]
    new = [x for x in old if x != old[0]] + [edge(), old[5]]
    a, b = (spark.createDataFrame(x, "src long, dst long") for x in (old, new))

    def impact(edges, node, depth):
        seen, front = {node}, {node}
        for _ in range(depth):
            front = {s for s, d in edges if d in front} - seen
            seen |= front
        return seen

    stale = {r.node for r in relink.stale_impacts(a, b, 3).collect()}
    differ = {n for n in range(30) if impact(old, n, 3) != impact(new, n, 3)}
    assert differ and differ <= stale and len(stale) < 30
    assert graph.reach(b, spark.createDataFrame([(n,) for n in differ], "node long"), 3, reverse=True).count() > 0
    assert relink.stale_impacts(a, a, 3).count() == 0


def brute_polls(polls):
    before, out = {}, []
    for n, now in sorted(polls.items()):
        out += [(n, k, "added" if k not in before else "deleted" if k not in now else "modified") for k in sorted(before.keys() | now.keys()) if before.get(k) != now.get(k)]
        before = now
    return out


def test_polls_over_batches_and_runs(spark, tmp_path):
    polls = {1: {"a": 1, "b": 1}, 2: {}, 3: {"a": 1}, 5: {"a": 2, "c": 1}, 6: {}, 7: {}, 9: {"c": 1, "b": 3}}
    files_ = [[1], [2, 3], [5, 6], [7], [9]]
    watch = PollWatch(spark, str(tmp_path / "watch"), "poll", ["k"], F.col("v"))
    for part in files_:
        rows = [(p, k, v) for p in part for k, v in polls[p].items()] + [(p, None, None) for p in part]
        spark.createDataFrame(rows, "poll long, k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("poll long, k string, v long").parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(watch.take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        q.stop()
    want = brute_polls(polls)
    assert sorted((r.poll, r.k, r.change) for r in watch.changes().collect()) == sorted(want)
    watch.take(spark.createDataFrame([(9, "c", 1), (9, "b", 3)], "poll long, k string, v long"), 4)  # the last batch again
    watch.clear()
    watch.take(spark.createDataFrame([(8, "z", 1), (10, None, None)], "poll long, k string, v long"), 5)  # a poll that is too late, and one that finds nothing
    assert sorted((r.poll, r.k, r.change) for r in watch.changes().collect()) == sorted([*want, (10, "b", "deleted"), (10, "c", "deleted")])
