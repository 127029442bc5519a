"""Tiered packs, chains of calls and routes against plain Python on drawn cases."""

import random

import pytest

from sparkloom.operators import graph, routing, taskpack


def size(text):
    return -(-len(text.encode()) // 4)


def taken(items, room):
    """A pack by hand: tier by tier, the smallest first; mandatory ones are clipped to what is left."""
    out, used = [], 0
    for tier, path, start, end, text in sorted(items, key=lambda r: (taskpack.TIERS.index(r[0]), size(r[4]), r[1], r[2], r[3])):
        left = room - used
        if left <= 0:
            break
        if size(text) > left:
            if tier != "mandatory":
                continue
            n = max((i for i in range(len(text) + 1) if size(text[:i].rstrip()) <= left), default=0)
            cut = text[:n].rstrip()
            if not cut:
                continue
            out.append((path, start, end, tier, cut, size(cut), True))
            used += size(cut)
        else:
            out.append((path, start, end, tier, text, size(text), False))
            used += size(text)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_packs_as_one_item_after_the_other(spark, seed):
    draw = random.Random(seed)
    rows = []
    for key in range(12):
        for i in range(draw.randrange(1, 25)):
            n = draw.choice([0, 5, 40, 300, 900, 2500]) if key else 1200
            text = "".join(draw.choice("ab \n\té漢😀") for _ in range(n)) if draw.random() < 0.7 else " " * n + "x"
            rows.append((key, draw.choice(taskpack.TIERS), f"p{draw.randrange(4)}", i, i + 3, text))
    items = spark.createDataFrame(rows, "k int, tier string, path string, start bigint, end bigint, text string").withColumn("tokens", taskpack.tokens(taskpack.F.col("text")))
    got = {}
    for r in taskpack.packed(items, "k", 600).collect():
        got.setdefault(r.k, []).append((r.path, r.start, r.end, r.tier, r.text, r.tokens, r.clipped))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(x) for k in range(12) if (x := taken([r[1:] for r in rows if r[0] == k], 600))}
    assert any(x[-1] for v in got.values() for x in v)


def test_ranges_count_once_and_by_their_best_tier(spark):
    kind = "k int, path string, line int, end_line int"
    definitions = spark.createDataFrame([(1, "a", 10, 12), (1, "a", 10, 12), (1, "b", None, None)], kind)
    symbols = spark.createDataFrame([(1, "a", 9, 13), (1, "a", 1, 1), (1, "c", 5, None), (2, "a", 5, 5), (1, None, 1, 1)], kind)
    affected = spark.createDataFrame([(1, "c"), (1, "c"), (1, "z")], "k int, path string")
    ranges = taskpack.candidates(definitions, symbols, affected, "k")
    got = {(r.k, r.path, r.start, r.end, r.tier) for r in ranges.collect()}
    assert got == {(1, "a", 8, 14, "mandatory"), (1, "b", 1, 3, "mandatory"), (1, "a", 1, 2, "optional"), (1, "c", 4, 6, "likely"), (2, "a", 4, 6, "optional"), (1, None, 1, 2, "optional")}
    lines = spark.createDataFrame([("a", i, f"line {i}") for i in range(1, 100)] + [("b", 2, None)], "path string, line int, text string")
    texts = {(r.path, r.start): r.text for r in taskpack.excerpts(ranges.where("k = 1"), lines, "k").collect()}
    assert texts == {("a", 8): "\n".join(f"line {i}" for i in range(8, 15)), ("a", 1): "line 1\nline 2", ("b", 1): ""}
    long = taskpack.excerpts(spark.createDataFrame([(1, "a", 3, 99, "likely")], "k int, path string, start bigint, end bigint, tier string"), lines, "k").first()
    assert long.text == "\n".join(f"line {i}" for i in range(3, 100))
    pack = taskpack.packed(taskpack.excerpts(ranges, lines, "k"), "k", 256)
    assert {(r.k, r.path) for r in taskpack.recoverable(affected, pack, "k").collect()} == {(1, "c"), (1, "z")}
    with pytest.raises(ValueError):
        taskpack.packed(ranges, "k", 255)


def walked(edges, entry, depth):
    out, seen, ends = {}, {entry}, [(entry, (entry,))]
    for d in range(1, depth + 1):
        new = []
        for node, path in ends:
            for x in sorted({b for a, b in edges if a == node} - seen):
                seen.add(x)
                new.append((x, (*path, x)))
                out[x] = (d, (*path, x))
        ends = new
    return out


def test_chains_are_those_of_a_walk_in_order(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(25), draw.randrange(25)) for _ in range(60)] + [(3, 3), (3, 4), (3, 4)]
    table = spark.createDataFrame(edges, "src bigint, dst bigint")
    entries = spark.createDataFrame([(3,), (3,), (7,), (99,), (None,)], "node bigint")
    got = {}
    for r in graph.chains(table, entries, 4).collect():
        assert r.node not in got.setdefault(r.entry, {})
        got[r.entry][r.node] = (r.depth, tuple(r.chain))
    assert got == {e: w for e in (3, 7, 99) if (w := walked(edges, e, 4))}
    assert graph.chains(table.where("src < 0"), entries, 4).count() == 0


def test_levels_of_tasks(spark):
    rows = [("A Security audit, refactor", 0, 0, "complex"), ("root cause of a race condition; debug", 8, 0, "reasoning"), ("rename", 8, None, "medium"), ("rename", None, None, "simple"), (None, 9, 16_000, "complex"), ("", 7, 15_999, "simple"), ("cross-repo proof", 8, 16_000, "reasoning")]
    df = spark.createDataFrame([(*r[:3],) for r in rows], "task string, files int, tokens int")
    F = routing.F
    assert [r[0] for r in df.select(routing.complexity(F.col("task"), F.col("files"), F.col("tokens"))).collect()] == [r[3] for r in rows]


def test_cheapest_routes(spark):
    offers = [("p", "m1", 1000, 5, 10, True), ("p", "m0", 1000, 5, 10, None), ("q", "m", 9000, 50, 1, True), ("r", "m", 9000, None, 1, True), ("s", "m", 1000, 5, 9, False)]
    candidates = spark.createDataFrame(offers, "provider string, model string, max_context bigint, cost_micros bigint, latency_ms bigint, supports_tools boolean")
    tasks = spark.createDataFrame([(1, 10, 100, False), (2, 10, 100, True), (3, 5000, 100, None), (4, 5000, 49, None), (5, None, 100, None)], "id int, required_context bigint, max_cost_micros bigint, require_tools boolean")
    got = {r.id: (r.eligible_count, r.route and (r.route.provider, r.route.model)) for r in routing.cheapest(tasks, candidates).collect()}
    assert got == {1: (4, ("s", "m")), 2: (2, ("p", "m1")), 3: (1, ("q", "m")), 4: (0, None), 5: (0, None)}
    assert [r.eligible_count for r in routing.cheapest(tasks, candidates.where("max_context < 0")).collect()] == [0] * 5
    with pytest.raises(ValueError):
        routing.cheapest(tasks, candidates.crossJoin(spark.range(routing.MOST)))


def test_best_routes_and_fallbacks(spark):
    kind = "provider string, model string, account string, max_complexity string, quality double, input_cost_per_million double, output_cost_per_million double, latency_ms double, quota_remaining double, priority int, subscription boolean, available boolean, rate_limited_until double, context_window bigint"
    rows = [
        ("a", "x", "1", "reasoning", 0.9, 3.0, 15.0, 900.0, 1.0, 0, False, True, 0.0, 0),
        ("b", "x", "1", "medium", 0.7, 0.0, 0.0, 300.0, 0.5, 50, True, True, 0.0, 1000),
        ("c", "x", "1", "reasoning", 0.8, 1.0, 2.0, 300.0, 2.0, 0, False, True, 0.0, None),
        ("d", "x", "1", "reasoning", 1.0, 0.0, 0.0, 1.0, 1.0, 0, True, False, 0.0, 0),
        ("e", "x", "1", "reasoning", 1.0, 0.0, 0.0, 1.0, 1.0, 0, True, True, 101.0, 0),
        ("f", "x", "1", "reasoning", 1.0, 0.0, 0.0, 1.0, 0.0, 0, True, True, 0.0, 0),
    ]
    tasks = spark.createDataFrame([(1, "rename", 0, 10), (2, "security proof of a migration, refactor", 9, 10), (3, "rename", 0, 5000), (4, None, None, None)], "id int, task string, changed_files int, token_estimate int")
    got = {r.id: (r.complexity, r.route.provider, [x.provider for x in r.fallbacks]) for r in routing.best(tasks, spark.createDataFrame(rows, kind), 100.0).collect()}
    assert got == {1: ("simple", "b", ["c", "a"]), 2: ("reasoning", "c", ["a"]), 3: ("simple", "c", ["a"]), 4: ("simple", "b", ["c", "a"])}
    none = routing.best(tasks, spark.createDataFrame(rows[3:], kind), 100.0).collect()
    assert all(r.route is None and r.fallbacks == [] for r in none)
