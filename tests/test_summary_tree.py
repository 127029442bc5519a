import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import summary_tree as tree

SCHEMA = "s string, k long, h string, v double"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(events, leaf, fanout):
    """(session, level, node) to (first, last, n, children, hash, sum) of the whole tree."""
    out = {}
    logs = defaultdict(list)
    for s, k, h, v in events:
        logs[s].append((k, h, v))
    for s, rows in logs.items():
        level = [(k, k, 1, 0, h, v or 0.0) for k, h, v in sorted(rows)]
        depth, size = 0, leaf
        while depth == 0 or len(level) > 1:
            groups = [level[i : i + size] for i in range(0, len(level), size)]
            level = [(g[0][0], g[-1][1], sum(x[2] for x in g), len(g), sha("".join(x[4] for x in g)), sum(x[5] for x in g)) for g in groups]
            out |= {(s, depth, i): x for i, x in enumerate(level)}
            depth, size = depth + 1, fanout
    return out


def told(t):
    return {(r.session, r.level, r.node): (r.first, r["last"], r.n, r.children, r.hash, r.sums[0]) for r in t.nodes().collect()}


@pytest.mark.parametrize("leaf, fanout, fold, seed", [(4, 2, 32, 0), (1, 3, 2, 1)])
def test_appends_give_the_tree_of_the_whole(spark, tmp_path, monkeypatch, leaf, fanout, fold, seed):
    monkeypatch.setattr(tree, "FOLD", fold)
    rng, t, events, next_ = random.Random(seed), tree.SummaryTree(spark, str(tmp_path / "t"), leaf, fanout, 1), [], defaultdict(int)
    for batch in range(5):
        new = []
        for s in rng.sample("abcde", rng.choice([0, 2, 3]) if batch not in (0, 4) else 4):
            for _ in range(rng.choice([1, 2, 7, 19])):
                new.append((s, next_[s], sha(f"{s}{next_[s]}"), rng.choice([None, 1.0, 2.0])))
                next_[s] += 1
        events += new
        rng.shuffle(new)
        for _ in range(2 if batch == 2 else 1):  # a batch that is run again changes nothing
            t.append(spark.createDataFrame(new, SCHEMA), batch, "s", "k", "h", [F.col("v")])
        if batch in (2, 4):
            assert told(t) == brute(events, leaf, fanout)


def test_only_the_path_to_the_root_is_rewritten(spark, tmp_path):
    t = tree.SummaryTree(spark, str(tmp_path / "t"), 4, 2, 1)
    rows = [("a", k, sha(str(k)), 1.0) for k in range(520)]
    t.append(spark.createDataFrame(rows[:511], SCHEMA), 0, "s", "k", "h", [F.col("v")])
    t.append(spark.createDataFrame(rows[511:512], SCHEMA), 1, "s", "k", "h", [F.col("v")])
    assert t.nodes().where("batch = 1").count() == 8  # a leaf and seven levels above it, of 255 nodes
    t.append(spark.createDataFrame(rows[512:513], SCHEMA), 2, "s", "k", "h", [F.col("v")])
    assert told(t) == brute(rows[:513], 4, 2)
    # A new leaf, and the root above the one before it; nodes of one child between them are made as they are in the whole tree.
    assert t.nodes().where("batch = 2").count() == 9


def test_a_stream_appends_once(spark, tmp_path):
    rows = [("ab"[k % 2], k // 2, sha(str(k)), 0.5) for k in range(60)]
    t = tree.SummaryTree(spark, str(tmp_path / "t"), 4, 3, 1)
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        sink = t.sink(session="s", number="k", hashed="h", measures=[F.col("v")])
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        q.stop()
    assert told(t) == brute(rows, 4, 3)


def test_events_are_written_as_leaves_alone(spark, tmp_path, monkeypatch):
    """A level is cut once, events never as rows, and the edge keeps the events of leaves that are open alone."""
    cuts, cut = [], tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    rows = [("a", k, sha(str(k)), 1.0) for k in range(66)] + [("b", k, sha(str(k)), 1.0) for k in range(8)]
    t = tree.SummaryTree(spark, str(tmp_path / "t"), 4, 2, 1)
    t.append(spark.createDataFrame(rows[:64] + rows[66:70], SCHEMA), 0, "s", "k", "h", [F.col("v")])
    assert len(cuts) == 8 and max(c.count() for c in cuts) == 17  # six levels, the end, the edge; 17 leaves
    held = lambda: spark.read.parquet(f"{tmp_path}/t/edge/batch={len(done)}").where("level = 0").select("session", "node", F.size("children")).collect()
    done = []
    assert held() == []
    done.append(0)
    t.append(spark.createDataFrame(rows[64:66] + rows[70:], SCHEMA), 1, "s", "k", "h", [F.col("v")])
    assert [tuple(r) for r in held()] == [("a", 16, 2)]
    assert told(t) == brute(rows, 4, 2)
