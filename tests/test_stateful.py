import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import stateful as st

TEXT = "id: 1\r\nevent: début\ndata: é ü 漢\ndata:b\n\n: note\n\nretry: 30\n\nid: x\0y\ndata\n\nevent: end\ndata: [DONE]".encode()


def whole(data, most=st.FRAME):
    return st.Frames(most).feed(data, True)


def test_frames_by_hand():
    got = [r[:5] for r in whole(TEXT)]
    assert got == [(1, "début", "é ü 漢\nb", "1", None), (2, "message", "", "", 30), (3, "message", "", "", None), (4, "end", "[DONE]", "", None)]
    assert whole(b"") == [] and whole(b"\n\n\n: a\n\n") == []


@pytest.mark.parametrize("most", [st.FRAME, 30, 12])
def test_any_cut_gives_the_same(most):
    for data in (TEXT, b"data: " + b"x" * 40 + b"\n\ndata: y\n\n", b"data: a\n\ndata: \xff\n\ndata: b\n\n", b"data: " + b"z" * 40):
        want = whole(data, most)
        for a in range(len(data) + 1):
            parser = st.Frames(most)
            got = parser.feed(data[:a])
            got = got if parser.error else got + st.Frames(most, parser.held()).feed(data[a:], True)
            assert got == want
    assert [r[7] for r in whole(b"data: " + b"x" * 40 + b"\n\n", 30)] == ["frame too large"]


def test_chunks_over_batches(spark, tmp_path):
    """Bytes cut anywhere, chunks that come twice and in any order over several batches and runs give what the whole gives."""
    rng = random.Random(5)
    rows, want = [], {}
    for key in range(12):
        data = TEXT * rng.randint(0, 3) + bytes(f"\n\ndata: {key}", "utf8") * (key % 2) + b"\n\ndata: \xfe\n\ndata: never" * (key == 7)
        cuts = sorted(rng.choices(range(len(data) + 1), k=rng.randint(0, 9)))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        rows += [(key, i, p, i == len(parts) - 1) for i, p in enumerate(parts)] + [(key, 0, parts[0], len(parts) == 1)]
        want[key] = whole(data)
    rng.shuffle(rows)
    schema = "key long, n long, body binary, last boolean"
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(half, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        st.run(st.event_streams(stream, "key", "n", "body", "last"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("key", "sequence").collect():
        got.setdefault(r.key, []).append((r.sequence, r.event, r.data, r.id, r.retry, r.event_hash, r.chain, r.error))
    assert got == {k: v for k, v in want.items() if v}


def test_values_expire_and_are_taken_once(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    batches = [
        [("a", at(0), 1, "put", "A", 100), ("a", at(1), 2, "take", None, 0), ("a", at(1), 3, "take", None, 0), ("b", at(2), 4, "put", "B", 10), ("c", at(0), 5, "get", None, 0)],
        [("b", at(5), 6, "get", None, 0), ("b", at(12), 7, "get", None, 0), ("a", at(9), 8, "take", None, 0), ("d", at(10), 9, "put", "D", 1000)],
        [("a", at(200), 10, "get", None, 0), ("d", at(201), 11, "put", "E", 10)],
        [("a", at(300), 12, "take", None, 0), ("b", at(301), 13, "get", None, 0)],
        [("z", at(9000), 14, "get", None, 0)],
    ]
    schema = "key string, t timestamp, n long, action string, value string, ttl long"
    for batch in batches:  # a run for each, on one checkpoint
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        st.run(st.expiring(stream, "key", "t", "n", "action", "value", "ttl"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.number: (r.outcome, r.value) for r in rows if r.number} == {
        1: ("stored", "A"), 2: ("found", "A"), 3: ("taken", None), 4: ("stored", "B"), 5: ("unknown", None), 6: ("found", "B"), 7: ("expired", None), 8: ("taken", None), 9: ("stored", "D"),
        10: ("expired", None), 11: ("stored", "E"), 12: ("unknown", None), 13: ("unknown", None), 14: ("unknown", None),
    }
    # b was dropped when the time passed its end, a with no value as it was taken, and E, whose end took the place of D's.
    assert sorted((r.key, r.value, r["at"]) for r in rows if r.action == "timer" and r.value) == [("b", "B", at(12)), ("d", "E", at(211))]
    assert [r.key for r in rows if r.action == "timer" and not r.value] == ["a"]
    assert spark.conf.get(st._PROVIDER, None) != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_groups_of_keys_hold_what_each_key_would(spark, tmp_path):
    """Random actions of many keys, null and beyond 2 ** 53 too, in batches: rows and timers of a fold by key, and no more rows of state than groups."""
    rng, start, groups = random.Random(3), datetime(2024, 1, 1), 4
    keys, batches, want, fired, held, mark = [None, *range(1 << 60, (1 << 60) + 30)], [], {}, [], {}, -1
    for b in range(3):
        rows = [(rng.choice(keys), 100 * b + rng.randint(1, 99), 1000 * b + i, rng.choice(["put", "take", "get", None]), rng.choice([None, f"v{b}.{i}"]), rng.choice([0, 5, 60, 99])) for i in range(150)]
        rows += [(keys[1], 100 * b + 1, 1000 * b + 990, "put", "ends at the mark", 98), (keys[2], 100 * b + 99, 1000 * b + 991, "get", None, None), (keys[3], 100 * b + 50, None, "get", None, None)]
        batches.append(rows)
        for key, at, n, action, value, ttl in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0)):
            had = held.get(key)
            why = "stored" if action == "put" else "unknown" if had is None else "expired" if at >= had[1] else "taken" if had[2] else "found"
            want[b, key, n] = (action, why, value if action == "put" else had[0] if why == "found" else None)
            if action == "put":
                held[key] = (value, at + (ttl or 0), False)
            elif action == "take" and why == "found":
                held[key] = (*had[:2], True)
        for now in [mark] if b < 2 else [mark, 299]:  # the last time of the batches before; at the end, of all
            over = {k: x for k, x in held.items() if x[1] < now}
            fired += [(k, start + timedelta(seconds=x[1]), None if x[2] else x[0]) for k, x in over.items()]
            held = {k: x for k, x in held.items() if k not in over}
        mark = 100 * b + 99
    schema = "key long, t timestamp, n long, action string, value string, ttl long"
    for rows in batches:
        frame = spark.createDataFrame([(k, start + timedelta(seconds=at), *r) for k, at, *r in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sizes = []
    with st.state_tables(spark):
        q = st.expiring(stream, "key", "t", "n", "action", "value", "ttl", buckets=groups).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    try:
        q.awaitTermination()
        sizes = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    finally:
        q.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    seconds = lambda r: (r["at"] - start).total_seconds()
    assert {(seconds(r) // 100, r.key, r.number): (r.action, r.outcome, r.value) for r in rows if r.action != "timer"} == want
    assert sorted(((r.key, r["at"], r.value) for r in rows if r.action == "timer"), key=str) == sorted(fired, key=str)
    assert len(rows) == len(want) + len(fired) and len(sizes) == 4 and max(sizes) <= groups + 1
