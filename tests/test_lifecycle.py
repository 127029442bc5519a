"""Transitions of jobs against a fold of one request after the other."""

import random

import pytest

from sparkloom.operators import lifecycle

JOBS = "job_id bigint, state string, attempts bigint, claimed_by string, note string"
ASKED = "job_id bigint, seq bigint, state string, claimed_by string"


def folded(jobs, asked):
    held = {j: [s, n, who] for j, s, n, who, _ in jobs}
    log = []
    for j, q, s, who in sorted((r for r in asked if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        now = held.get(j)
        came = now[0] if now and now[0] in lifecycle.STATES else None
        ok = came is not None and s in lifecycle.ALLOWED[came]
        log.append((j, q, s, who, came, ok))
        if ok:
            held[j] = [s, now[1] + (s == "running"), now[2] if who is None else who]
    return log + [(None, q, s, who, None, False) for j, q, s, who in asked if j is None], held


def drawn(seed, n=1500):
    draw = random.Random(seed)
    jobs = [(j, draw.choice(lifecycle.STATES), draw.randrange(3), "", f"note {j}") for j in range(12)] + [(12, "strange", 0, "", "x"), (13, "queued", 0, "", "idle")]
    asked = [(draw.choice([0, 0, 0, 0, *range(1, 13), 99, None]), draw.randrange(n), draw.choice([*lifecycle.STATES, "queued", "claimed", "running", "nowhere", None]), draw.choice([None, "a", "b"])) for _ in range(n)]
    return jobs, asked + asked[:20]


@pytest.mark.parametrize("seed, piece", [(0, 4), (1, 256)])
def test_as_one_after_the_other(spark, seed, piece):
    jobs, asked = drawn(seed)
    table, wanted, ends = spark.createDataFrame(jobs, JOBS), *folded(jobs, asked)
    log = lifecycle.transitions(table, spark.createDataFrame(asked, ASKED).repartition(5), piece)
    got = [(r.job_id, r.seq, r.state, r.claimed_by, r.came_from, r.accepted) for r in log.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and sum(r[-1] for r in got) > 50
    after = {r.job_id: [r.state, r.attempts, r.claimed_by] for r in lifecycle.advanced(table, log).collect()}
    assert after == ends


def test_batches_are_the_whole(spark):
    jobs, asked = drawn(2, 600)
    now = spark.createDataFrame(jobs, JOBS)
    whole = lifecycle.advanced(now, lifecycle.transitions(now, spark.createDataFrame(asked, ASKED)))
    for part in (lambda q: q < 150, lambda q: 150 <= q < 400, lambda q: q >= 400):
        some = spark.createDataFrame([r for r in asked if part(r[1])], ASKED)
        now = lifecycle.cut(lifecycle.advanced(now, lifecycle.transitions(now, some, 8)))
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, whole.collect())) and now.columns == whole.columns


def test_empty_tables(spark):
    jobs, none = spark.createDataFrame([(1, "queued", 0, None, None)], JOBS), spark.createDataFrame([], ASKED)
    log = lifecycle.transitions(jobs, none)
    assert log.count() == 0 and lifecycle.advanced(jobs, log).collect() == jobs.collect()
    assert [r.accepted for r in lifecycle.transitions(jobs.where("job_id > 1"), spark.createDataFrame([(1, 1, "claimed", "w")], ASKED)).collect()] == [False]
