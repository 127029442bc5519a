import hashlib
import json
import math
import random
import statistics
from collections import Counter

from sparkloom.streaming.sketches import ColumnSketches


def test_merged_sketches_are_those_of_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b", "c", None, "x" * 300]), rng.choice([None, float("nan"), float("inf"), rng.gauss(1000, 1)]), rng.randrange(4000)) for _ in range(900)]
    schema = "s string, v double, k long"
    sketches = ColumnSketches(spark, str(tmp_path / "s"), ["s", "v", "k"], 20)
    for batch, part in enumerate((rows[:1], rows[1:400], [], rows[400:])):
        for _ in range(2 if batch == 1 else 1):  # a batch that is run again counts once
            sketches.take(spark.createDataFrame(part, schema), batch)
    got = {r["column"]: r for r in sketches.profile(3).collect()}
    v = [x for _, x, _ in rows if x is not None and math.isfinite(x)]
    assert (got["v"].n, got["v"].nulls, got["v"].numbers) == (900, sum(x is None for _, x, _ in rows), len(v))
    assert math.isclose(got["v"].mean, statistics.fmean(v)) and math.isclose(got["v"].deviation, statistics.stdev(v), rel_tol=1e-6) and (got["v"].least, got["v"].most) == (min(v), max(v))
    counts = Counter(s[:128] for s, *_ in rows if s)
    assert [(x["item"], x["count"]) for x in got["s"].top] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3] and got["s"].mean is None
    distinct = len({k for *_, k in rows})
    assert abs(got["k"].about_distinct - distinct) < 0.05 * distinct
    least = sorted(r.hash for r in sketches.rows().collect())
    whole = [r.row for r in sketches._kept(spark.createDataFrame(rows, schema)).collect()]
    assert least == sorted(hashlib.sha256(x.encode()).hexdigest() for x in whole) and len(least) == 20
    assert all(set(json.loads(x)) == {"s", "v", "k"} for x in whole)
