"""Claims in batches and joins by path endings, against one at a time and all pairs."""

import random

import pytest

from sparkloom.operators import jobs, symbols

JOBS = "job_id long, project_id long, state string, priority int, created_at double, scheduled_at double, updated_at double, attempt int, max_attempts int, lease_owner string, lease_until double, resource_class string"


@pytest.mark.parametrize("seed, concurrency", [(0, 2), (1, 3)])
def test_a_batch_of_claims_is_as_many_single_ones(spark, seed, concurrency):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        state = rng.choice(["queued"] * 6 + ["running", "succeeded", "failed"])
        until = rng.choice([50.0, 500.0]) if state == "running" else 0.0
        rows.append((i, rng.choice([0, 0, 0, 1, 2, 3, 4]), state, rng.randint(0, 2), float(rng.randint(0, 5)), rng.choice([0.0, 0.0, 999.0]), float(rng.randint(0, 90)), 0, 3, "x" if until else "", until, rng.choice(["cpu", "gpu"])))
    table, needs = spark.createDataFrame(rows, JOBS).coalesce(1), spark.createDataFrame([(i, rng.randrange(60)) for i in range(0, 60, 7)], "job_id long, dependency_id long")
    workers = [f"w{i}" for i in range(7)]
    one, taken = table, []
    for w in workers:
        one, got = jobs.claim(one, needs, w, 100.0, concurrency=concurrency, classes=("cpu",))
        taken += got.collect()
    after, got = jobs.claim_batch(table, needs, workers, 100.0, concurrency=concurrency, classes=("cpu",))
    assert sorted(got.collect()) == sorted(taken) and len(taken) > 2
    assert sorted(after.collect()) == sorted(one.collect())


def test_a_batch_needs_workers(spark):
    table, needs = spark.createDataFrame([], JOBS), spark.createDataFrame([], "job_id long, dependency_id long")
    for workers in ([], ["a", ""]):
        with pytest.raises(ValueError, match="workers"):
            jobs.claim_batch(table, needs, workers, 1.0)
    assert jobs.claim_batch(table, needs, ["a"], 1.0)[1].count() == 0


@pytest.mark.parametrize("parts", [False, True])
def test_path_endings_as_all_pairs(spark, parts):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    path = lambda n: "/".join(word() for _ in range(rng.randint(1, n)))
    modules = [(i, path(4)) for i in range(80)] + [(90, None), (91, ""), (92, "b/a"), (93, "b/a")]
    imports = [(i, path(2)) for i in range(60)] + [(70, None), (71, ""), (72, "a"), (73, "a"), (74, "none/of/them/is/as/long/as/this")]
    got = symbols.suffix_matches(spark.createDataFrame(imports, "importer long, path string"), spark.createDataFrame(modules, "imported long, module string"), parts=parts)
    fits = lambda m, p: m.endswith(p) and (not parts or m == p or m[-len(p) - 1] == "/")
    assert sorted((r.importer, r.imported) for r in got.collect()) == sorted((i, j) for i, p in imports for j, m in modules if p and m and fits(m, p))
    assert symbols.suffix_matches(spark.createDataFrame([(1, "")], "importer long, path string"), got.select("imported", "module")).count() == 0
