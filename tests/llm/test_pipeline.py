"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import os
import subprocess
import sys

import pytest

import corpus_pipeline
from sparkloom.llm import bpe, queries
from tests.llm.test_dedup import brute_components, brute_contained, brute_fingerprint

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(200)
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], DATA).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in steps[:-1]]

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {i for i, _ in rows[1]}
    right = [(i in kept) == bool(labels[i]) for i, _ in rows[0] if i in labels]
    assert sum(right) >= 0.97 * len(right)

    best = {}
    for i, t in rows[1]:
        best[t] = max(best.get(t, i), i)
    assert sorted(rows[2]) == sorted((i, t) for t, i in best.items())

    ids = [i for i, _ in rows[2]]
    groups = brute_components(ids, [brute_fingerprint(t) for _, t in rows[2]])
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, g in zip(ids, groups, strict=True) if i == g)

    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows[4]) == sorted(i for i, t in rows[3] if not any(brute_contained(t, x) for x in items))

    enc = bpe.encoding(*bpe.vocabulary())
    last = {r.doc_id: r for r in steps[-1].collect()}
    assert last.keys() == {i for i, _ in rows[4]}
    for i, t in rows[4]:
        assert last[i].ids == enc.encode_ordinary(t) and last[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()

    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(last)


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert queries.ORACLE_SQL.keys() <= queries.QUERIES.keys()


def test_the_rest_works_without_the_subpackage(tmp_path):
    """Where the subpackage, its tests and the pipeline aren't there, the entry works, queries run and the rest's tests pass."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py", "sparkloom", "tests"):
        subprocess.run(["cp", "-r", f"{repo}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "sparkloom/llm"), str(tmp_path / "tests/llm")], check=True)
    found = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(repo)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *found])}
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op') and x[2:3].isdigit() for x in q) and e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    some = "entry or known or group_counts or priority_columns or summaries"
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests", "-k", some], cwd=tmp_path, env=env, check=True, timeout=900)
