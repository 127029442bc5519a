"""Every query with SQL against DuckDB at the smallest scale; the others are held against plain Python."""

import math
import os

import duckdb
import pytest

from sparkloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    return float(x) if isinstance(x, int | float) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(getattr(x, "item", lambda x=x: x)()) for x in r) for r in frame.astype(object).values.tolist()), key=repr)


def same(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


#: Queries that SQL can't express (random draws, sketches, alignments, folding of letters, look-behind, folds over bounded groups), by what holds them against Python.
BY_HAND = {
    "bootstrap_interval": "test_intervals_hold_their_medians", "card_numbers": "test_texts_by_hand", "column_profile_approximate": "test_sketches_are_close", "command_views": "test_command_views_by_hand",
    "context_deltas": "test_deltas_by_hand", "dependency_pack": "test_dependency_packs_by_hand", "multi_graph_search": "test_graphs_by_hand", "normalised_text": "test_texts_by_hand",
    "output_governor": "test_governor_by_hand", "redaction": "test_texts_by_hand", "search_pack": "test_search_packs_by_hand", "segments": "test_segments_by_hand", "session_plan_budget": "test_plans_fit_their_budgets", "task_pack": "test_task_packs_by_hand", "strong_components": "test_components_by_hand", "transcript_mining": "test_transcripts_by_hand",
}


def test_every_query_is_checked():
    from tests import test_brute

    assert registry.queries().keys() - registry.oracle_sql().keys() == BY_HAND.keys()
    assert all(hasattr(test_brute, name) for name in BY_HAND.values())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    found, wanted = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert same(rows(found), rows(wanted))


def test_entry_gives_rows(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns[0] == "column" and found.count() == 5


def test_queries_are_known_without_a_session():
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and e.oracle_sql().keys() <= e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=repo, env={**os.environ, "PYTHONPATH": repo}, check=True)
