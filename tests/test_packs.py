"""Packs, pages, compact views, functions over bytes and rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import bytes as by, text as tx
from sparkloom.functions.registry import Functions, map_reduce
from sparkloom.operators import compact, context, symbols
from sparkloom.streaming import tables as streams


def item(name, tokens, utility, mandatory=False, depends=()):
    return {"item": name, "tokens": tokens, "utility": utility, "mandatory": mandatory, "depends": list(depends)}


def test_pack_takes_dependencies_and_respects_the_budget():
    pack = context.Pack([item("a", 5, 1.0, True, ["b"]), item("b", 3, 0.0), item("c", 4, 9.0, depends=["d"]), item("d", 4, 0.0), item("e", 2, 3.0)], 12)
    assert pack.fill() and pack.chosen == {"a", "b", "e"} and pack.used == 10
    assert not context.Pack([item("a", 5, 1.0, True)], 4).fill()


def test_pack_swaps_once():
    pack = context.Pack([item("small", 1, 1.0), item("large", 10, 9.0)], 10)
    assert pack.fill() and pack.chosen == {"large"}


def test_packs_never_overflow():
    rng = random.Random(3)
    for _ in range(200):
        names = [f"i{k}" for k in range(rng.randint(1, 9))]
        rows = [item(n, rng.randint(0, 6), rng.random(), rng.random() < 0.2, rng.sample(names, rng.randint(0, min(2, len(names))))) for n in names]
        pack = context.Pack(rows, rng.randint(1, 20))
        ok = pack.fill()
        assert pack.used == sum(pack.rows[x]["tokens"] for x in pack.chosen) <= pack.budget
        if ok:
            assert all(set(pack.rows[x]["depends"]) <= pack.chosen for x in pack.chosen)


def test_envelope_fits():
    value = {f"k{i}": ["x" * 500] * 40 for i in range(40)}
    for budget in (200, 1000, 10_000, 10_000_000):
        assert len(context.envelope(value, budget).encode()) <= budget
    assert context.inline_filters("find kind:log path: error:x me") == ("find path: me", {"kind": "log", "error": "x"})


def test_pages_and_collection(spark):
    df = spark.createDataFrame([("k", i, 300) for i in range(4)], "k string, i int, n long")
    assert [(r.first_page, r.last_page) for r in context.pages(df, "k", [F.col("i")], "n", 512).orderBy("i").collect()] == [(0, 0), (0, 1), (1, 1), (1, 2)]
    dead = spark.createDataFrame([(1, 10), (2, 500), (3, 20), (4, 1)], "i int, n long")
    assert sorted(r.i for r in context.collectable(dead, ["i"], "n", "i", F.col("i") == 4, 40).collect()) == [1, 3]


def test_deltas_and_changes(spark):
    old, new = "\n".join(map(str, range(100))), "\n".join(["x", *map(str, range(1, 100))])
    df = spark.createDataFrame([(1, old, new), (2, None, "a"), (3, "a", "b")], "k long, a string, b string")
    got = {r.k: r for r in context.deltas(df, "k", "a", "b").collect()}
    assert got[1].is_delta and "+x" in got[1].body and not got[2].is_delta and got[3].body == "b"
    arrays = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"])], "k long, a array<string>, b array<string>")
    assert context.changed_segments(arrays, "k", "a", "b").first().changed == [1, 3]


@pytest.mark.parametrize("kind, text, wanted", [("test", "ok\nE  boom\n3 passed, 1 failed", ["3 passed, 1 failed", "E  boom"]), ("diff", "diff --git a b\n+new\n same\n-old\n+++ b", ["diff --git a b", "+++ b", "+new", "-old"]), ("log", "\n".join(f"commit {i}" for i in range(70)), [f"commit {i}" for i in range(40)] + ["[… 10 lines omitted …]"] + [f"commit {i}" for i in range(50, 70)]), ("build", "\n".join(f"#{i} done" for i in range(120)), [f"#{i} done" for i in range(80)] + ["[… 10 lines omitted …]"] + [f"#{i} done" for i in range(90, 120)]), ("test", "tests: 3\nx at f(a.js:1)\nsuccesses: 2\nok  pkg 0.1s", ["tests: 3", "successes: 2", "ok  pkg 0.1s", "x at f(a.js:1)"]), ("json", '{"b": [1], "a": "x"}', ["{", '  "a": "x",', '  "b": [', "    1", "  ]", "}"]), ("json", "no json", ["no json"]), ("search", "a:1\na:2\nd/e\nerror", ["results=4 groups=3", "[a] 2", "a:1", "a:2", "[d] 1", "d/e", "[.] 1", "error", "error"])])
def test_views(spark, kind, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(compact.view(tx.lines(F.col("t")), kind)).first()[0] == wanted


def test_governor_and_facts(spark):
    df = spark.createDataFrame([("plain line\nPlain  LINE\nfatal error in a/b.py:3\n" + "z" * 60,)], "t string")
    assert df.select(compact.governed(tx.lines(F.col("t")), 40)).first()[0] == ["plain line", "fatal error in a/b.py:3"]
    report = spark.createDataFrame([("2 failed in a/b.py and not c", "a/b.py")], "s string, c string").select(compact.preservation(F.col("s"), F.col("c"))).first()[0]
    assert "path:a/b.py" not in report.missing and "negation:not" in report.missing and "test-status:2 failed" in report.missing


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 100])
def test_utf8_prefix(spark, limit):
    for text in ("aé漢😀z", "", "😀😀"):
        got = spark.createDataFrame([(text,)], "t string").select(by.utf8_prefix(F.col("t"), limit)).first()[0]
        raw = text.encode()[:limit]
        assert got == raw.decode("utf-8", "ignore")


def test_languages_and_binary(spark):
    rows = [("a/Makefile", "", "make"), ("x.TSX", "", "typescript"), ("run", "#!/usr/bin/env python3\n", "python"), ("run", "#!/bin/bash", "shell"), ("a.zz", "", "unknown:zz"), ("plain", "", "unknown:text")]
    for path, text, wanted in rows:
        assert spark.createDataFrame([(path, text)], "p string, t string").select(by.language(F.col("p"), F.col("t"))).first()[0] == wanted
    probe = spark.createDataFrame([(b"abc",), (b"a\0b",), (b"\xff\xfe\xfa\xf0abc",), ("é".encode(),), (b"",)], "b binary").select(by.is_binary(F.col("b"))).collect()
    assert [r[0] for r in probe] == [False, True, True, False, False]
    assert spark.createDataFrame([("ﬁ Straße",)], "t string").select(by.folded(F.col("t"))).first()[0] == "fi strasse"


def test_functions(spark):
    known = Functions()
    known.register("add", lambda a, b: a + b, "bigint")
    known.register("now", lambda: 1, "bigint", pure=False)
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("b", None)], "k string, v long").repartition(3)
    assert {r.k: r.s for r in known.reduce(df, "add", ["k"], "v", "s").collect()} == {"a": 3, "b": 5}
    with pytest.raises(ValueError):
        known.map(df, "now", "v", "x")
    with pytest.raises(ValueError):
        known.register("add", max, "bigint")
    known.expose(spark)
    assert spark.sql("select add(1L, 2L)").first()[0] == 3
    done = map_reduce(df.where("v is not null"), "k", lambda f: pd.DataFrame({"k": f.k}), "k string")
    assert sorted(r.k for r in done.collect()) == ["a", "b"]


def test_symbols(spark):
    s = spark.createDataFrame([("a.py", "login", "auth.login", 0.9), ("b.py", "run", "x.run", 0.9), ("c.py", "run", "y.run", 0.9)], "path string, name string, qualified_name string, confidence double")
    assert symbols.seeds(s, "login", 5).first().path == "a.py"
    e = spark.createDataFrame([("x.run",), ("run",), ("login",), ("none",)], "target string")
    assert {r.target: r.target_path for r in symbols.resolve(e, s).collect()} == {"x.run": "b.py", "run": None, "login": "a.py", "none": None}
    code = spark.createDataFrame([("a.py", "x = 1\nwhile True:\n  eval (x)")], "p string, t string")
    assert {(r.kind, r.line) for r in symbols.smells(code, "p", "t").collect()} == {("unbounded-retry", 2), ("shell-true", 3)}


def test_streams_over_several_batches(spark, tmp_path):
    """Chains and scans go on from batch to batch; rows behind a key's last one are late."""
    for n, rows in enumerate([[("k", 1, "to"), ("k", 2, "ken ABCD ")], [("k", 3, "EF x"), ("j", 1, "y")], [("k", 2, "late")]]):
        spark.createDataFrame(rows, "k string, i long, t string").coalesce(1).write.parquet(f"{tmp_path}/s/p{n}")
    import os
    import shutil

    os.makedirs(tmp_path / "in")
    for n in range(3):
        part = next(p for p in os.listdir(tmp_path / f"s/p{n}") if p.endswith(".parquet"))
        shutil.copy(tmp_path / f"s/p{n}/{part}", tmp_path / f"in/{n}.parquet")
        os.utime(tmp_path / f"in/{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    chain = streams.drain(streams.append_chain(streams.read_events(spark, str(tmp_path / "in")), "k", "i", "t"), "chain_test", "append").collect()
    good = sorted((r.k, r.sequence, r.previous_hash, r.event_hash) for r in chain if not r.late)
    assert [(k, n) for k, n, *_ in good] == [("j", 1), ("k", 1), ("k", 2), ("k", 3)] and [r.i for r in chain if r.late] == [2]
    assert all(b[2] == a[3] for a, b in zip(good[1:], good[2:], strict=False))
    found = streams.drain(streams.scan_overlap(streams.read_events(spark, str(tmp_path / "in")), "k", "i", "t", "token|[A-Z]{2,}"), "scan_test", "append").collect()
    assert ("k", "token") in {(r.k, r.match) for r in found}


def test_tokens_serve_once_and_for_a_time(spark):
    table = spark.createDataFrame([], "token string, position long, expires_at double, used boolean")
    table = context.issued(context.issued(table, "a", 5, 0.0, 10.0), "b", 7, 0.0, 10.0)
    table, at = context.redeemed(table, "a", 1.0)
    assert at == 5
    for token, now in (("a", 2.0), ("b", 11.0), ("c", 1.0)):
        with pytest.raises(ValueError):
            context.redeemed(table, token, now)


def test_caches_store_at_a_miss(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 5, 10, 11, 25, 30)] + [("j", 3)], "k string, t long")
    from sparkloom.operators import windows

    assert sorted((r.k, r.t, r.hit) for r in windows.cache_hits(df, ["k"], "t", 10).collect()) == [("j", 3, False), ("k", 0, False), ("k", 5, True), ("k", 10, True), ("k", 11, False), ("k", 25, False), ("k", 30, True)]
