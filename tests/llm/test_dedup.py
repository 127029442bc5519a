import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bloom, decontaminate as dc, exact_dedup as ed, simhash as sh, substring_dedup as sd
from sparkloom.llm.components import connected_components
from sparkloom.llm.common import local_components

SCHEMA = "doc_id long, text string, id string, fp string, h string, key string, component string, p_doc string, packed string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *(["x", None][k % 2] for k in range(7))) for i, t in rows], SCHEMA)


def texts(seed=0, n=60):
    """Random texts of few words with copies, near copies, shared passages, empties, nulls, ties and a very long one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    shared = " ".join(word() for _ in range(30))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([0, 1, 2, 3, 8, 30, 120]))]
        kind = rng.randrange(6)
        if kind == 0 and out:
            out.append((i, rng.choice(out)[1]))
            continue
        if kind == 1 and out and (old := rng.choice(out)[1]):
            parts = old.split(" ")
            parts[rng.randrange(len(parts))] = word()
            out.append((i, " ".join(parts)))
            continue
        text = "\n ".join(words)
        out.append((i, f"{text} {shared} {word()}" if kind == 2 else text))
    long = " ".join(word() for _ in range(5000))
    return [*out, (n, None), (n + 1, ""), (n + 2, long), (n + 3, long + " é"), (None, shared), (None, "x y"), (5, "other text"), (5, "other text"), (5, shared)]


def brute_groups(rows):
    best = {}
    for i, t in rows:
        best.setdefault(t or "", []).append(-(2**63) if i is None else i)
    return {t: (max(v), len(v)) for t, v in best.items()}


@pytest.mark.parametrize("hot, slices", [(1000, 1), (2, 1), (1000, 4)])
def test_exact_groups(spark, monkeypatch, hot, slices):
    monkeypatch.setattr(ed, "HOT", hot)
    monkeypatch.setattr(bloom, "slices_for", lambda n: slices)
    rows = texts()
    want = brute_groups(rows)
    got = ed.exact_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    import hashlib

    sums = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for r in got:
        keep, size = sums[r.text_sha256]
        assert (r.keep_id if r.keep_id is not None else -(2**63), r.group_size) == (keep, size)
    assert sum(r.kept for r in got) == len(want)


@pytest.mark.parametrize("slices", [1, 3])
def test_exact_dedup_keeps_whole_rows(spark, monkeypatch, slices):
    monkeypatch.setattr(bloom, "slices_for", lambda n: slices)
    rows = texts()
    df = frame(spark, rows)
    got = ed.exact_dedup(df)
    assert got.columns == df.columns
    want = {t: (None if i == -(2**63) else i) for t, (i, _) in brute_groups(rows).items()}
    assert {r.text or "": r.doc_id for r in got.collect()} == want and got.count() == len(want)


def test_exact_dedup_is_native(spark):
    plan = ed.exact_groups(frame(spark, texts()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filters_lose_nothing(spark, monkeypatch, n):
    keys = spark.range(n).selectExpr("concat('k', id) as k")
    twice = keys.where("hash(k) % 3 = 0")
    blocks = bloom.blocks_for(n)
    both = keys.union(twice)
    flagged = bloom.probe(both, bloom.repeated(both, "k", blocks), blocks, "k", "maybe")
    assert flagged.count() == both.count()
    assert flagged.join(twice, "k", "left_semi").where("not maybe").count() == 0
    for most in (8192, 1):
        monkeypatch.setattr(bloom, "MAX_BLOCKS", most)
        monkeypatch.setattr(bloom, "BITS_EACH", 16 if most > 1 else 64)
        ids = spark.range(n).selectExpr("id as k", "cast(id as string) as _sl_x")
        gone = ids.where("hash(k) % 3 = 0").selectExpr("k as g")
        assert bloom.slices_for(gone.count()) == (1 if most > 1 else max(1, -(-gone.count() * 64 // bloom.BLOCK)))
        assert sorted(r.k for r in bloom.without(ids, "k", gone, "g").collect()) == sorted(r.k for r in ids.where("hash(k) % 3 <> 0").collect())


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(ids):
        least[root(i)] = min(least.get(root(i), k), k)
    return [least[root(i)] for i in range(len(ids))]


@given(st.text(alphabet="aBc é\t\n\x1cZ", max_size=200))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert sh.fingerprint(text) == brute_fingerprint(text)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
@settings(max_examples=300, deadline=None)
def test_every_close_pair_meets_at_a_home(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    fps = np.array([x, y], np.uint64).view(np.int64)
    row, key, home = sh.anchors(fps)
    of = lambda r: set(key[row == r].tolist())
    homes = [set(key[(row == r) & home].tolist()) for r in (0, 1)]
    assert all(len(h) == 1 for h in homes)
    assert homes[0] <= of(1) and homes[1] <= of(0)
    assert len(of(0)) == (row == 0).sum()  # no anchor twice


@pytest.mark.parametrize("most", [20_000, 3])
def test_near_groups(spark, monkeypatch, most):
    monkeypatch.setattr(sh, "MAX_HOMES", most)
    rows = texts(3, 80)
    got = sorted((r.id, r.fp & (2**64 - 1), r.component) for r in sh.near_groups(frame(spark, rows)).collect())
    ids = [-(2**63) if i is None else i for i, _ in rows]
    fps = [brute_fingerprint(t) for _, t in rows]
    assert got == sorted(zip(ids, fps, brute_components(ids, fps), strict=True))


@pytest.mark.parametrize("most", [20_000, 7])
def test_links_of_chosen_fingerprints(spark, monkeypatch, most):
    """A dense cluster around one point, chains of close pairs and random ones."""
    monkeypatch.setattr(sh, "MAX_HOMES", most)
    monkeypatch.setattr(sh, "PAIRS", 64)
    rng = random.Random(1)
    center = rng.getrandbits(64)
    fps = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(64)}
    x = rng.getrandbits(64)
    for _ in range(30):
        x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    want = brute_components(fps, fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    links = [(r.src, r.dst) for r in sh.fingerprint_links(df).collect()]
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 64
        parent[root(a)] = root(b)
    groups = lambda pairs: sorted(sorted(g) for g in _collect(pairs))
    assert groups(zip(signed, map(root, signed), strict=True)) == groups(zip(signed, want, strict=True))


def _collect(pairs):
    out = {}
    for x, g in pairs:
        out.setdefault(g, []).append(x)
    return out.values()


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (None, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = {}
    if real:
        nodes, roots = local_components(*map(np.array, zip(*real, strict=True)))
        want = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert got == want


def brute_substrings(rows, window):
    keyed = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in keyed:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in keyed:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), b" ".join(kept).decode()))
    return sorted(out)


@pytest.mark.parametrize("window, buffer", [(20, 1 << 19), (4, 64), (2, 7), (1, 1 << 19)])
def test_remove_repeats(spark, monkeypatch, window, buffer):
    monkeypatch.setattr(sd, "BUFFER", buffer)
    rows = texts(7, 50)
    got = sd.remove_repeats(frame(spark, rows).repartition(3), window=window).collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substrings(rows, window)
    for r in got:
        assert sum(b - a for a, b in zip(r.removed[::2], r.removed[1::2], strict=True)) == r.n_removed


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 8))
@settings(max_examples=150, deadline=None)
def test_rolling_hashes_tell_windows_apart(values, size):
    hashed = np.array([xxhash.xxh64_intdigest(bytes([v])) for v in values], np.uint64)
    got = sd.rolling(hashed, size, sd.BASES[0]).tolist()
    windows = [tuple(values[i : i + size]) for i in range(len(values) - size + 1)]
    assert len(got) == len(windows)
    assert len(set(zip(got, windows, strict=True))) == len(set(got)) == len(set(windows))


def test_intervals_merge():
    runs = lambda *pairs: np.array([a << 32 | b for a, b in pairs])
    assert sd.intervals(runs((20, 20), (0, 0), (3, 3), (4, 4)), 5) == [(0, 9), (20, 25)]
    assert sd.intervals(runs((0, 0), (5, 5)), 5) == [(0, 10)]
    assert sd.intervals(runs((0, 9), (2, 3), (30, 31)), 5) == [(0, 14), (30, 36)]
    assert sd.intervals(runs(), 5) == []


@pytest.mark.parametrize("buffer", [1, 200, 1 << 20])
def test_windows_of_rows_that_share_ids_and_hot_passages(spark, monkeypatch, buffer):
    """A third of all rows are copies, one passage is in most rows, null ids repeat."""
    monkeypatch.setattr(sd, "BUFFER", buffer)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    passage, copied = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(40))
    rows = [(rng.choice([None, i, 3]), copied if i % 3 == 0 else f"{' '.join(word() for _ in range(rng.randrange(30)))} {passage} {' '.join(word() for _ in range(rng.randrange(9)))}") for i in range(90)]
    got = sd.remove_repeats(frame(spark, rows).repartition(5), window=6).collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substrings(rows, 6)


def test_windows_are_shuffled_once_and_texts_stay(spark):
    df = frame(spark, texts(7, 50)).select(sd.id_key("doc_id").alias("id"), sd.F.lit(0).alias("tag"), "text")
    plan = sd.late_windows(df, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange ") == 2 and plan.count("shufflepartitionidpassthrough") == 1


def brute_contained(doc, item):
    a, b = dc.tokens(doc), dc.tokens(item)
    if not a or not b:
        return None
    size = min(5, len(b))
    of = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
    own = {tuple(a[i : i + size]) for i in range(len(a) - size + 1)}
    shared = len(of & own)
    return (shared, len(of)) if shared >= 0.8 * len(of) - 1e-9 else None


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_no_contained_item_is_missed(threshold):
    """Recall of the search is 1: items of each size class with as many changed shingles as the threshold allows, inside long documents; and
    the sketches let few others through."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 9, 12, 20, 40, 64, 65, 90, 150, 400] * 3)]
    index = dc.Index(items, threshold)
    assert len({(p.size, p.need) for p in index.parts}) > 5
    found = tried = 0
    for k, text in items:
        words = text.split()
        for _ in range(4):
            own = list(words)
            for _ in range(rng.randrange(1 + len(words) // 10)):
                own[rng.randrange(len(own))] = word()
            doc = " ".join([*(word() for _ in range(2000)), *own, *(word() for _ in range(2000))])
            want = dc.shingles(words)
            if len(want & dc.shingles(doc.split(), min(5, len(words)))) >= threshold * len(want) - 1e-9:
                tried += 1
                found += k in {x for x, _, _ in index.search(doc)}
            assert len(index.candidates(dc._word_hashes(doc.split()))) <= 3
    assert tried > 30 and found == tried


def test_find_contaminated(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS", 4)
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "of", "The"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 7, 30, 60])))) for k in range(12)] + [(12, None), (13, ""), (0, "again alpha beta gamma delta of")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.choice([0, 3, 50, 400]))]
        if i % 2:
            part = (rng.choice(items)[1] or "").upper().split()
            if len(part) > 10 and i % 4 == 1:
                part[len(part) // 2] = "changed"
            body[len(body) // 2 : len(body) // 2] = part
        docs.append((i, ", ".join(body)))
    docs += [(None, items[5][1]), (60, None), (7, items[6][1])]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.id, r.item_id, r.n_shared, r.n_item) for r in dc.find_contaminated(frame(spark, docs), item_df).collect())
    want = sorted((-(2**63) if i is None else i, k, *found) for i, t in docs for k, item in items if (found := brute_contained(t, item)))
    assert got == want and want
    kept = dc.decontaminate(frame(spark, docs), item_df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if (-(2**63) if i is None else i) not in {w[0] for w in want})
    assert dc.find_contaminated(frame(spark, docs), item_df.limit(0)).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ed.exact_groups(none).count() == ed.exact_dedup(none).count() == 0
    assert sh.near_groups(none).count() == sh.near_dedup(none).count() == 0
    assert sd.remove_repeats(none).count() == 0


def test_near_dedup_keeps_the_smallest_id(spark):
    rows = texts(11, 60)
    df = frame(spark, rows)
    ids = [-(2**63) if i is None else i for i, _ in rows]
    groups = brute_components(ids, [brute_fingerprint(t) for _, t in rows])
    gone = {i for i, g in zip(ids, groups, strict=True) if i != g}
    got = sh.near_dedup(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r, i in zip(rows, ids, strict=True) if i not in gone)


def test_rows_with_shared_or_null_ids_are_decided_each_on_its_own(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(40))
    item, copied = text(), text()
    clean = [(None, text()), (None, text()), (7, text()), (7, text())]
    dirty = [(None, f"{text()} {item}"), (7, f"{text()} {item} {text()}")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = dc.decontaminate(frame(spark, clean + dirty), items)
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in clean) and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    copies = [(None, copied), (None, copied + " "), (7, copied), (9, copied)]
    near = sh.near_dedup_rows(frame(spark, clean + copies).repartition(3))
    assert sorted((str(r.doc_id), r.text.strip()) for r in near.collect()) == sorted((str(i), t) for i, t in [*clean, (None, copied)])


def test_blocks_are_bounded_by_letters(spark, monkeypatch):
    items = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([2, 2, 50, 1, 0, 3])] + [(6, None)], "item_id bigint, text string").coalesce(1)
    monkeypatch.setattr(dc, "LETTERS", 25)
    assert [[i for i, _ in b] for b in dc._blocks(items)] == [[0, 1], [2], [3, 4, 5, 6]]
    docs = spark.createDataFrame([(1, "word " * 60), (2, "word word"), (3, "other")], "doc_id bigint, text string")
    some = sorted(map(tuple, dc.find_contaminated(docs, items).collect()))
    monkeypatch.setattr(dc, "LETTERS", 6_000_000)
    assert some == sorted(map(tuple, dc.find_contaminated(docs, items).collect())) and len(some) > 5


def test_blocks_of_items_filter_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS", 1)
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z")], "item_id long, text string")
    rows = [(None, "a b c d e f g"), (None, "t u v w x y z"), (None, "plain"), (None, None)]
    assert sorted(str(r.text) for r in dc.decontaminate(frame(spark, rows), items).collect()) == ["None", "plain"]
    assert dc.decontaminate(frame(spark, rows), items.limit(0)).count() == 4


def test_scratch_can_be_cleared(spark):
    from sparkloom.llm import common

    path = common._scratch(spark).removeprefix("file://").removeprefix("file:")
    common.materialize(spark.range(3), "x")
    import os

    assert os.path.isdir(path)
    common.clear_scratch(spark)
    assert not os.path.exists(path)
    assert common.materialize(spark.range(3), "y").count() == 3


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from sparkloom.llm import common
    from sparkloom.sources import tables

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    for folder in (common.shared_dir, tables.shared_folder):
        with pytest.raises(RuntimeError):
            folder(bare)


def test_partitions_follow_the_files(spark, tmp_path):
    from sparkloom.llm import common

    path = str(tmp_path / "t")
    spark.range(200_000).selectExpr("id", "sha2(cast(id as string), 256) as t").write.parquet(path)
    df = spark.read.parquet(path)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions_for(df, 1 << 40) == common.partitions_for(spark.createDataFrame([(1,)], "a int"), 1 << 30) == least
    assert common.partitions_for(df.join(df, "id"), 1 << 20) > least
    assert 10 <= common.partitions_for(df, 1 << 20) < common.partitions_for(df, 1) == common.PARTITIONS
