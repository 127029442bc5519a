import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sparkloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node string, conv string, depth string, at string, `_sl` string"


def frame(spark, rows):
    """Turns with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", None, "y", "z", "w") for r in rows], SCHEMA)


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            same = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, same), (role, text)))
    turns = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(rows):
    """Every node from sets of members: (conv_id, depth) to the rest of its row."""
    members = defaultdict(set)
    ending = defaultdict(set)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ending[tuple(turns)].add(c)
    out = {}
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = sum(len(x) == len(node) + 1 for x in below)
        leaves = sum(not any(y != x and y[: len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        hashed = hashlib.sha256(",".join(map(str, sorted(ending[node]))).encode()).hexdigest()
        out[min(convs), len(node)] = (min(members[node[:-1]]) if node else None, len(convs), children, leaves, saved, hashed)
    return out


def check(spark, rows):
    got = pt.prefix_trie(*pt.shared_heads(pt.placed(pt.turns(frame(spark, rows))))).collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == want


def talks(seed, n=60, words="ab"):
    """Conversations that share prefixes, with copies, a long one, null turns, roles and texts, ties and repeated rows."""
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 4, 7])):
            out.append((c, t, rng.choice(["user", "user", None]), rng.choice([*words, "a b", "", None])))
    out += [(100, t, "user", "a") for t in range(70)] + [(120, t, "user", "a") for t in range(69)] + [(121, t, "user", "a") for t in range(65)]
    out += [(200, None, "user", "late"), (200, 1, "user", "x"), (200, 1, "user", "x"), (200, 1, "b", "y"), (None, 0, "user", "a"), (-3, 0, "user", "a b"), (-41, 0, "u", "v"), (301, 5, "user", "x")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, hot, ids", [(0, 1000, 65536), (1, 2, 3)])
def test_nodes_by_brute_force(spark, monkeypatch, seed, hot, ids):
    monkeypatch.setattr(pt, "HOT", hot)
    monkeypatch.setattr(pt, "IDS", ids)
    check(spark, talks(seed))


def test_a_deep_trie_of_nested_chains(spark):
    """Each conversation leaves the one before it a turn later, so that chains hang on chains."""
    check(spark, [(20 * c + 1, t, "user", "s" if t <= c else f"own {c}") for c in range(12) for t in range(c + 4)])


def test_no_conversations(spark):
    check(spark, [])


def test_running_totals_over_ranges(spark):
    """A key that straddles many ranges has the same totals as in one."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 50).alias("k"), "id", (F.col("id") % 11).alias("v"))
    got = pt.running(rows, "k", [F.desc("id")], {"s": (F.col("v"), "sum"), "x": (F.col("v"), "bit_xor")}).collect()
    sums = defaultdict(lambda: (0, 0))
    for r in sorted(got, key=lambda r: -r.id):
        s, x = sums[r.k]
        sums[r.k] = s + r.v, x ^ r.v
        assert (r.s, r.x) == sums[r.k]
    assert len(got) == 4000
