import hashlib
import random
import zlib

import pytest

from emberline.llm import prefix_trie
from emberline.operators import digests


def by_hand(rows):
    """Every node of the trie, worked out conversation by conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    said = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        said[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members = {}
    for c in sorted(said):
        for d in range(len(said[c]) + 1):
            members.setdefault(said[c][:d], []).append(c)
    below = {k: [0, 0, 0] for k in members}
    for node, cs in members.items():
        leaf = all(len(said[c]) == len(node) for c in cs)
        saved = (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            below[node[:-1]][0] += 1
        for d in range(len(node) + 1):
            below[node[:d]][1] += leaf
            below[node[:d]][2] += saved
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(said[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)


def conversations(n, seed=1, most=12, texts=3):
    rng = random.Random(seed)
    return [(c, t, ("user", "assistant")[t % 2], f"text {rng.randrange(texts)} é") for c in rng.sample(range(3 * n), n) for t in range(rng.randrange(1, most))]


def test_nodes_are_those_of_a_plain_walk(spark):
    rows = conversations(60)
    rows += [(1000, 0, None, None), (1001, None, "user", "first"), (1001, 5, "user", ""), (1001, 3, None, "x"), (None, 1, "user", "no conversation"), (7_000_000_001, 1, "user", "text 0 é")]
    assert found(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("stretch", [1, 3])
def test_long_paths_in_many_bands_and_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "BAND", 2)
    monkeypatch.setattr(digests, "CHUNK_BYTES", 8)
    rows = conversations(25, seed=4, most=60, texts=1) + [(5, t, "user", "x" * (t % 3)) for t in range(150)]
    assert found(spark, rows) == by_hand(rows)


def test_conversations_that_are_all_alike(spark):
    rows = [(5 * c, t, "user", "hello") for c in range(400) for t in range(4)]
    assert found(spark, rows) == by_hand(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(df).count() == 0
    rows = [(3, 1, "user", "again"), (3, 1, "user", "again"), (3, 0, "user", "y" * 3_000_000)]
    clash = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS pos", "3 AS part", "4 AS place", "5 AS c1", "6 AS size", "map(1, 2) AS depth")
    assert sorted((tuple(r) for r in prefix_trie.trie(clash).collect()), key=str) == by_hand(rows)
