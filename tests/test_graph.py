import random

import pytest
from emberline.operators import graph
from pyspark.sql import functions as F


def by_hand(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        ends = [find(x) for x in (a, b) if x is not None]
        if len(ends) == 2:
            root[max(ends)] = min(ends)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_random_graphs(spark, kind):
    rng = random.Random(3)
    name = int if kind == "long" else "n{}".format
    pairs = [(name(rng.randrange(300)), name(rng.randrange(300))) for _ in range(180)] + [(name(900), name(900)), (name(901), None), (None, name(902)), (None, None)]
    got = graph.components(spark.createDataFrame(pairs, f"a {kind}, b {kind}"))
    assert {r["node"]: r["root"] for r in got.collect()} == by_hand(pairs)
    assert graph.components(spark.createDataFrame([], f"a {kind}, b {kind}")).count() == 0


@pytest.fixture
def rounds(monkeypatch):
    """Counts rounds."""
    seen = []
    small = graph._small_star
    monkeypatch.setattr(graph, "_small_star", lambda edges: (seen.append(1), small(edges))[1])
    return seen


def test_a_path_takes_few_rounds(spark, rounds):
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    path = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert graph.components(path).groupBy("root").count().collect()[0].asDict() == {"root": 0, "count": 10_000}
    assert len(rounds) < 20


def test_a_path_in_order_takes_few_rounds(spark, rounds):
    path = spark.range(9_999).select("id", (F.col("id") + 1).alias("next"))
    assert graph.components(path, "id", "next").groupBy("root").count().collect()[0].asDict() == {"root": 0, "count": 10_000}
    assert len(rounds) < 20


def test_a_star_with_a_million_points(spark, rounds):
    star = spark.range(1_000_000).select(F.lit(2_000_000).alias("hub"), "id")
    got = graph.components(star, "hub", "id").groupBy("root").count().collect()
    assert [r.asDict() for r in got] == [{"root": 0, "count": 1_000_001}]
    assert len(rounds) < 5
