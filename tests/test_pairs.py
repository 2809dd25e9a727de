"""Pairs that share a key against plain Python, with keys of many rows."""

import random
from itertools import combinations, permutations

import pytest
from emberline.operators import incidents, pairs, timeline
from pyspark.sql import functions as F

FOUND = "rule_ord int, tl_pos long, event_ids array<string>, entity_ids array<string>, correlation_id string, start_time timestamp_ntz, evidence map<string, string>"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 5)


def some_findings(spark, n=60):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.sample(["e1", "e2", "e3", f"e{i}x"], rng.randrange(4)), rng.choice([["hot"], ["hot", "n"], ["n"], []])) for i in range(n)]
    return rows, spark.createDataFrame([(*r, f"c{r[1]}", None, {}) for r in rows], FOUND)


def above_join(df):
    """The plan's part that works on pairs."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    full = df._jdf.queryExecution().executedPlan().toString()
    return full[: full.index("Join")] + plan[: plan.index("Join")]


def test_candidate_pairs_come_once_and_are_not_shuffled(spark, small_blocks):
    rows, df = some_findings(spark)
    want = sorted(sorted([a[:2], b[:2]]) for a, b in combinations(rows, 2) if set(a[2]) & set(b[2]) or set(a[3]) & set(b[3]))
    found = incidents.edge_candidates(df)
    assert sorted([tuple(r.source_ord), tuple(r.target_ord)] for r in found.collect()) == want
    few = incidents.pairs_of(df, spark.createDataFrame([("v:e1",), ("n:n",)], "link string"))
    assert sorted([tuple(r.source_ord), tuple(r.target_ord)] for r in few.collect()) == sorted(sorted([a[:2], b[:2]]) for a, b in combinations(rows, 2) if "e1" in set(a[2]) & set(b[2]) or "n" in set(a[3]) & set(b[3]))
    assert not any(x in above_join(found) for x in ("Exchange", "Aggregate"))


def test_edges_do_not_shuffle_pairs(spark, small_blocks):
    rows, df = some_findings(spark)
    found = incidents.edges(df)
    assert found.count() == sum(1 for a, b in combinations(rows, 2) if set(a[2]) & set(b[2]) or set(a[3]) & set(b[3]))
    assert not any(x in above_join(found) for x in ("Exchange", "Aggregate"))


def test_related_events_of_one_key_lie_in_several_tasks(spark, small_blocks):
    tl = spark.range(40).select(F.col("id").alias("tl_pos"), F.concat(F.lit("e"), "id").alias("event_id"), F.when(F.col("id") < 36, "hot").alias("entity_id"))
    found = timeline.related(tl, "entity_id")
    assert sorted((r.event_id, r.related_event_id) for r in found.collect()) == sorted(permutations((f"e{i}" for i in range(36)), 2))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
