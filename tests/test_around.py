"""Enrichment without a row for each pair of incident and finding, against a plain walk."""

import hashlib
import random
from pathlib import Path

import pytest
from emberline.operators import incidents
from pyspark.sql import functions as F
from test_scale import FINDING, finding


@pytest.fixture
def enriched(spark, monkeypatch):
    """Incidents whose pairs can't be made, and the supporting ids that they should have."""
    rng = random.Random(8)
    primary = [finding(i, "defender_detection", rng.randrange(10**5), [f"e{i}", f"e{i + 1}"] if i % 3 else [f"e{i}"], [], "high") for i in range(30)]
    context = [finding(100 + i, "browser_activity", rng.randrange(10**5), [f"e{rng.randrange(60)}"]) for i in range(80)]
    found = spark.createDataFrame(primary + context, FINDING)
    incs = incidents.incidents(found.where("rule_name = 'defender_detection'"))
    want = {r["incident_id"]: r["supporting_correlation_ids"] for r in incidents.enrich(incs, found).listed().collect()}
    monkeypatch.setattr(incidents, "within_windows", lambda w, m, *_: w.crossJoin(m).where(F.raise_error(F.lit("pairs were made")).isNull()))
    return incidents.enrich(incs, found), want


def test_counts_and_lists_make_no_pairs(enriched):
    incs, want = enriched
    assert {r["incident_id"]: r["n_supporting"] for r in incs.head.collect()} == {i: len(ids) for i, ids in want.items()}
    got = {r["incident_id"]: r for r in incs.supporting_lists(2, "|").collect()}
    assert {i: r["first"] for i, r in got.items()} == {i: ids[:2] for i, ids in want.items()}
    assert {i: r["digest"] for i, r in got.items()} == {i: hashlib.sha256("|".join(ids).encode()).hexdigest() if ids else None for i, ids in want.items()}
    assert {r["incident_id"]: r["first"] for r in incs.supporting_lists(1).collect()} == {i: ids[:1] for i, ids in want.items()}


def test_verdicts_make_no_pairs(spark, enriched):
    incs, want = enriched
    least = {r["incident_id"]: r["c"] for r in incs.primary().groupBy("incident_id").agg(F.min("correlation_id").alias("c")).collect()}
    given = spark.createDataFrame([(i, "PARTIALLY_AGREE", [least[i], *ids[2:3], "unknown"], ids[:2]) for i, ids in want.items()], "incident_id string, verdict string, remove array<string>, promote array<string>")
    before = {r["incident_id"]: r["n_primary"] for r in incs.head.collect()}
    out, changes = incidents.apply_verdicts(incs, given)
    got = {r["incident_id"]: (r["n_primary"], r["n_supporting"]) for r in out.head.collect()}
    assert got == {i: (before[i] - 1 + len(ids[:2]), len(ids[3:])) for i, ids in want.items()}
    assert sorted(tuple(r) for r in changes.collect()) == sorted([(i, least[i], "removed") for i in want] + [(i, c, "removed") for i, ids in want.items() for c in ids[2:3]] + [(i, c, "promoted") for i, ids in want.items() for c in ids[:2]])


def test_tables_of_steps_go(spark):
    """What incidents are made of is deleted once they are written."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    incs = incidents.incidents(spark.createDataFrame([finding(i, "browser_activity", i, [f"e{i // 4}"]) for i in range(20)], FINDING))
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {"event_ids", "entity_ids", "primary", "incidents"}
    assert incs.listed().count() == 5
