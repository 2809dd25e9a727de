"""Indicators of any size: in parts, and merged one part at a time."""

import json
from pathlib import Path

from emberline.operators import ioc
from pyspark.sql import functions as F


def merged(spark, n=40):
    rows = spark.range(n).select(F.lit("domain").alias("ioc_type"), F.when(F.col("id") % 10 == 0, "b.example").otherwise("A.example").alias("value"), F.lit("x").alias("source_artifact"), *[F.lit("2024-01-01").cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")], F.lit(0.5).alias("confidence"), F.array(F.format_string("e%03d", "id")).alias("event_ids"), F.array(F.format_string("c%03d", F.col("id") % 7)).alias("correlation_ids"), F.lit("s").alias("snippet"), F.lit(None).cast("string").alias("severity"), F.struct("id").alias("cand_ord"))
    lookup = spark.range(7).select(F.format_string("c%03d", "id").alias("correlation_id"), F.format_string("i%03d", F.col("id") % 2).alias("incident_id"))
    return ioc.merge(rows, lookup)


def test_parts_make_the_whole_text(spark, monkeypatch):
    """No part has more than PART ids, and the parts together say what the one text says."""
    monkeypatch.setattr(ioc, "PART", 3)
    iocs = merged(spark)
    whole = {r["key"]: json.loads(r["json"]) for r in ioc.serialize(iocs).collect()}
    parts = ioc.serialize_parts(iocs).collect()
    got = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        said = json.loads(r["json"])
        assert all(len(v) <= 3 for k, v in said.items() if k.endswith("_ids"))
        mine = got.setdefault(r["key"], {f"{n}_ids": [] for n in ("event", "correlation", "incident")})
        for k, v in said.items():
            mine[k] = mine[k] + v if k.endswith("_ids") else v
    assert got == whole and len(got["a.example"]["event_ids"]) == 36


def test_parts_of_the_merge_go(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    iocs = merged(spark)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {"indicator-rows", "indicator-findings", "indicator-incidents", "indicators"}
    assert {r["key"]: (r["n_events"], r["n_correlations"], r["n_incidents"], r["some_incidents"]) for r in iocs.head.collect()} == {"a.example": (36, 7, 2, ["i000", "i001"]), "b.example": (4, 4, 2, ["i000", "i001"])}
