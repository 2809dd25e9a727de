"""The timeline: validation, total order, positions without a single-partition sort, neighbours, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import columns as C

from .pairs import pairs_within
from .scan import ranked

ORDER = ("timestamp", "artifact_type", "event_type", "_name", "ingest_seq", "emit_ord")
#: The keys of :func:`relation_keys`; the sixth is entity_id.
KEYS = ("process_key", "path_key", "user_key", "logon_key", "host_key")


def reject_reason(raw_time: str | None = None) -> Column:
    """The first reason why a row cannot enter the timeline, or NULL. ``raw_time`` tells a bad time from none."""
    missing = lambda c: C.truthy(c).isNull()
    late = F.when(C.truthy(raw_time).isNull(), "missing_timestamp").otherwise("invalid_timestamp") if raw_time else F.lit("missing_timestamp")
    checks = [F.when(missing(c), f"missing_{c}") for c in ("artifact_type", "event_type", "category")]
    return F.coalesce(*checks, F.when(F.col("evidence_str").isNull(), "evidence_not_a_dict"), F.when(F.col("timestamp").isNull(), late))


def validated(events: DataFrame, raw_time: str | None = None) -> DataFrame:
    """All rows with reject_reason; rows that are not meant for the timeline have one too."""
    eligible = F.coalesce(F.col("timeline_eligible"), F.lit(True)) if "timeline_eligible" in events.columns else F.lit(True)
    return events.withColumn("reject_reason", F.coalesce(reject_reason(raw_time), F.when(~eligible, "timeline_eligible_false")))


def positions(rows: DataFrame, order: tuple[str, ...], out: str = "tl_pos") -> DataFrame:
    """0, 1, 2, ... in the order of the columns; the rows are sorted by ranges and written out once.

    What follows reads that table, so the steps before it are not repeated. A moment that very many
    events share is cut like any other stretch of the order.
    """
    return ranked(rows, [F.col(c).asc_nulls_first() for c in order], out)


def timeline(events: DataFrame, raw_time: str | None = None) -> DataFrame:
    """Valid and eligible events with tl_pos, their place in the total order."""
    good = validated(events, raw_time).where("reject_reason IS NULL").drop("reject_reason")
    return positions(good.withColumn("_name", F.coalesce("object_name", F.lit(""))), ORDER).drop("_name")


def build_report(events: DataFrame, raw_time: str | None = None) -> DataFrame:
    """reason, n: input, output, and skipped rows by reason."""
    checked = validated(events, raw_time)
    by = checked.groupBy(F.coalesce("reject_reason", F.lit("output")).alias("reason")).agg(F.count("*").alias("n"))
    return by.union(by.agg(F.lit("input"), F.coalesce(F.sum("n"), F.lit(0))))


def skip_samples(events: DataFrame, raw_time: str | None = None, most: int = 20) -> DataFrame:
    """The first ``most`` skipped rows of each reason, in input order."""
    skipped = validated(events, raw_time).where("reject_reason IS NOT NULL")
    by = Window.partitionBy("reject_reason").orderBy("ingest_seq", "emit_ord")
    return skipped.withColumn("sample", F.row_number().over(by)).where(F.col("sample") <= most)


def neighbours(timeline: DataFrame) -> DataFrame:
    """prev_event_id and next_event_id, by two equi-joins on the position."""
    ids = timeline.select("tl_pos", "event_id")
    before = ids.select((F.col("tl_pos") + 1).alias("tl_pos"), F.col("event_id").alias("prev_event_id"))
    after = ids.select((F.col("tl_pos") - 1).alias("tl_pos"), F.col("event_id").alias("next_event_id"))
    return timeline.join(before, "tl_pos", "left").join(after, "tl_pos", "left")


def relation_keys(timeline: DataFrame) -> DataFrame:
    """The six keys by which events are related, trimmed and in lower case; columns that there are not give NULL."""
    have = lambda c: F.lower(F.trim(C.truthy(c))) if c in timeline.columns else F.lit(None).cast("string")
    path = F.lower(F.trim(C.first_truthy("object_path", "object_name")))
    return timeline.withColumns({"process_key": have("process_id"), "path_key": path, "user_key": have("user"), "logon_key": have("logon_id"), "host_key": have("host")})


def related_counts(timeline: DataFrame, key: str) -> DataFrame:
    """event_id, related: how many other events share the key."""
    sizes = timeline.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.count("*") - 1).alias("related"))
    return timeline.join(sizes, F.col(key) == F.col("_key"), "left").select("event_id", F.coalesce("related", F.lit(0)).alias("related"))


def related(timeline: DataFrame, key: str) -> DataFrame:
    """event_id, related_event_id: the pairs, which grow with the square of a key's events. On demand only."""
    rows = timeline.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "event_id", "tl_pos")
    pairs = pairs_within(rows, ["_key"], ["tl_pos"], "x.tl_pos <> y.tl_pos")
    return pairs.select(F.col("x.event_id").alias("event_id"), F.col("y.event_id").alias("related_event_id"))


def relation_classes(timeline: DataFrame) -> DataFrame:
    """relation, key, n: the events that a relation ties together, as one class with its size, for all six relations in one pass.

    Rows of :func:`relation_keys` have the members; the pairs (:func:`related`) can be drawn from both, for chosen keys.
    """
    keys = F.array(*[F.struct(F.lit(name).alias("relation"), F.col(name).alias("key")) for name in ("entity_id", *KEYS)])
    each = timeline.select(F.inline(keys)).where("key IS NOT NULL")
    return each.groupBy("relation", "key").agg(F.count("*").alias("n")).where("n > 1")
