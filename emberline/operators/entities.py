"""Entities: keys, ids, attributes, and the general resolution of events with several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

from .graph import components
from .store import written

WEAK, MEDIUM, STRONG = 1, 2, 3


def fallback_value():
    """The path, or else the name, unless it only names a host of many things; trimmed, in lower case."""
    usable = lambda c: F.when(C.truthy(c).isNotNull() & ~C.any_of(F.lower(F.trim(F.col(c))), C.GENERIC_HOSTS), F.lower(F.trim(F.col(c))))
    return F.coalesce(usable("object_path"), usable("object_name"))


def with_entity(timeline: DataFrame) -> DataFrame:
    """entity_key and entity_id of events with the one fallback key; a projection, no shuffle."""
    keyed = timeline.withColumn("entity_key", fallback_value())
    kind = F.concat(F.lit("fallback_object:"), F.coalesce("artifact_type", F.lit("unknown")))
    return keyed.withColumn("entity_id", F.when(F.col("entity_key").isNotNull(), C.digest(kind, F.lit("file"), "entity_key")))


def strongest_key(keys):
    """Of array<struct<kind, value, entity_type, strength>>: strongest first, then kind, type, value."""
    ranked = F.array_sort(F.transform(keys, lambda k: F.struct((-k["strength"]).alias("rank"), k["kind"].alias("kind"), k["entity_type"].alias("entity_type"), k["value"].alias("value"))))
    return F.get(ranked, F.lit(0))


def entity_id_of(keys):
    best = strongest_key(keys)
    return F.when(F.size(keys) > 0, C.digest(best["kind"], best["entity_type"], best["value"]))


def entities(timeline: DataFrame) -> DataFrame:
    """entity_id, name, path, aliases of entities with one weak key.

    The first event with a path names the entity; later names and paths that differ are aliases. If no
    event has a path, the last event names it.
    """
    known = timeline.where("entity_id IS NOT NULL").select("entity_id", "tl_pos", "object_name", "object_path")
    named = known.groupBy("entity_id").agg(F.min_by(F.struct("tl_pos", F.col("object_name").alias("name"), F.col("object_path").alias("path")), F.when(F.col("object_path").isNotNull(), F.col("tl_pos"))).alias("first"), F.max_by("object_name", "tl_pos").alias("last_name"))
    joined = known.join(named, "entity_id").where("first IS NOT NULL AND tl_pos > first.tl_pos")
    later = joined.select("entity_id", F.explode(F.array(F.when(~F.col("object_name").eqNullSafe(F.col("first.name")), F.col("object_name")), F.when(~F.col("object_path").eqNullSafe(F.col("first.path")), F.col("object_path")))).alias("alias"))
    aliases = later.where("alias IS NOT NULL").groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    out = named.join(aliases, "entity_id", "left")
    return out.select("entity_id", F.when(F.col("first").isNotNull(), F.col("first.name")).otherwise(F.col("last_name")).alias("name"), F.col("first.path").alias("path"), F.coalesce("aliases", C.strings()).alias("aliases"))


def resolve(events: DataFrame) -> DataFrame:
    """event_id, entity_id for events with several keys (``identity_keys``); does not depend on order.

    Strong and medium keys unite the events that share them. An event with weak keys only joins the one
    united group that its weak keys lead to. Those that lead to none are united by the weak keys they
    share; one that leads to several is ambiguous and gets the entity of its own strongest key. A group's
    entity is that of its strongest key, the smallest digest among equals. (Here order-free, where
    a sequential run lets later events take weak keys over.)
    """
    own = events.where(F.size("identity_keys") > 0).select("event_id", entity_id_of(F.col("identity_keys")).alias("own"), F.explode("identity_keys").alias("k"))
    keyed = written(own.select("event_id", "own", C.digest("k.kind", "k.entity_type", "k.value").alias("key"), F.col("k.strength").alias("strength")), "keys")
    united = written(_united(keyed.where(F.col("strength") >= MEDIUM), keyed), "united")
    weak = keyed.where(F.col("strength") == WEAK)
    alone = written(weak.join(united.select("event_id"), "event_id", "left_anti"), "weak-only")
    # what a weak key leads to: the one group, or that there are several
    leads = weak.join(united, "event_id").groupBy("key").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))
    led = alone.join(leads, "key", "left").groupBy("event_id").agg(F.min("own").alias("own"), F.min("low").alias("low"), F.max("high").alias("high"))
    led = written(led, "led")
    free = alone.join(led.where("low IS NULL").select("event_id"), "event_id", "left_semi")
    claimed = led.where("low IS NOT NULL").select("event_id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("own")).alias("entity_id"))
    return united.union(claimed).union(_united(free, free))


def _united(linking: DataFrame, keyed: DataFrame) -> DataFrame:
    """event_id, entity_id of the events that the keys of ``linking`` unite; the entity is that of the strongest key in ``keyed``."""
    roots = components(linking.select(F.concat(F.lit("e"), "event_id").alias("a"), F.concat(F.lit("k"), "key").alias("b")))
    grouped = written(roots.where("node LIKE 'e%'").select(F.substring("node", 2, 1000).alias("event_id"), "root"), "grouped")
    best = keyed.join(grouped, "event_id").groupBy("root").agg(F.min_by("key", F.struct((-F.col("strength")), "key")).alias("entity_id"))
    return grouped.join(best, "root").select("event_id", "entity_id")


def merge_entities(parts: DataFrame) -> DataFrame:
    """entity_id, strength, name, path, aliases, metadata (map of text to array of text) -> one row for each entity.

    The strongest part gives name and path (the first by name among equals); the others' are aliases;
    metadata values are united and sorted.
    """
    best = parts.groupBy("entity_id").agg(F.min_by(F.struct("name", "path"), F.struct((-F.col("strength")), "name", "path")).alias("b"), F.max("strength").alias("strength"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("aliases", C.strings()), C.strings("name", "path"))))).alias("all"))
    values = parts.select("entity_id", F.explode("metadata").alias("k", "v")).select("entity_id", "k", F.explode("v").alias("v"))
    united = values.groupBy("entity_id", "k").agg(F.array_sort(F.collect_set("v")).alias("v")).groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return best.join(united, "entity_id", "left").select("entity_id", "strength", "b.name", "b.path", F.array_sort(F.array_except("all", C.strings("b.name", "b.path"))).alias("aliases"), "metadata")
