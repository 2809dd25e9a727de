"""The tables behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

from .incidents import CONTEXTUAL, Incidents, members, severity_rank

#: Evidence keys that go into a summary.
IMPORTANT = ("command_line", "image", "process_name", "file_path", "target_path", "registry_key", "registry_value", "service_name", "task_name", "ip", "hostname", "domain", "url", "hash", "sha256", "sha1", "md5", "username")
VALUE_CHARS, BASE64_RUN = 500, r"[A-Za-z0-9+/]{80,}={0,2}"


def _count() -> Column:
    return F.col("n_primary") + F.col("n_supporting")


def noise_narrow() -> Column:
    """Low, with one finding and one rule at most."""
    return (F.col("severity") == "low") & (_count() <= 1) & (F.size("rule_names") <= 1)


def noise_wide() -> Column:
    """Low, with two findings at most or contextual rules only."""
    return (F.col("severity") == "low") & ((_count() <= 2) | F.forall("rule_names", lambda r: r.isin(*CONTEXTUAL)))


def tiers(prioritized: DataFrame, noise: Column, most_detailed: int | None = None) -> DataFrame:
    """tier: noise, detailed (the first ``most_detailed`` others by rank; None: all), summarized.

    Only a bounded head needs a rank among the others, so it is found by a top-k, not by a window over all.
    """
    marked = prioritized.withColumn("_noise", noise)
    if most_detailed is None:
        return marked.withColumn("tier", F.when(F.col("_noise"), "noise").otherwise("detailed")).drop("_noise")
    head = marked.where(~F.col("_noise")).orderBy("priority_rank").limit(most_detailed).select("incident_id", F.lit(True).alias("_head"))
    joined = marked.join(F.broadcast(head), "incident_id", "left")
    return joined.withColumn("tier", F.when(F.col("_noise"), "noise").when(F.col("_head"), "detailed").otherwise("summarized")).drop("_noise", "_head")


def overview(incs: DataFrame, timeline: DataFrame) -> DataFrame:
    """section, key, value: totals and time span, incidents by severity and by rule. ``incs`` are heads."""
    entry = lambda section, key, value: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    events = timeline.agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    span = F.inline(F.array(entry("total", F.lit("events"), F.col("n")), entry("span", F.lit("first"), C.iso("a")), entry("span", F.lit("last"), C.iso("b"))))
    found = incs.groupBy("severity", "rule_names").agg(F.count("*").alias("n"))
    one = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    total = one(found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "total", F.lit("incidents"), F.col("n"))
    severity = one(found.groupBy("severity").agg(F.sum("n").alias("n")), "severity", F.col("severity"), F.col("n"))
    rule = one(found.select(F.explode("rule_names").alias("rule"), "n").groupBy("rule").agg(F.sum("n").alias("n")), "rule", F.col("rule"), F.col("n"))
    return events.select(span).union(total).union(severity).union(rule)


def by_rule(incs: DataFrame) -> DataFrame:
    """rule_name, n: incidents that have the rule."""
    return incs.select(F.explode("rule_names").alias("rule_name")).groupBy("rule_name").agg(F.count("*").alias("n"))


def counts_by_type(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("artifact_type", "event_type").agg(F.count("*").alias("n"))


def findings_per_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_name").agg(F.count("*").alias("n"))


def incident_index(incs: DataFrame) -> DataFrame:
    times = [C.iso(c).alias(c) for c in ("start_time", "end_time")]
    return incs.select(F.substring("incident_id", 1, 12).alias("short_id"), "severity", "confidence", _count().alias("n_findings"), "n_events", F.array_join("rule_names", ", ").alias("rules"), *times)


def detailed_order() -> list[Column]:
    return [F.desc(severity_rank("severity")), F.desc("confidence"), F.desc("n_primary")]


def compact_value(value: Column) -> Column:
    """Base64 runs named by their length, and the whole cut at 500 characters with what is left out counted."""
    runs, rest = F.regexp_extract_all(value, F.lit(BASE64_RUN), F.lit(0)), F.split(value, BASE64_RUN, -1)
    marks = F.transform(runs, lambda r: F.concat(F.lit("<base64:"), F.length(r).cast("string"), F.lit(" chars omitted>")))
    short = F.when(F.size(runs) == 0, value).otherwise(F.array_join(F.transform(rest, lambda p, i: F.concat(p, F.coalesce(F.get(marks, i), F.lit("")))), ""))
    return F.when(F.length(short) <= VALUE_CHARS, short).otherwise(F.concat(F.substring(short, 1, VALUE_CHARS), F.lit("... <"), (F.length(short) - VALUE_CHARS).cast("string"), F.lit(" more chars truncated>")))


def compact_evidence(evidence: str = "evidence") -> Column:
    return F.transform_values(evidence, lambda _, v: compact_value(v))


def important_evidence(evidence: str = "evidence") -> Column:
    return F.map_filter(evidence, lambda k, _: k.isin(*IMPORTANT))


def techniques_per_incident(incs: Incidents, findings: DataFrame) -> DataFrame:
    """incident_id, techniques: distinct and sorted, of primary and supporting findings."""
    both = members(incs, findings).union(members(incs, findings, "supporting"))
    return both.select("incident_id", F.explode("techniques").alias("t")).groupBy("incident_id").agg(F.array_sort(F.collect_set("t")).alias("techniques"))


def powershell_commands(timeline: DataFrame) -> DataFrame:
    """Process executions of the event log that have a command line."""
    return timeline.where((F.col("artifact_type") == "evtx") & (F.col("event_type") == "process_execution") & C.truthy("command_line").isNotNull()).select("event_id", "timestamp", "object_name", "command_line")


def sru_network_summary(events: DataFrame) -> DataFrame:
    used = events.where("event_type = 'application_network_usage'")
    return used.groupBy("application", "user_sid", "network_interface", "profile_id").agg(F.sum("bytes_sent").alias("uploaded"), F.sum("bytes_received").alias("downloaded"), F.count("*").alias("samples"))


def mft_totals(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if("is_file").alias("files"), F.count_if("is_directory").alias("directories"), F.count_if(~F.coalesce("in_use", F.lit(False))).alias("deleted"))
