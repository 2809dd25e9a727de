"""Correlation rules: from the timeline (with entity_id and tl_pos) to findings of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

from . import scan
from .store import written

#: Rule to technique ids.
TECHNIQUES = {
    "powershell_execution": ["T1059.001"],
    "browser_download_execution": ["T1105", "T1204.002"],
    "registry_persistence": ["T1547.001"],
    "scheduled_task_persistence": ["T1053.005"],
    "service_installation": ["T1543.003"],
    "browser_activity": ["T1016"],
    "event_log_cleared": ["T1070.001"],
    "defender_detection": ["T1562.001"],
    "usb_connection": ["T1091"],
}
#: Rules of one event: artifact type, then event type to title and description, and severity.
SINGLE = {
    "registry_persistence": ("registry", {"persistence": ("Registry Run/RunOnce persistence", "Registry persistence mechanism observed."), "service_created": ("Windows service persistence", "Windows service persistence observed.")}, "low"),
    "scheduled_task_persistence": ("scheduled_task", {"persistence": ("Scheduled Task persistence", "Scheduled Task persistence mechanism observed.")}, "low"),
    "service_installation": ("evtx", {"service_install": ("Windows service installed (Event ID 7045)", "Windows service installation observed (System log, Event ID 7045).")}, "low"),
    "defender_detection": ("defender", {"malware_detection": ("Windows Defender detection", "Windows Defender reported a threat detection.")}, "high"),
    "event_log_cleared": ("evtx", {"log_cleared": ("Windows event log cleared", "A Windows event log was cleared -- possible anti-forensic activity.")}, "high"),
    "usb_connection": ("registry", {"usb_device_connected": ("USB storage device observed", "USB storage device presence recorded in USBSTOR (registry key last-write time, not a live connection timestamp).")}, "low"),
    "browser_activity": ("browser", {"url_visit": ("Browser page visit", "Browser page visit observed."), "file_download": ("Browser file download", "Browser file download observed.")}, "low"),
}
RULES = (*SINGLE, "powershell_execution", "browser_download_execution")
#: Program names.
POWERSHELL = ("powershell.exe", "powershell_ise.exe", "pwsh.exe")
#: Indicator to pattern and label.
INDICATORS = {
    "execution_policy_bypass": (r"-ep\s+bypass|-executionpolicy\s+bypass", "execution policy bypass"),
    "encoded_command": (r"-enc(?:odedcommand)?\b", "encoded command"),
    "hidden_window": (r"-window(?:style)?\s+hidden", "hidden window"),
    "reflective_load": (r"\[reflection\.assembly\]::load", "reflective in-memory assembly load"),
    "base64_payload": (r"frombase64string", "Base64-encoded payload"),
    "download_cradle": (r"net\.webclient|downloadstring|downloaddata|invoke-webrequest|\biwr\b", "remote download cradle"),
    "invoke_expression": (r"\biex\b|invoke-expression", "Invoke-Expression / IEX"),
}
#: Indicators by severity, and the days between a download and its execution.
HIGH, MEDIUM = ("reflective_load", "base64_payload"), ("execution_policy_bypass", "encoded_command", "download_cradle", "invoke_expression")
WINDOW_DAYS = 7


def finding(rows: DataFrame, rule: Column, order: Column, title: Column, severity: Column, confidence: Column, event_ids: Column, description: Column, evidence: Column, end: str | Column = "timestamp") -> DataFrame:
    """The finding schema; ids follow from the rule and the events."""
    return rows.select(
        F.sha2(F.concat_ws("|", rule, event_ids), 256).alias("correlation_id"),
        rule.alias("rule_name"),
        title.alias("title"),
        severity.alias("severity"),
        confidence.cast("double").alias("confidence"),
        F.col("timestamp").alias("start_time"),
        C.col(end).alias("end_time"),
        event_ids.alias("event_ids"),
        C.strings("entity_id").alias("entity_ids"),
        description.alias("description"),
        evidence.alias("evidence"),
        order.cast("int").alias("rule_ord"),
        F.col("tl_pos"),
    )


def _hit(rule: str, title, severity, confidence, description, evidence: Column) -> Column:
    """What a rule says of one event."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(RULES.index(rule)).alias("order"),
        F.lit(rule).alias("rule"),
        text(title).alias("title"),
        text(severity).alias("severity"),
        text(confidence).cast("double").alias("confidence"),
        text(description).alias("description"),
        evidence.alias("evidence"),
    )


def _single_hit(rule: str, columns: list[str]) -> Column:
    """The hit of a rule of :data:`SINGLE`, or NULL."""
    artifact, kinds, severity = SINGLE[rule]
    kind = F.col("event_type")
    chosen = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, said in kinds.items() for x in (k, said[i])]), kind)
    evidence = F.col("evidence_str")
    if rule == "usb_connection":
        names = [n for n in ("vendor", "product", "serial_number", "device_instance_id", "friendly_name") if n in columns]
        evidence = F.map_concat(evidence, C.text_map({n: n for n in names})) if names else evidence
    return F.when((F.col("artifact_type") == artifact) & kind.isin(*kinds), _hit(rule, chosen(0), severity, F.col("confidence"), chosen(1), evidence))


def indicators(text: Column) -> Column:
    """Sorted names of the indicators in a command line."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(f"(?iU){pattern}"), name) for name, (pattern, _) in INDICATORS.items()])))


def _powershell_hit(columns: list[str]) -> Column:
    """The hit of a PowerShell command line that has an indicator of a known severity, or NULL."""
    own = lambda c: C.truthy(c) if c in columns else F.lit(None).cast("string")
    command, host = own("command_line"), own("host_application")
    started = (F.col("event_type") == "process_execution") & F.lower("object_name").isin(*POWERSHELL)
    text = F.when(started, F.concat_ws(" ", command, host)).when(F.col("event_type") == "powershell_pipeline_execution", command)
    matched = F.when(F.col("artifact_type") == "evtx", indicators(text))
    of = lambda names: F.arrays_overlap(matched, F.array(*[F.lit(n) for n in names]))
    severity = F.when(of(HIGH), "high").when(of(MEDIUM), "medium")
    labels = F.create_map(*[F.lit(x) for name, (_, label) in INDICATORS.items() for x in (name, label)])
    said = F.concat(F.lit("PowerShell execution matched: "), F.array_join(F.array_sort(F.transform(matched, lambda m: F.element_at(labels, m))), ", "))
    kept = [n for n in ("command_line", "script_name", "host_application") if n in columns]
    evidence = C.text_map({"matched_indicators": F.array_join(matched, ",")} | {n: n for n in kept})
    return F.when(severity.isNotNull(), _hit("powershell_execution", "Suspicious PowerShell execution", severity, 0.75, said, evidence))


#: The rules that look at one event.
EVENT_RULES = (*SINGLE, "powershell_execution")


def with_hits(timeline: DataFrame, rules: tuple[str, ...] = EVENT_RULES) -> DataFrame:
    """The timeline with ``hits``: what each of the rules says of the event. One projection, whatever the number of rules."""
    columns = timeline.columns
    found = [_powershell_hit(columns) if r == "powershell_execution" else _single_hit(r, columns) for r in rules]
    return timeline.withColumn("hits", F.array_compact(F.array(*found)))


def _findings_of_hits(rows: DataFrame) -> DataFrame:
    each = rows.select("event_id", "timestamp", "entity_id", "tl_pos", F.explode("hits").alias("hit"))
    of = lambda c: F.col(f"hit.{c}")
    return finding(each, of("rule"), of("order"), of("title"), of("severity"), of("confidence"), F.array("event_id"), of("description"), of("evidence"))


def event_rule(rule: str):
    """A rule of :data:`EVENT_RULES` as an operator."""
    return lambda timeline: _findings_of_hits(with_hits(timeline, (rule,)))


powershell_execution = event_rule("powershell_execution")


def asof_within(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], left_time: str, right_time: str, right_order: str, days: int, left_id: str) -> DataFrame:
    """For each left row the earliest right row at or after it, within ``days``, that shares any of the keys.

    Rows of both sides are sorted by key and, backwards, by time; a left row takes the last right row
    that has gone by. The sort is by ranges and the last row is carried over their borders, so a key of
    any number of rows is spread over tasks; no pairs are made. Of equal times the right row with the smaller
    ``right_order`` wins; right rows of equal order count as one. Gives the left columns and ``match`` (the right row).
    """
    keyed = lambda keys: F.explode(F.array_distinct(F.array_compact(F.array(*[F.concat(F.lit(f"{i}|"), k) for i, k in enumerate(keys)]))))
    seen = F.struct(F.col(right_time).alias("t"), F.col(right_order).alias("o"))
    found = right.select(keyed(right_keys).alias("_key"), F.lit(None).alias("_id"), F.col(right_time).alias("_t"), seen.alias("_seen"))
    asked = left.select(keyed(left_keys).alias("_key"), F.col(left_id).alias("_id"), F.col(left_time).alias("_t"), F.lit(None).alias("_seen"))
    # at equal times the right rows come before the left ones, the one that wins last
    order = [F.col("_key").asc(), F.col("_t").desc(), F.col("_seen").isNull().asc(), F.col("_seen.o").desc()]
    carried = scan.running(scan.spread(asked.unionByName(found), order, "asof"), ["_key"], {"_next": scan.last(F.col("_seen"))})
    hits = carried.where(F.col("_id").isNotNull() & (F.col("_next.t") <= F.expr(f"_t + interval {days} days")))
    best = hits.groupBy("_id").agg(F.min("_next").alias("_next")).select("_id", F.col("_next.o").alias("_o"))
    named = right.select(F.col(right_order).alias("_o"), F.struct(*right.columns).alias("match")).dropDuplicates(["_o"])
    matched = best.join(named, "_o").drop("_o")
    return left.join(matched, F.col(left_id) == F.col("_id")).drop("_id")


def download_execution(timeline: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """A download and the first execution of the same entity or file name within the window."""
    prefetch = (F.col("artifact_type") == "prefetch") & (F.col("event_type") == "process_execution")
    pipeline = (F.col("artifact_type") == "evtx") & (F.col("event_type") == "powershell_pipeline_execution")
    named = timeline.withColumn("file", C.best_identity("object_name", "object_path"))
    fields = ["event_id", "timestamp", "tl_pos", "confidence", "object_name", "object_path", "entity_id", "file"]
    downloads = named.where((F.col("artifact_type") == "browser") & (F.col("event_type") == "file_download")).select(fields)
    runs = named.where(prefetch | pipeline).select(fields)
    keys = [F.col("entity_id"), F.col("file")]
    found = asof_within(downloads, runs, keys, keys, "timestamp", "timestamp", "tl_pos", days, "tl_pos")
    evidence = C.text_map({"download_path": "object_path", "executed_name": "match.object_name"})
    said = "A file downloaded through the browser was later executed, per Prefetch."
    rule = "browser_download_execution"
    texts = [F.lit(x) for x in (rule, RULES.index(rule), "Downloaded file was executed", "medium", said)]
    confidence = C.combined_confidence("confidence", "match.confidence")
    return finding(found, *texts[:4], confidence, F.array("event_id", "match.event_id"), texts[4], evidence, "match.timestamp")


#: Rule name to operator. Callers may run one alone.
OPERATORS = {rule: event_rule(rule) for rule in EVENT_RULES} | {"browser_download_execution": download_execution}


def run_rules(timeline: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """The findings of the rules, none merged; (rule_ord, tl_pos) is their order.

    The timeline is read once: one projection gives each event its hits and leaves out all events that
    bear on no rule; the rest is written, and both the hits and the pairs come from there.
    """
    marked = with_hits(timeline, tuple(r for r in EVENT_RULES if r in rules))
    alone = "browser_download_execution" not in rules
    if alone:
        return _findings_of_hits(marked)
    chained = F.col("event_type").isin("file_download", "process_execution", "powershell_pipeline_execution")
    fields = ["event_id", "timestamp", "tl_pos", "confidence", "artifact_type", "event_type", "object_name", "object_path", "entity_id", "hits"]
    rows = written(marked.where(chained | (F.size("hits") > 0)).select(fields), "hits")
    return _findings_of_hits(rows).unionByName(download_execution(rows))


def with_techniques(findings: DataFrame) -> DataFrame:
    known = F.create_map(*[x for rule, ids in TECHNIQUES.items() for x in (F.lit(rule), F.array(*[F.lit(i) for i in ids]))])
    return findings.withColumn("techniques", F.coalesce(F.element_at(known, F.col("rule_name")), C.strings()))
