"""Indicators of compromise: extractors, their merge, reports, and the candidates and answers of a model.

Every extractor gives rows of one schema: ioc_type, value, source_artifact, first_seen, last_seen,
confidence, event_ids, correlation_ids, snippet, severity, and cand_ord: the extractor's number and where
the row came from, which orders them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

from .incidents import Incidents
from .scan import ranked, spread
from .store import removed, written
from .tops import first_distinct

#: Patterns of indicators, file types, text fields and the report's groups.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
IPV6 = r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b|\b(?:[A-Fa-f0-9]{1,4}:){1,7}:\b"
URL = r"(?i)\bhttps?://[^\s\"'<>]+"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,24}\b"
HASHES = (("hash_sha256", 64), ("hash_sha1", 40), ("hash_md5", 32))
EXECUTABLES, SCRIPTS = (".exe", ".dll", ".sys", ".scr", ".com", ".msi"), (".ps1", ".vbs", ".js", ".bat", ".cmd", ".hta")
TEXT_FIELDS = ("object_path", "object_name", "command_line", "host_application", "description")
REPORT_GROUPS = {
    "IP Addresses": ("ipv4", "ipv6"), "Domains": ("domain",), "URLs": ("url",), "Files": ("file", "directory", "executable", "dropped_file", "unc_path"),
    "Registry": ("registry_key", "registry_value", "persistence_location"), "Scheduled Tasks": ("scheduled_task",), "Services": ("service", "driver"),
    "PowerShell": ("powershell_script", "command_line"), "Hashes": ("hash_md5", "hash_sha1", "hash_sha256"), "Certificates": ("certificate_thumbprint",),
    "Identity": ("username", "hostname", "computer_name"), "MITRE ATT&CK Techniques": ("mitre_technique",), "Mutexes": ("mutex",),
}
SNIPPETS = 5


# --- extractors: what they take from one event, one finding, or an event of a finding


def _sure(c: str | Column = "confidence") -> Column:
    return F.coalesce(F.nullif(C.col(c), F.lit(0.0)), F.lit(0.5))


def _candidate(name: str, ioc_type: str | Column, value: Column, snippet: Column | None = None, source: str | None = None, emit: int | Column = 0, severity: Column | None = None) -> Column:
    """A candidate of an extractor, with its place among those of one row; left out if it has no type or value."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    null = F.lit(None).cast("string")
    fields = {
        "extractor": F.lit(EXTRACTORS.index(name)),
        "ioc_type": text(ioc_type),
        "value": value,
        "source_artifact": text(source) if source else F.coalesce(C.truthy("artifact_type"), F.lit("unknown")),
        "snippet": null if snippet is None else C.truthy(snippet),
        "severity": null if severity is None else severity,
        "emit": text(emit).cast("int"),
    }
    kind, made = fields["ioc_type"], F.struct(*[c.alias(n) for n, c in fields.items()])
    return F.when(kind.isNotNull() & value.isNotNull(), made)


def _evidence(name: str) -> Column:
    return C.truthy(F.try_element_at("evidence_str", F.lit(name)))


def _own(columns: list[str], c: str) -> Column:
    return F.col(c) if c in columns else F.lit(None).cast("string")


def _files(columns: list[str]) -> list[Column]:
    """Paths, other than web addresses: UNC, downloaded, PowerShell, executable or script, other."""
    path, low = F.col("object_path"), F.lower("object_path")
    suffix = F.when(C.last_part(low).contains("."), F.concat(F.lit("."), F.try_element_at(F.split(low, r"\."), F.lit(-1)))).otherwise("")
    kind = (
        F.when(path.rlike(r"^\\\\[^\\\s]+\\[^\s\"']+"), "unc_path")
        .when((F.col("artifact_type") == "browser") & (F.col("event_type") == "file_download"), "dropped_file")
        .when(suffix == ".ps1", "powershell_script")
        .when(suffix.isin(*EXECUTABLES, *SCRIPTS), "executable")
        .otherwise("file")
    )
    usable = (path.contains("\\") | path.contains("/")) & ~low.rlike("^https?://")
    return [_candidate("files", kind, F.when(usable, path), F.col("description"))]


def _registry(columns: list[str]) -> list[Column]:
    """Keys, and name and data of values."""
    key = F.when(F.col("artifact_type") == "registry", _evidence("key_path"))
    named = F.concat(key, F.lit("\\"), C.truthy("object_name"), F.lit(" = "), C.truthy("object_path"))
    return [_candidate("registry", "registry_key", key, F.col("description"), "registry"), _candidate("registry", "registry_value", named, None, "registry", 1)]


def _powershell(columns: list[str]) -> list[Column]:
    """Command lines and scripts."""
    field = lambda n: F.coalesce(C.truthy(_own(columns, n)), _evidence(n))
    return [_candidate("powershell", "command_line", field("command_line")), _candidate("powershell", "powershell_script", field("script_name"), emit=1)]


def _browser(columns: list[str]) -> list[Column]:
    """Visited addresses, downloaded files, and web referrers of downloads."""
    own = F.col("artifact_type") == "browser"
    path, referrer = C.truthy("object_path"), _evidence("referrer")
    dropped = F.when(own & (F.col("event_type") == "file_download"), path)
    return [
        _candidate("browser", "url", F.when(own & (F.col("event_type") == "url_visit"), path), F.try_element_at("evidence_str", F.lit("browser")), "browser"),
        _candidate("browser", "dropped_file", dropped, F.concat(F.lit("referrer: "), referrer), "browser"),
        _candidate("browser", "url", F.when(dropped.isNotNull() & referrer.rlike("^https?://"), referrer), None, "browser", 1),
    ]


def _network(columns: list[str]) -> Column:
    """Addresses in five text fields and in the evidence's texts."""
    texts = F.concat(C.strings(*[C.truthy(_own(columns, f)) for f in TEXT_FIELDS]), F.filter(F.map_values("evidence_str"), lambda v: v != ""))
    found = lambda text, i: F.transform(text_indicators(text), lambda x, j: _candidate("network", x["type"], x["value"], emit=i * 1_000_000 + j))
    return F.flatten(F.transform(texts, found))


def _hashes(columns: list[str]) -> Column:
    """A sha1 column, and texts of the evidence that are a hash as a whole."""
    own = F.when(hash_type(_own(columns, "sha1")) == "hash_sha1", _own(columns, "sha1"))
    texts = F.transform(F.map_values("evidence_str"), lambda v, i: _candidate("hashes", hash_type(F.trim(v)), F.trim(v), emit=i + 1))
    return F.concat(F.array(_candidate("hashes", "hash_sha1", own, F.col("object_name"))), texts)


def matches(text: Column, pattern: str) -> Column:
    """All matches, with Unicode words and blanks."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def text_indicators(text: Column) -> Column:
    """array<struct<type, value>> of a text: addresses, every match counted."""
    tagged = lambda values, kind: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    urls = F.transform(matches(text, URL), lambda u: F.regexp_replace(u, "[).,;'\"]+$", ""))
    v6 = F.filter(matches(text, IPV6), lambda v: F.size(F.split(v, ":")) > 2)
    names = F.filter(matches(text, DOMAIN), lambda v: ~v.rlike(f"^{IPV4}$"))
    return F.concat(tagged(urls, "url"), tagged(matches(text, IPV4), "ipv4"), tagged(v6, "ipv6"), tagged(names, "domain"))


def hash_type(value: Column) -> Column:
    """By length, of a whole text of hex digits; NULL for others."""
    return F.coalesce(*[F.when(value.rlike(f"^[a-fA-F0-9]{{{n}}}$"), kind) for kind, n in HASHES])


#: In the order in which they are asked.
EXTRACTORS = ("files", "registry", "powershell", "network", "browser", "services", "tasks", "hashes")
#: Rules whose findings name services and tasks.
SERVICE_RULES, TASK_RULES = ("service_installation", "registry_persistence"), ("scheduled_task_persistence",)


def _found(rows: DataFrame, names: tuple[str, ...], of: dict) -> Column | None:
    """All candidates of a row by the extractors that are asked for."""
    made = [of[n](rows.columns) for n in names if n in of]
    arrays = [F.array(*m) if isinstance(m, list) else m for m in made]
    return F.array_compact(F.concat(*arrays)) if arrays else None


def event_candidates(timeline: DataFrame, names: tuple[str, ...] = EXTRACTORS) -> DataFrame:
    """The candidates of single events: one projection for all extractors, one scan of the timeline."""
    of = {"files": _files, "registry": _registry, "powershell": _powershell, "network": _network, "browser": _browser, "hashes": _hashes}
    found = _found(timeline, names, of)
    rows = timeline.select("event_id", "timestamp", "tl_pos", _sure().alias("sure"), F.explode(F.array().cast("array<int>") if found is None else found).alias("c"))
    if found is None:
        rows = rows.withColumn("c", F.lit(None).cast(CANDIDATE))
    return _rows(rows, F.col("timestamp"), F.col("timestamp"), F.col("sure"), F.array("event_id"), C.strings(), F.col("tl_pos"))


def _of_persistence(columns: list[str]) -> list[Column]:
    kept = F.col("rule_name").isin("registry_persistence", "service_installation")
    place = C.truthy(F.try_element_at("evidence", F.lit("key_path")))
    return [_candidate("registry", "persistence_location", F.when(kept, place), F.col("description"), "registry", 0, F.col("severity"))]


def _of_powershell(columns: list[str]) -> list[Column]:
    of = lambda n: F.when(F.col("rule_name") == "powershell_execution", C.truthy(F.try_element_at("evidence", F.lit(n))))
    said = F.concat(F.lit("matched indicators: "), F.replace(of("matched_indicators"), F.lit(","), F.lit(", ")))
    severity = F.col("severity")
    return [_candidate("powershell", "command_line", of("command_line"), said, "evtx", 0, severity), _candidate("powershell", "powershell_script", of("script_name"), None, "evtx", 1, severity)]


def finding_candidates(findings: DataFrame, names: tuple[str, ...] = EXTRACTORS) -> DataFrame | None:
    """The candidates of single findings; they come after those of events. Suspicious command lines are seen when they start."""
    found = _found(findings, names, {"registry": _of_persistence, "powershell": _of_powershell})
    if found is None:
        return None
    rows = findings.select("correlation_id", "event_ids", "start_time", "end_time", "confidence", "rule_name", "rule_ord", "tl_pos", F.explode(found).alias("c"))
    last = F.when(F.col("rule_name") == "powershell_execution", F.col("start_time")).otherwise(F.col("end_time"))
    after = F.col("rule_ord") * F.lit(1 << 48) + F.col("tl_pos") + F.lit(1 << 56)
    return _rows(rows, F.col("start_time"), last, F.col("confidence"), F.col("event_ids"), F.array("correlation_id"), after)


def _of_service(columns: list[str]) -> list[Column]:
    kind = F.when(F.lower("object_path").endswith(".sys"), "driver").otherwise("service")
    return [_candidate("services", kind, F.when(F.col("rule_name").isin(*SERVICE_RULES), C.truthy("object_name")), F.col("object_path"), None, 0, F.col("severity"))]


def _of_task(columns: list[str]) -> list[Column]:
    of = lambda c: F.when(F.col("rule_name").isin(*TASK_RULES), C.truthy(c))
    return [_candidate("tasks", "scheduled_task", of("object_name"), F.col("object_path"), "scheduled_task", 0, F.col("severity")), _candidate("tasks", "command_line", of("object_path"), None, "scheduled_task", 1)]


def linked_candidates(timeline: DataFrame, findings: DataFrame, names: tuple[str, ...] = EXTRACTORS) -> DataFrame | None:
    """The candidates of the events of service and task findings; of events with equal ids the last counts."""
    rules = [r for n, of in (("services", SERVICE_RULES), ("tasks", TASK_RULES)) if n in names for r in of]
    if not rules:
        return None
    ids = findings.where(F.col("rule_name").isin(*rules)).select("correlation_id", "severity", F.col("confidence").alias("sure"), "rule_name", F.explode("event_ids").alias("event_id"))
    events = event_lookup(timeline.select("event_id", "timestamp", "tl_pos", "artifact_type", "object_name", "object_path"))
    both = ids.join(events, "event_id")
    found = _found(both, names, {"services": _of_service, "tasks": _of_task})
    rows = both.select("event_id", "correlation_id", "timestamp", "tl_pos", "sure", F.explode(found).alias("c"))
    return _rows(rows, F.col("timestamp"), F.col("timestamp"), F.col("sure"), F.array("event_id"), F.array("correlation_id"), F.col("tl_pos"))


CANDIDATE = "struct<extractor: int, ioc_type: string, value: string, source_artifact: string, snippet: string, severity: string, emit: int>"


def _rows(rows: DataFrame, first: Column, last: Column, confidence: Column, event_ids: Column, correlation_ids: Column, pos: Column) -> DataFrame:
    return rows.select(
        "c.ioc_type",
        "c.value",
        "c.source_artifact",
        first.alias("first_seen"),
        last.alias("last_seen"),
        confidence.alias("confidence"),
        event_ids.alias("event_ids"),
        correlation_ids.alias("correlation_ids"),
        "c.snippet",
        "c.severity",
        F.struct(F.col("c.extractor").alias("extractor"), pos.alias("pos"), F.col("c.emit").alias("emit"), F.col("c.value").alias("value")).alias("cand_ord"),
    )


def extract(timeline: DataFrame, findings: DataFrame | None, names: tuple[str, ...] = EXTRACTORS) -> DataFrame:
    """The rows of the extractors with cand_ord, their order: what single events, single findings, and findings' events give."""
    out = event_candidates(timeline, names).where("ioc_type IS NOT NULL")
    more = [] if findings is None else [finding_candidates(findings, names), linked_candidates(timeline, findings, names)]
    return reduce(lambda a, b: a.union(b), [m for m in more if m is not None], out)


def event_lookup(timeline: DataFrame) -> DataFrame:
    """One event for each id: the last in the timeline."""
    return timeline.groupBy("event_id").agg(F.max_by(F.struct(*timeline.columns), "tl_pos").alias("e")).select("e.*")


def incident_lookup(incs: Incidents) -> DataFrame:
    """correlation_id, incident_id: the incidents that have it as primary or supporting."""
    return incs.correlations.select("correlation_id", "incident_id").distinct()


# --- merge


@dataclass(frozen=True)
class Indicators:
    """Merged indicators: one row for each, and one for each of their links; no row grows with an indicator.

    head: ioc_type, key, value, source_artifact, occurrences, confidence, first_seen, last_seen, severity,
    snippets (SNIPPETS at most), n_events, n_correlations, n_incidents, some_incidents (LISTED at most).
    events, correlations, incidents: ioc_type, key, id.
    """

    head: DataFrame
    events: DataFrame
    correlations: DataFrame
    incidents: DataFrame


KEY = ["ioc_type", "key"]
#: Incidents that a report's line may name: their ids are 64 characters long, the line shows 80.
LISTED = 2


def merge(rows: DataFrame, incidents_of: DataFrame | None = None) -> Indicators:
    """One row for each type and trimmed lower-case value: the first row's value and source, counts, times, links, snippets."""
    kept = written(rows.where(F.trim("value") != "").withColumn("key", F.lower(F.trim("value"))), "indicator-rows")
    folded = kept.groupBy(*KEY).agg(
        F.min_by(F.struct("value", "source_artifact"), "cand_ord").alias("_f"),
        F.count("*").alias("occurrences"),
        F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min_by("severity", F.when(F.col("severity").isNotNull(), F.col("cand_ord"))).alias("severity"),
    )
    folded = folded.select(*KEY, "_f.value", "_f.source_artifact", "occurrences", "confidence", "first_seen", "last_seen", "severity")
    link = lambda ids: kept.select(*KEY, F.explode(ids).alias("id")).distinct()
    events, correlations = link("event_ids"), written(link("correlation_ids"), "indicator-findings")
    none = correlations.where("false")
    incidents = none if incidents_of is None else correlations.join(incidents_of.withColumnRenamed("correlation_id", "id"), "id").select(*KEY, F.col("incident_id").alias("id")).distinct()
    incidents = written(incidents, "indicator-incidents")
    # each part by itself, so that only its own shuffle files are there; parts have a row for each indicator
    parts = [written(folded, "indicator-heads")]
    parts += [written(links.groupBy(*KEY).agg(F.count("*").alias(name)), name) for name, links in (("n_events", events), ("n_correlations", correlations), ("n_incidents", incidents))]
    parts.append(written(first_distinct(kept, KEY, F.col("snippet"), F.col("cand_ord"), SNIPPETS, "snippets"), "snippets"))
    parts.append(written(first_distinct(incidents, KEY, F.col("id"), F.col("id"), LISTED, "some_incidents"), "some-incidents"))
    head = reduce(lambda a, b: a.join(b, KEY, "left"), parts)
    counts = {n: F.coalesce(n, F.lit(0)) for n in ("n_events", "n_correlations", "n_incidents")}
    whole = written(head.withColumns(counts | {c: F.coalesce(c, C.strings()) for c in ("snippets", "some_incidents")}), "indicators")
    removed(*parts)
    return Indicators(whole, events, correlations, incidents)


def statistics(iocs: Indicators) -> DataFrame:
    return iocs.head.groupBy("ioc_type").agg(F.count("*").alias("n"))


def report(iocs: Indicators) -> DataFrame:
    """group_name, value, line: the display groups; a line has the count, the severity and the incidents, cut at 80 characters."""
    known = F.create_map(*[F.lit(x) for g, types in REPORT_GROUPS.items() for t in types for x in (t, g)])
    parts = C.strings(
        F.concat(F.lit("- `"), "value", F.lit("`")),
        F.concat(F.lit("(seen "), F.col("occurrences").cast("string"), F.lit("x")),
        F.concat(F.lit(", severity: "), C.truthy("severity")),
        F.when(F.col("n_incidents") > 0, F.concat(F.lit(", incidents: "), F.substring(F.array_join("some_incidents", ", "), 1, 80))),
        F.lit(")"),
    )
    named = iocs.head.withColumn("group_name", F.element_at(known, F.col("ioc_type"))).where("group_name IS NOT NULL")
    return named.select("group_name", "value", F.array_join(parts, " ").alias("line"))


def serialize(iocs: Indicators) -> DataFrame:
    """ioc_type, key, json with sorted id lists. One text holds an indicator, as the format has it; its links are tables in :class:`Indicators`."""
    out = iocs.head
    for name in ("event", "correlation", "incident"):
        links = getattr(iocs, f"{name}s").groupBy(*KEY).agg(F.array_sort(F.collect_list("id")).alias(f"{name}_ids"))
        out = out.join(links, KEY, "left").withColumn(f"{name}_ids", F.coalesce(f"{name}_ids", C.strings()))
    times = [C.iso(c).alias(c) for c in ("first_seen", "last_seen")]
    shape = F.struct("ioc_type", "value", "source_artifact", *times, "confidence", "severity", "occurrences", "event_ids", "correlation_ids", "incident_ids", "snippets")
    return out.select(*KEY, F.to_json(shape).alias("json"))


#: Ids that a part of an indicator's text holds.
PART = 5_000


def serialize_parts(iocs: Indicators) -> DataFrame:
    """ioc_type, key, part, json: an indicator of any size in parts. The first (0) has all but the id lists, the others stretches of these.

    Objects of the shape of :func:`serialize`; in order of ``part`` their lists, one after the other, are the whole sorted lists.
    """
    times = [C.iso(c).alias(c) for c in ("first_seen", "last_seen")]
    shape = F.struct("ioc_type", "value", "source_artifact", *times, "confidence", "severity", "occurrences", "snippets")
    out = iocs.head.select(*KEY, F.lit(0).cast("long").alias("part"), F.to_json(shape).alias("json"))
    for name in ("event", "correlation", "incident"):
        # sorted by ranges, so a key's ids lie over several tasks, and no row has more than PART of them
        placed = spread(getattr(iocs, f"{name}s"), [F.col(c).asc() for c in (*KEY, "id")], f"{name}-parts")
        at = F.col("part") * F.lit(1 << 33) + F.floor(F.col("place") / PART) + 1
        lists = placed.select(*KEY, at.alias("part"), "id").groupBy(*KEY, "part").agg(F.array_sort(F.collect_list("id")).alias(f"{name}_ids"))
        out = out.union(lists.select(*KEY, "part", F.to_json(F.struct(f"{name}_ids")).alias("json")))
    return out


# --- candidates for a model, and its answers

#: Evidence key to candidate type.
CANDIDATE_FIELDS = {
    "command_line": "command_line", "powershell_command": "command_line", "cmd_command": "command_line", "process_name": "process_name", "image": "process_name", "executed_name": "process_name",
    "object_name": "process_name", "exe": "process_name", "filename": "filename", "download_name": "filename", "downloaded_file": "filename", "downloaded_filename": "filename",
    "object_path": "file_path", "image_path": "file_path", "target_path": "file_path", "file_path": "file_path", "registry_key": "registry_key", "registry_value": "registry_value", "key_path": "registry_key",
    "service_name": "service_name", "task_name": "scheduled_task", "task_path": "scheduled_task", "url": "url", "download_url": "url", "referrer": "url", "domain": "domain", "hostname": "hostname", "host": "hostname",
    "ip": "ip_address", "ipv4": "ip_address", "ipv6": "ip_address", "sha256": "sha256", "sha1": "sha1", "md5": "md5", "hash": "hash", "user": "username", "username": "username", "account": "username",
    "ransom_note": "filename", "readme": "filename",
}
#: What is noise.
LOW_VALUE = ("", "-", ".", "none", "null", "unknown", "true", "false", "0", "1")
NOISE_PATHS = ("c:\\windows\\system32", "c:\\windows\\winsxs", "c:\\program files\\windows defender", "c:\\programdata\\microsoft")
NOISE_SERVICES = ("appreadiness", "ksecpkg", "edgeupdate", "edgeupdatem", "w32time", "eventlog", "rpcss", "lanmanserver", "lanmanworkstation")
NOISE_KEYS = ("\\services\\appreadiness", "\\services\\ksecpkg", "\\services\\edgeupdate")
BATCH = 250


def is_noise(kind: Column, value: Column) -> Column:
    low = F.lower(value)
    paths = reduce(lambda a, b: a | b, [low.startswith(p) for p in NOISE_PATHS])
    return paths | ((kind == "service_name") & F.trim(F.replace(low, F.lit("\0"), F.lit(""))).isin(*NOISE_SERVICES)) | ((kind == "registry_key") & C.any_of(low, NOISE_KEYS))


def clean_candidate(kind: Column, value: Column) -> Column:
    """Trimmed, without NUL, cut to 1,000 characters; in command lines long base64 is named and the rest cut to 800."""
    cut = lambda v, n: F.when(F.length(v) > n, F.concat(F.substring(v, 1, n), F.lit(" ...<TRUNCATED>"))).otherwise(v)
    plain = cut(F.trim(F.replace(value, F.lit("\0"), F.lit(""))), 1000)
    return F.when(kind == "command_line", cut(F.regexp_replace(plain, "[A-Za-z0-9+/=]{200,}", "<BASE64_PAYLOAD>"), 800)).otherwise(plain)


SOURCES = 3


def candidates(ranked_heads: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate values in the evidence of incidents' findings, in order of priority_rank; with occurrences and the first three sources.

    ``members`` (incident_id, correlation_id, evidence, member_ord) are findings, primary before supporting.
    """
    known = F.create_map(*[F.lit(x) for kv in CANDIDATE_FIELDS.items() for x in kv])
    fields = ["incident_id", "correlation_id", "priority_rank", "member_ord"]
    rows = members.join(ranked_heads.select("incident_id", "priority_rank"), "incident_id").select(*fields, F.explode("evidence").alias("field", "raw"))
    rows = rows.withColumn("kind", F.element_at(known, F.col("field"))).where("kind IS NOT NULL").withColumn("value", clean_candidate(F.col("kind"), F.col("raw")))
    rows = rows.where(~F.lower("value").isin(*LOW_VALUE) & (F.length("value") >= 3) & ~is_noise(F.col("kind"), F.col("value")))
    order = F.struct("priority_rank", "member_ord", "field")
    kept = written(rows.select("kind", F.lower("value").alias("key"), "value", order.alias("at"), F.concat_ws(":", "incident_id", "correlation_id").alias("source")), "candidates")
    folded = kept.groupBy("kind", "key").agg(F.min_by("value", "at").alias("value"), F.count("*").alias("occurrences"), F.min("at").alias("first_ord"))
    # a source counts once for each field that names the value there
    sources = first_distinct(kept, ["kind", "key"], F.struct("source", "at"), F.col("at"), SOURCES, "sources")
    return folded.join(sources.withColumn("sources", F.transform("sources", lambda x: x["source"])), ["kind", "key"])


def batched(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """cand_pos and batch, in order of the first occurrence."""
    placed = ranked(rows, [F.col(c).asc() for c in ("first_ord", "kind", "key")], "cand_pos")
    return placed.withColumn("batch", F.floor(F.col("cand_pos") / size)).withColumn("cand_pos", F.col("cand_pos") + 1)


#: Canonical types of a model's answers, and other names for them.
MODEL_TYPES = (
    "ip_address", "url", "domain", "hostname", "email_address", "powershell_command", "cmd_command", "encoded_powershell_payload", "downloaded_file", "executable", "dll", "script", "registry_run_key", "registry_persistence_key", "scheduled_task",
    "windows_service", "file_path", "user_account", "process_name", "mutex", "hash_md5", "hash_sha1", "hash_sha256", "suspicious_filename", "ransom_note", "encryption_extension", "network_indicator", "defender_detection", "browser_download", "other",
)
ALIASES = {
    "ip": "ip_address", "ip_addr": "ip_address", "ipv4": "ip_address", "ipv6": "ip_address", "email": "email_address", "powershell": "powershell_command", "powershell_cmd": "powershell_command", "cmd": "cmd_command", "command": "cmd_command",
    "encoded_payload": "encoded_powershell_payload", "base64_payload": "encoded_powershell_payload", "download": "downloaded_file", "file": "file_path", "path": "file_path", "exe": "executable", "binary": "executable", "dll_file": "dll",
    "registry_key": "registry_persistence_key", "run_key": "registry_run_key", "service": "windows_service", "windows_service_name": "windows_service", "task": "scheduled_task", "account": "user_account", "username": "user_account", "user": "user_account",
    "process": "process_name", "md5": "hash_md5", "sha1": "hash_sha1", "sha256": "hash_sha256", "hash": "other", "filename": "suspicious_filename", "ransomnote": "ransom_note", "ransom_note_file": "ransom_note", "extension": "encryption_extension",
    "network": "network_indicator", "port": "network_indicator", "defender": "defender_detection", "av_detection": "defender_detection", "browser_file_download": "browser_download",
}
CONFIDENCES = ("high", "medium", "low")


def parsed_response(raw: str | Column) -> Column:
    """array<struct<type, value, confidence, source, reason>> of the ``iocs`` of an answer, after repairs; NULL if there is none.

    Tried in turn: the text, without fences, from the first to the last brace, without trailing commas.
    """
    text = F.trim(C.col(raw))
    bare = F.trim(F.regexp_replace(text, r"^```[A-Za-z]*\s*|\s*```$", ""))
    braced = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    tidy = F.regexp_replace(braced, r",(\s*[}\]])", "$1")
    shape = "struct<type: string, value: string, confidence: string, source: string, reason: string>"
    tried = [F.try_variant_get(F.try_parse_json(t), "$.iocs", "variant") for t in (text, bare, braced, tidy)]
    items = F.from_json(F.to_json(F.coalesce(*tried)), "array<string>")  # each still as text: one that is no object spoils only itself
    return F.transform(items, lambda i: F.from_json(i, shape))


def model_iocs(responses: DataFrame, raw: str = "text", order: str = "batch") -> DataFrame:
    """order, entry, type, value, confidence, source, reason of all entries that have a type and a value."""
    rows = responses.select(order, F.posexplode(parsed_response(raw)).alias("entry", "i")).where(C.truthy("i.type").isNotNull() & (F.trim("i.value") != ""))
    name = F.lower(F.translate(F.trim("i.type"), "- ", "__"))
    known = F.create_map(*[F.lit(x) for kv in ({t: t for t in MODEL_TYPES} | ALIASES).items() for x in kv])
    kind = F.coalesce(F.element_at(known, name), F.lit("other"))
    reason = F.when(name == kind, F.coalesce("i.reason", F.lit(""))).otherwise(F.trim(F.concat(F.lit("[reported type: "), "i.type", F.lit("] "), F.coalesce("i.reason", F.lit("")))))
    sure = F.lower(F.trim("i.confidence"))
    return rows.select(order, "entry", kind.alias("type"), F.trim("i.value").alias("value"), F.when(sure.isin(*CONFIDENCES), sure).otherwise("low").alias("confidence"), "i.source", reason.alias("reason"))


def dedup_model_iocs(rows: DataFrame, order: str = "batch") -> DataFrame:
    """Within an answer the first of equal type and value; across answers, by type and lower-case value, the last one at the first one's place."""
    cols = ["value", "confidence", "source", "reason"]
    at = F.struct(order, "entry")
    once = rows.groupBy(order, "type", "value").agg(F.min_by(F.struct("entry", *cols[1:]), "entry").alias("r")).select(order, "type", "value", "r.*")
    return once.groupBy("type", F.lower("value").alias("key")).agg(F.max_by(F.struct(*cols), at).alias("r"), F.min(at).alias("place")).select("type", "key", "r.*", "place")


def high_confidence(rows: DataFrame, column: str = "confidence") -> DataFrame:
    return rows.agg(F.count_if(F.lower(column).isin("high", "high-confidence", "high_confidence", "0.9", "1")).alias("n"))
