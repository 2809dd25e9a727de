"""Views of the driver's tables in the shape of forensic records.

Each view is a SELECT that Spark and DuckDB read alike, so that both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import entities, normalize, rules, timeline

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
SEP = "chr(92)"

#: Events as normalized events: what happened by event_type, the object by the number in props.
EVT = f"""SELECT event_id AS ingest_seq, ts AS timestamp,
CASE event_type WHEN 'click' THEN 'browser' WHEN 'view' THEN 'browser' WHEN 'purchase' THEN 'prefetch' WHEN 'signup' THEN 'registry' ELSE 'defender' END AS artifact_type,
CASE event_type WHEN 'click' THEN 'file_download' WHEN 'view' THEN 'url_visit' WHEN 'purchase' THEN 'process_execution' WHEN 'signup' THEN 'persistence' ELSE 'malware_detection' END AS event_type,
CASE event_type WHEN 'click' THEN 'browser' WHEN 'view' THEN 'browser' WHEN 'purchase' THEN 'execution' WHEN 'signup' THEN 'persistence' ELSE 'security' END AS category,
CASE WHEN {K} % 17 = 3 THEN 'svchost.exe' ELSE concat('obj', {K}, '.exe') END AS object_name,
CASE WHEN event_type IN ('click', 'view') THEN concat('C:', {SEP}, 'Users', {SEP}, 'u', user_id, {SEP}, 'Downloads', {SEP}, 'obj', {K}, '.exe')
     WHEN event_type = 'signup' THEN concat('C:', {SEP}, 'Windows', {SEP}, CASE WHEN {K} % 17 = 3 THEN 'svchost.exe' ELSE concat('run', {K}, '.dll') END) END AS object_path,
concat('u', user_id) AS "user", 'events' AS source_file, CASE WHEN event_type = 'purchase' THEN 0.95 WHEN event_type = 'error' THEN 0.8 ELSE 1.0 END AS confidence,
concat(event_type, ' of ', {K}) AS description, concat('HKLM', {SEP}, 'Run', {SEP}, {K} % 10) AS key_path, event_id % 7 <> 6 AS timeline_eligible, {K} AS k FROM events"""

#: Events as records of the event log.
EVTX = f"""SELECT event_id AS ingest_seq, event_id AS record_id, ts AS timestamp, 'security.evtx' AS source_path, concat('pc', user_id % 9) AS computer, 'Main' AS channel,
CASE event_id % 5 WHEN 0 THEN 800 WHEN 1 THEN 4688 WHEN 2 THEN 1102 WHEN 3 THEN 7045 ELSE 9999 END AS event_id,
CASE event_id % 5 WHEN 0 THEN 'PowerShell' WHEN 1 THEN 'Microsoft-Windows-Security-Auditing' WHEN 2 THEN 'Microsoft-Windows-Eventlog' WHEN 3 THEN 'Service Control Manager' ELSE 'Other' END AS provider,
CASE {K} % 8 WHEN 0 THEN 'powershell -ExecutionPolicy Bypass -File a.ps1' WHEN 1 THEN 'powershell -enc QUJD' WHEN 2 THEN 'powershell -WindowStyle hidden' WHEN 3 THEN '[Reflection.Assembly]::Load(x)'
  WHEN 4 THEN '[Convert]::FromBase64String(x) ; iex y' WHEN 5 THEN 'New-Object Net.WebClient' WHEN 6 THEN 'IEX (x)' ELSE 'Get-ChildItem' END AS command_line,
CASE WHEN event_id % 2 = 0 THEN concat('C:', {SEP}, 's', {SEP}, 'f', {K}, '.ps1') END AS script_name,
CASE WHEN event_id % 3 = 0 THEN 'powershell.exe -ep bypass' END AS host_application,
concat('C:', {SEP}, 'W', {SEP}, CASE WHEN {K} % 2 = 0 THEN 'PowerShell.exe' ELSE 'calc.exe' END) AS process, concat('u', user_id) AS subject, CASE WHEN {K} % 3 = 0 THEN '-' ELSE concat('t', {K}) END AS target FROM events"""

#: Line items as change-journal records.
USN = """SELECT l_orderkey * 10 + l_linenumber AS ingest_seq, l_orderkey * 10 + l_linenumber AS usn, l_shipdate AS timestamp, 'J' AS source_path, l_orderkey AS frn, l_suppkey AS parent_frn,
CASE l_linenumber % 7 WHEN 0 THEN 256 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 512 WHEN 4 THEN 8192 WHEN 5 THEN 32768 ELSE 2147483652 END AS reason_code,
CASE WHEN l_partkey % 50 = 0 THEN 'Thumbs.db' WHEN l_partkey % 50 = 1 THEN '~$x.doc' ELSE concat('f', l_partkey, '.txt') END AS file_name, CASE WHEN l_partkey % 40 = 2 THEN 16 ELSE 32 END AS file_attributes_code FROM lineitem"""

#: Orders as file-table records.
MFT = """SELECT o_orderkey AS ingest_seq, o_orderkey AS mft_reference, o_custkey % 7 AS sequence_number, concat('f', o_orderkey) AS filename, concat('x/f', o_orderkey) AS primary_path, 'M' AS source_path,
o_orderstatus <> 'F' AS in_use, o_custkey % 5 = 0 AS is_directory, o_custkey % 5 <> 0 AS is_file, CASE WHEN o_custkey % 11 <> 0 THEN o_orderdate END AS si_created,
o_orderdate + CASE WHEN o_custkey % 3 = 0 THEN INTERVAL '3' SECOND ELSE INTERVAL '1' SECOND END AS fn_created, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate END AS si_entry_modified, o_orderdate AS fn_entry_modified FROM orders"""


def view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    """The SELECT over the table's files; in Spark the reserved name takes backticks."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    plain = sql.replace("{", "{{").replace("}", "}}").replace('"user"', "`user`")
    return spark.sql(plain.replace(f"FROM {table}", "FROM {rows}"), rows=rows)


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized events with ids and evidence."""
    from emberline.functions import columns as C

    rows = view(spark, sf_dir, EVT, "events")
    made = rows.withColumns({"event_id": C.event_id("artifact_type", "event_type", "timestamp", "source_file", "object_name", "object_path"), "evidence_str": C.text_map({"key_path": F.when(F.col("artifact_type") == "registry", F.col("key_path")), "object_name": "object_name", "user": "user"}), "emit_ord": F.lit(0)})
    return made.withColumn("confidence", F.col("confidence").cast("double"))


def tl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of :func:`evt` with entities."""
    return entities.with_entity(timeline.timeline(evt(spark, sf_dir)))


def evtx_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, EVTX, "events")
    item = lambda name, value: F.struct(F.lit(name).alias("name"), F.col(value).alias("value"))
    return rows.withColumns({"data": F.when(F.col("event_id") == 4688, F.array(item("SubjectUserName", "subject"), item("NewProcessName", "process"), item("TargetUserName", "target"))), "command_summary": F.lit(None).cast("string")})


def evtx_tl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.with_entity(timeline.timeline(normalize.evtx(evtx_landing(spark, sf_dir))))


FINDING_RULES = ("registry_persistence", "defender_detection", "browser_activity", "browser_download_execution")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run_rules(tl(spark, sf_dir), FINDING_RULES)


# --- the same in SQL


def iso_sql(c: str) -> str:
    return rf"regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '')"


def id_sql(*parts: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + "))"


def generic_sql(c: str) -> str:
    from emberline.functions.columns import GENERIC_HOSTS

    return "(" + " OR ".join(f"contains(lower({c}), '{g}')" for g in GENERIC_HOSTS) + ")"


def key_sql() -> str:
    ok = lambda c: f"CASE WHEN {c} <> '' AND NOT {generic_sql(c)} THEN lower(trim({c})) END"
    return f"coalesce({ok('object_path')}, {ok('object_name')})"


_ENTITY = f"""{key_sql()} AS entity_key, CASE WHEN {key_sql()} IS NOT NULL THEN sha256(concat_ws('|', 'fallback_object:' || artifact_type, 'file', {key_sql()})) END AS entity_id"""
EVT_SQL = f"""evt0 AS ({EVT}), evt AS (SELECT *, {id_sql("artifact_type", "event_type", iso_sql("timestamp"), "source_file", "object_name", "object_path")} AS event_id FROM evt0)"""
TL_SQL = f"""{EVT_SQL}, tl AS (SELECT *, row_number() OVER (ORDER BY timestamp, artifact_type, event_type, coalesce(object_name, ''), ingest_seq) - 1 AS tl_pos, {_ENTITY} FROM evt WHERE timeline_eligible)"""
EVTX_EVENTS_SQL = f"""x0 AS ({EVTX}), x1 AS (SELECT *, CASE event_id WHEN 800 THEN 'powershell_pipeline_execution' WHEN 4688 THEN 'process_execution' WHEN 1102 THEN 'log_cleared' WHEN 7045 THEN 'service_install' ELSE 'unknown_event' END AS event_type,
CASE WHEN event_id = 800 THEN script_name WHEN event_id = 4688 THEN process END AS object_path, CASE WHEN event_id = 4688 THEN CASE WHEN target <> '-' THEN target ELSE subject END END AS "user" FROM x0),
x2 AS (SELECT * EXCLUDE (event_id), event_id AS number, 'evtx' AS artifact_type, string_split(object_path, chr(92))[-1] AS object_name FROM x1),
xe AS (SELECT *, {id_sql("artifact_type", "event_type", iso_sql("timestamp"), "source_path", "object_name", "object_path", "record_id")} AS event_id FROM x2),
xtl AS (SELECT *, row_number() OVER (ORDER BY timestamp, artifact_type, event_type, coalesce(object_name, ''), ingest_seq) - 1 AS tl_pos, {_ENTITY} FROM xe)"""

_FILE = "string_split(lower(trim(coalesce(nullif(object_name, ''), object_path))), chr(92))[-1]"
_ONE = "SELECT sha256(concat_ws('|', '{rule}', event_id)) AS correlation_id, '{rule}' AS rule_name, '{severity}' AS severity, confidence, timestamp AS start_time, timestamp AS end_time, [event_id] AS event_ids, CASE WHEN entity_id IS NULL THEN [] ELSE [entity_id] END AS entity_ids, {order} AS rule_ord, tl_pos, object_name AS ev_name, \"user\" AS ev_user, CASE WHEN artifact_type = 'registry' THEN key_path END AS ev_key, CAST(NULL AS VARCHAR) AS ev_executed, object_path AS ev_path, description FROM tl WHERE {where}"
PAIRS_SQL = f"""pairs AS (SELECT d.event_id AS d_id, d.timestamp AS d_time, d.entity_id AS d_entity, d.confidence AS d_conf, d.tl_pos AS d_pos, d.object_path AS d_path, e.event_id AS e_id, e.timestamp AS e_time, e.confidence AS e_conf, e.object_name AS e_name,
row_number() OVER (PARTITION BY d.tl_pos ORDER BY e.timestamp, e.tl_pos) AS rn
FROM (SELECT *, {_FILE} AS file FROM tl WHERE artifact_type = 'browser' AND event_type = 'file_download') d JOIN (SELECT *, {_FILE} AS file FROM tl WHERE artifact_type = 'prefetch') e
ON (d.file = e.file OR d.entity_id = e.entity_id) AND e.timestamp >= d.timestamp AND e.timestamp <= d.timestamp + INTERVAL 7 DAY)"""
FINDINGS_SQL = f"""{TL_SQL}, {PAIRS_SQL}, cor AS (
{_ONE.format(rule="registry_persistence", severity="low", order=0, where="artifact_type = 'registry'")} UNION ALL
{_ONE.format(rule="defender_detection", severity="high", order=3, where="artifact_type = 'defender'")} UNION ALL
{_ONE.format(rule="browser_activity", severity="low", order=6, where="artifact_type = 'browser'")} UNION ALL
SELECT sha256(concat_ws('|', 'browser_download_execution', d_id, e_id)), 'browser_download_execution', 'medium', least(d_conf, e_conf), d_time, e_time, [d_id, e_id], CASE WHEN d_entity IS NULL THEN [] ELSE [d_entity] END, 8, d_pos, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), e_name, d_path, 'A file downloaded through the browser was later executed, per Prefetch.' FROM pairs WHERE rn = 1)"""
CLUSTERS_OF_COR = """links AS (SELECT DISTINCT 'c:' || correlation_id AS a, unnest(list_concat(list_transform(event_ids, lambda x: 'v:' || x), list_transform(entity_ids, lambda x: 'n:' || x))) AS b FROM cor),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(node, root) AS (SELECT a, least(a, min(b)) FROM both_ways GROUP BY a UNION SELECT w.b, r.root FROM reach r JOIN both_ways w ON w.a = r.node WHERE r.root < w.b),
roots AS (SELECT substr(node, 3) AS correlation_id, min(root) AS root FROM reach WHERE node LIKE 'c:%' GROUP BY node)"""
CLUSTERS_SQL = f"{FINDINGS_SQL}, {CLUSTERS_OF_COR}"
INCIDENTS_OF_COR = """last_cor AS (SELECT * FROM cor QUALIFY row_number() OVER (PARTITION BY correlation_id ORDER BY rule_ord DESC, tl_pos DESC) = 1),
inc AS (SELECT list_sort(list_distinct(list(correlation_id))) AS primary_ids, min(start_time) AS start_time, max(end_time) AS end_time, ['low', 'medium', 'high', 'critical'][max(list_position(['low', 'medium', 'high', 'critical'], severity))] AS severity, min(confidence) AS confidence,
list_sort(list_distinct(flatten(list(event_ids)))) AS event_ids, list_sort(list_distinct(flatten(list(entity_ids)))) AS entity_ids, list_sort(list_distinct(list(rule_name))) AS rule_names FROM last_cor JOIN roots USING (correlation_id) GROUP BY root),
incidents AS (SELECT *, sha256(array_to_string(primary_ids, '|')) AS incident_id FROM inc),
ranked AS (SELECT *, row_number() OVER (ORDER BY list_position(['low', 'medium', 'high', 'critical'], severity) DESC, confidence DESC, len(primary_ids) DESC, len(event_ids) DESC, incident_id) AS priority_rank FROM incidents)"""
INCIDENTS_SQL = f"{CLUSTERS_SQL}, {INCIDENTS_OF_COR}"

SRU_NET = f"""WITH r AS (SELECT CAST(floor(value) AS BIGINT) AS v, {K} AS app, user_id FROM events), n AS (SELECT app, user_id, CASE WHEN app % 4 <> 0 THEN 'app' || app ELSE 'AppId:' || app END AS application, CASE WHEN v % 2 = 0 THEN v ELSE 0 END AS sent, CASE WHEN v % 4 < 2 THEN 0 ELSE v END AS received FROM r)"""
