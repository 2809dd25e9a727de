"""Queries of normalization, times, timeline, entities and context (B, C, D, E, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.operators import entities, graph, normalize, timeline

from .adapters import CLUSTERS_SQL, EVT, EVT_SQL, EVTX_EVENTS_SQL, K, MFT, SEP, TL_SQL, USN, evt, evtx_landing, evtx_tl, findings, id_sql, iso_sql, key_sql, tl, view

PAIRS: dict = {}


def pair(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame with the SQL that gives the same rows."""

    def keep(run):
        PAIRS[name] = (run, sql)
        return run

    return keep


joined = lambda c: F.array_join(c, "|")
NORMAL = ["event_id", "event_type", "object_name", "object_path", "description"]


# --- B: normalization

pair("b1_event_id", f"WITH {EVT_SQL} SELECT ingest_seq, event_id FROM evt")(lambda s, d: evt(s, d).select("ingest_seq", "event_id"))
pair("b2_hydrate_ids", f"WITH {EVT_SQL} SELECT ingest_seq, CASE WHEN ingest_seq % 3 = 0 THEN 'given' ELSE event_id END AS event_id FROM evt")(lambda s, d: normalize.hydrate_ids(evt(s, d).withColumns({"event_id": F.when(F.col("ingest_seq") % 3 == 0, "given").when(F.col("ingest_seq") % 3 == 1, ""), "record_id": F.lit(None).cast("string")})).select("ingest_seq", "event_id"))
pair("b3_evtx", f"""WITH {EVTX_EVENTS_SQL} SELECT event_id, event_type, object_name, object_path, "user",
CASE WHEN number = 800 AND script_name IS NOT NULL THEN 'PowerShell script executed: ' || script_name ELSE CASE number WHEN 800 THEN 'PowerShell pipeline execution' WHEN 4688 THEN 'Process execution' WHEN 1102 THEN 'Windows event log cleared' WHEN 7045 THEN 'Service installed' ELSE 'Windows Event 9999 (Other)' END END AS description FROM xe""")(lambda s, d: normalize.evtx(evtx_landing(s, d)).select(*NORMAL, "user"))


def _prefetch_rows(s, d):
    rows = view(s, d, f"SELECT event_id AS ingest_seq, ts, user_id, {K} AS k FROM events WHERE event_type = 'purchase'", "events")
    hour = F.expr("interval 1 hour")
    return rows.select("ingest_seq", F.concat(F.lit("P"), "k", F.lit(".EXE")).alias("filename"), F.lit("pf").alias("source_path"), F.array("ts", F.when(F.col("k") % 2 == 0, F.col("ts") - hour), F.col("ts") - hour - hour).alias("last_run_times"), F.array(F.lit("a.dll")).alias("loaded_files"), F.lit(30).alias("prefetch_version"), F.lit("H").alias("prefetch_hash"), F.lit(3).alias("run_count"))


pair("b4_prefetch", f"""WITH r AS (SELECT ts, {K} AS k FROM events WHERE event_type = 'purchase'), t AS (SELECT k, ts AS timestamp FROM r UNION ALL SELECT k, ts - INTERVAL 1 HOUR FROM r WHERE k % 2 = 0 UNION ALL SELECT k, ts - INTERVAL 2 HOUR FROM r)
SELECT {id_sql("'prefetch'", "'process_execution'", iso_sql("timestamp"), "'pf'", "'P' || k || '.EXE'", "NULL")} AS event_id, timestamp, 'P' || k || '.EXE' AS object_name FROM t""")(lambda s, d: normalize.prefetch(_prefetch_rows(s, d)).select("event_id", "timestamp", "object_name"))

KEYS = f"""SELECT p_partkey AS ingest_seq, p_size, p_name, p_brand, CASE p_partkey % 8 WHEN 0 THEN concat('Software', {SEP}, 'Microsoft', {SEP}, 'CurrentVersion', {SEP}, 'Run') WHEN 1 THEN concat('X', {SEP}, 'CurrentVersion', {SEP}, 'RunOnce') WHEN 2 THEN concat('System', {SEP}, 'Services', {SEP}, 'Usbstor')
WHEN 3 THEN concat('A', {SEP}, 'UserAssist', {SEP}, 'Count') WHEN 4 THEN concat('System', {SEP}, 'Enum', {SEP}, 'USBSTOR', {SEP}, 'Disk&Ven_', p_brand, '&Prod_Big_', p_size, '&Rev_1.0', {SEP}, 'SN', p_size % 5) WHEN 5 THEN concat('System', {SEP}, 'Control', {SEP}, 'USBSTOR', {SEP}, 'a', {SEP}, 'b')
WHEN 6 THEN concat('N', {SEP}, 'RecentDocs', {SEP}, '.txt') ELSE 'Other' END AS key_path FROM part"""


def _keys(s, d):
    rows = view(s, d, KEYS, "part")
    none = F.lit(None).cast("string")
    value = lambda name, kind, data, raw=None: F.struct(name.alias("name"), F.lit(kind).alias("type"), data.alias("value_data"), (F.lit(None).cast("binary") if raw is None else raw).alias("value_bytes"))
    document = F.when(F.col("p_size") % 4 == 0, F.lit("~$tmp.doc")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("C:\\docs\\f"), F.col("p_size").cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".pdf")))
    named = F.array(value(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), "REG_SZ", F.col("p_name")), value(F.lit("ImagePath"), "REG_SZ", F.when(F.col("p_size") % 5 != 0, F.col("p_name"))), value(F.lit("Start"), "REG_DWORD", (F.col("p_size") % 6).cast("string")), value(F.lit("DisplayName"), "REG_SZ", F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))))
    assist = F.array(value(F.when(F.col("p_size") % 3 == 0, F.lit("HRZR_PGYFRFFVBA")).otherwise(F.col("p_name")), "REG_BINARY", none))
    recent = F.array(value(F.lit("MRUListEx"), "REG_BINARY", none), value(F.lit("0"), "REG_BINARY", none, F.encode(F.concat(document, F.lit("\0meta\0")), "UTF-16LE")))
    usb = F.array(value(F.lit("FriendlyName"), "REG_SZ", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Nice "), F.col("p_brand")))))
    values = F.when(F.col("ingest_seq") % 8 == 3, assist).when(F.col("ingest_seq") % 8 == 6, recent).when(F.col("ingest_seq") % 8 == 4, usb).otherwise(named)
    hour = F.timestamp_add("HOUR", F.col("p_size").cast("long"), F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    return rows.select("ingest_seq", "p_size", "key_path", F.lit("k").alias("key_name"), values.alias("values"), hour.alias("last_written"), F.lit("HIVE").alias("source_path"), F.when(F.col("p_size") % 7 == 0, "SOFTWARE").otherwise("NTUSER.DAT").alias("hive"), F.lit("bob").alias("user"))


ROUTE = "CASE WHEN contains(lower(key_path), '\\currentversion\\run') THEN 'run' WHEN contains(lower(key_path), '\\services') THEN 'services' WHEN contains(lower(key_path), '\\userassist') THEN 'userassist' WHEN contains(lower(key_path), '\\usbstor') THEN 'usbstor' WHEN contains(lower(key_path), '\\recentdocs') THEN 'recentdocs' END"
pair("b5_registry_route", f"WITH r AS ({KEYS}) SELECT ingest_seq, {ROUTE} AS route FROM r")(lambda s, d: _keys(s, d).select("ingest_seq", normalize.registry_route().alias("route")))
pair("b6_run_keys", f"""WITH r AS ({KEYS}), v AS (SELECT *, unnest([{{'n': CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, 'v': p_name, 'o': 0}}, {{'n': 'ImagePath', 'v': CASE WHEN p_size % 5 <> 0 THEN p_name END, 'o': 1}}, {{'n': 'Start', 'v': CAST(p_size % 6 AS VARCHAR), 'o': 2}}, {{'n': 'DisplayName', 'v': CASE WHEN p_size % 2 = 0 THEN p_brand END, 'o': 3}}]) AS x FROM r WHERE {ROUTE} = 'run')
SELECT ingest_seq, x.o AS emit_ord, coalesce(nullif(x.n, ''), '(Default)') AS object_name, x.v AS object_path, 'Registry Run key: ' || x.n AS description FROM v""")(lambda s, d: normalize.run_keys(_keys(s, d)).select("ingest_seq", "emit_ord", "object_name", "object_path", "description"))
pair("b7_services", f"""WITH r AS ({KEYS}) SELECT ingest_seq, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'k' END AS object_name, p_name AS object_path, CASE p_size % 6 WHEN 0 THEN 'Boot' WHEN 1 THEN 'System' WHEN 2 THEN 'Automatic' WHEN 3 THEN 'Manual' WHEN 4 THEN 'Disabled' ELSE 'Unknown' END AS start_type FROM r WHERE {ROUTE} = 'services' AND p_size % 5 <> 0""")(lambda s, d: normalize.services(_keys(s, d)).select("ingest_seq", "object_name", "object_path", "start_type"))
pair("b8_userassist", f"""WITH r AS ({KEYS}) SELECT ingest_seq, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS object_name FROM r WHERE {ROUTE} = 'userassist' AND p_size % 3 <> 0""")(lambda s, d: normalize.userassist(_keys(s, d)).select("ingest_seq", "object_name"))
USB_SQL = f"""r AS ({KEYS}), u AS (SELECT *, replace(p_brand, '_', ' ') AS vendor, 'Big ' || p_size AS product, 'SN' || p_size % 5 AS serial_number, CASE WHEN p_size % 2 = 0 THEN 'Nice ' || p_brand END AS friendly FROM r WHERE ingest_seq % 8 = 4)"""
pair("b9_usb_devices", f"WITH {USB_SQL} SELECT ingest_seq, vendor, product, '1.0' AS revision, serial_number, coalesce(friendly, vendor || ' ' || product) AS object_name FROM u")(lambda s, d: normalize.usb_devices(_keys(s, d)).select("ingest_seq", "vendor", "product", "revision", "serial_number", "object_name"))
DOC = "CASE WHEN p_size % 4 = 1 THEN 'C:\\docs\\f' || p_size || '.txt' ELSE 'f' || p_size || '.pdf' END"
pair("b10_recent_documents", f"""WITH r AS ({KEYS}) SELECT ingest_seq, {DOC} AS document_path, string_split({DOC}, chr(92))[-1] AS object_name FROM r WHERE ingest_seq % 8 = 6 AND p_size % 7 <> 0 AND p_size % 4 <> 0""")(lambda s, d: normalize.recent_documents(_keys(s, d)).select("ingest_seq", "document_path", "object_name"))

LINKS = f"""SELECT p_partkey AS ingest_seq, CASE WHEN p_size % 4 <> 0 THEN concat('C:', {SEP}, 'a', {SEP}, p_brand, '.exe') END AS target_path, concat('l', p_partkey, '.lnk') AS lnk_name, p_name AS entry_name FROM part"""


def _links(s, d):
    rows = view(s, d, LINKS, "part")
    blank = ("relative_path", "working_directory", "description", "command_line_arguments", "icon_location", "drive_serial", "drive_type", "volume_label")
    time = F.timestamp_add("MINUTE", F.col("ingest_seq").cast("long"), F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
    return rows.withColumns({b: F.lit(None).cast("string") for b in blank} | {"modified_time": time, "access_time": time, "file_size": F.lit(1)})


_LNK_NAME = "coalesce(string_split(target_path, chr(92))[-1], {own})"
_TIME = "TIMESTAMP '2024-02-01 00:00:00' + to_minutes(ingest_seq)"
for _name, _run, _own, _kind, _type, _said, _plain in (("b11_lnk", normalize.lnk, "lnk_name", "lnk", "shortcut_reference", "Shortcut referencing ", "Shortcut reference"), ("b12_jumplist", normalize.jumplist, "entry_name", "jumplist", "jumplist_reference", "Recent access to ", "Jump List entry")):
    _n = _LNK_NAME.format(own=_own)
    pair(_name, f"""WITH l AS ({LINKS}) SELECT {id_sql(f"'{_kind}'", f"'{_type}'", iso_sql(_TIME), "NULL", _n, "target_path")} AS event_id, '{_type}' AS event_type, {_n} AS object_name, target_path AS object_path, CASE WHEN target_path IS NULL THEN '{_plain}' ELSE '{_said}' || {_n} END AS description FROM l""")(lambda s, d, run=_run: run(_links(s, d)).select(*NORMAL))

AMCACHE = """SELECT p_partkey AS ingest_seq, CASE p_partkey % 6 WHEN 0 THEN 'InventoryApplication' WHEN 1 THEN 'InventoryApplicationFile' WHEN 2 THEN 'InventoryApplicationShortcut' WHEN 3 THEN 'InventoryDriverBinary' WHEN 4 THEN 'InventoryDriverPackage' ELSE 'InventoryOther' END AS category, p_name, p_brand, p_type, p_size FROM part"""


def _amcache(s, d):
    rows = view(s, d, AMCACHE, "part")
    given = {"Name": F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")), "ProgramName": F.col("p_brand"), "Path": F.when(F.col("p_size") % 2 == 0, F.col("p_type")), "CompanyName": F.col("p_brand")}
    return rows.select("ingest_seq", "category", C.text_map(given).alias("values"), F.lit(None).cast("timestamp_ntz").alias("last_written"), F.lit("e").alias("entry_name"), F.lit("ep").alias("entry_path"), F.lit("A").alias("source_path"))


pair("b13_amcache", f"""WITH a AS ({AMCACHE}) SELECT ingest_seq, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS object_name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'ep' END AS object_path, p_brand AS publisher, CAST(CASE ingest_seq % 6 WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 WHEN 2 THEN 0.6 ELSE 0.85 END AS DOUBLE) AS confidence FROM a WHERE category <> 'InventoryOther'""")(lambda s, d: normalize.amcache(_amcache(s, d)).select("ingest_seq", "object_name", "object_path", "publisher", "confidence"))


def _downloads(s, d):
    rows = view(s, d, EVT, "events").where("event_type = 'file_download'")
    t = F.lit(None).cast("string")
    return rows.select("ingest_seq", F.lit("chrome").alias("browser"), F.col("object_path").alias("target_path"), F.col("timestamp").alias("start_time"), *[t.alias(n) for n in ("current_path", "mime_type", "end_time", "received_bytes", "total_bytes", "state", "danger_type")], F.lit("https://r.example.com/x").alias("referrer"), F.lit("https://s.example.com").alias("site_url"), t.alias("tab_url"), F.lit("B").alias("source_path"))


pair("b14_browser", f"""WITH r AS ({EVT}) SELECT {id_sql("'browser'", "'file_download'", iso_sql("timestamp"), "'B'", "string_split(object_path, chr(92))[-1]", "object_path")} AS event_id, string_split(object_path, chr(92))[-1] AS object_name, 'https://s.example.com' AS related FROM r WHERE event_type = 'file_download'""")(lambda s, d: normalize.browser_downloads(_downloads(s, d)).select("event_id", "object_name", joined("related_objects").alias("related")))


def _mft(s, d):
    rows = view(s, d, MFT, "orders")
    none = F.lit(None).cast("timestamp_ntz")
    return rows.withColumns({"file_reference": C.file_reference("mft_reference", "sequence_number"), "si_modified": none, "fn_modified": none, "allocated_size": F.lit(1), "real_size": F.lit(1), "usn": F.lit(1)})


pair("b15_mft", f"""WITH m AS ({MFT}), e AS (SELECT ingest_seq, 0 AS emit_ord, CASE WHEN is_directory THEN 'directory_created' ELSE 'file_creation' END AS event_type, si_created AS timestamp FROM m WHERE si_created IS NOT NULL
UNION ALL SELECT ingest_seq, 1, CASE WHEN is_directory THEN 'directory_deleted' ELSE 'file_deletion' END, coalesce(si_entry_modified, fn_entry_modified) FROM m WHERE NOT in_use
UNION ALL SELECT ingest_seq, 2, 'timestamp_inconsistency', coalesce(si_entry_modified, fn_entry_modified) FROM m WHERE abs(epoch_us(si_created) - epoch_us(fn_created)) > 2000000) SELECT * FROM e""")(lambda s, d: normalize.mft(_mft(s, d)).select("ingest_seq", "emit_ord", "event_type", "timestamp"))


def _usn(s, d):
    extra = {n: F.lit(1) for n in ("usn_version_major", "usn_version_minor")}
    return normalize.usn(view(s, d, USN, "lineitem").withColumns(extra))


USN_SQL = f"""u0 AS ({USN}), u AS (SELECT *, CASE WHEN reason_code & 256 <> 0 THEN 'file_creation' WHEN reason_code & 512 <> 0 THEN 'file_deletion' WHEN reason_code & 8192 <> 0 THEN 'file_renamed' WHEN reason_code & 119 <> 0 THEN 'file_modification' END AS event_type,
CASE reason_code WHEN 256 THEN ['FILE_CREATE'] WHEN 1 THEN ['DATA_OVERWRITE'] WHEN 2 THEN ['DATA_EXTEND'] WHEN 512 THEN ['FILE_DELETE'] WHEN 8192 THEN ['RENAME_NEW_NAME'] ELSE ['DATA_TRUNCATION', 'CLOSE'] END AS flags FROM u0 WHERE lower(file_name) <> 'thumbs.db' AND file_name NOT LIKE '~$%' AND file_attributes_code & 16 = 0)"""
pair("b16_usn", f"WITH {USN_SQL} SELECT ingest_seq, event_type, array_to_string(flags, '|') AS reason_flags, event_type <> 'file_modification' AS timeline_eligible FROM u WHERE event_type IS NOT NULL")(lambda s, d: _usn(s, d).select("ingest_seq", "event_type", joined("reason_flags").alias("reason_flags"), "timeline_eligible"))

SRU = f"""SELECT event_id AS ingest_seq, event_id AS record_id, ts, CAST(floor(value) AS BIGINT) AS v, {K} AS app, user_id FROM events"""
SRU_HAS = {"network": ["BytesSent", "BytesRecvd"], "resource": ["ForegroundCycleTime", "BackgroundCycleTime"], "connectivity": ["ConnectedTime", "ConnectStartTime"], "energy": ["Energy"]}


def _sru(s, d, kind: str):
    rows = view(s, d, SRU, "events")
    n = {c: F.col("v") + i for i, c in enumerate(("BytesRecvd", "ForegroundCycleTime", "BackgroundCycleTime", "ForegroundBytesRead", "BackgroundBytesRead", "ForegroundBytesWritten", "BackgroundBytesWritten", "ConnectedTime", "ConnectStartTime"))}
    n |= {"BytesSent": F.when(F.col("v") % 2 == 0, F.col("v")).otherwise(0), "BytesRecvd": F.when(F.col("v") % 4 < 2, 0).otherwise(F.col("v")), "InterfaceLuid": F.col("app") % 3, "L2ProfileId": F.lit(7), "Energy": F.when(F.col("v") % 2 == 0, F.col("v")).cast("string")}
    more = {"TimeStamp": F.col("ts"), "application": F.when(F.col("app") % 4 != 0, F.concat(F.lit("app"), "app")), "application_id": F.col("app"), "application_path": F.lit(None).cast("string"), "user_sid": F.concat(F.lit("S-"), "user_id"), "has": F.array(*[F.lit(h) for h in SRU_HAS[kind]]), "source_path": F.lit("S")}
    return rows.withColumns(n | more)


APP = "CASE WHEN app % 4 <> 0 THEN 'app' || app ELSE 'AppId:' || app END"
NET = f"SELECT ingest_seq, app, user_id, {APP} AS application, CASE WHEN v % 2 = 0 THEN v ELSE 0 END AS sent, CASE WHEN v % 4 < 2 THEN 0 ELSE v END AS received FROM r"
pair("b17_sru_network", f"WITH r AS ({SRU}), n AS ({NET}) SELECT ingest_seq, application, CAST(sent + received AS BIGINT) AS total_bytes FROM n WHERE sent <> 0 OR received <> 0")(lambda s, d: normalize.sru_network(_sru(s, d, "network")).select("ingest_seq", "application", "total_bytes"))
pair("b18_sru_resource", f"WITH r AS ({SRU}) SELECT ingest_seq, {APP} AS application, CAST(2 * v + 3 AS BIGINT) AS total_cycle_time, CAST(2 * v + 7 AS BIGINT) AS total_bytes_read FROM r")(lambda s, d: normalize.sru_resource(_sru(s, d, "resource")).select("ingest_seq", "application", "total_cycle_time", "total_bytes_read"))
pair("b19_sru_connectivity", f"WITH r AS ({SRU}) SELECT ingest_seq, CAST(v + 7 AS BIGINT) AS connected_time, CAST(app % 3 AS INT) AS network_interface FROM r")(lambda s, d: normalize.sru_connectivity(_sru(s, d, "connectivity")).select("ingest_seq", "connected_time", "network_interface"))
pair("b20_sru_energy", f"WITH r AS ({SRU}) SELECT ingest_seq, CAST(v AS DOUBLE) AS energy FROM r WHERE v % 2 = 0")(lambda s, d: normalize.sru_energy(_sru(s, d, "energy")).select("ingest_seq", "energy"))
pair("b21_sru_route", "SELECT event_id AS ingest_seq, CASE event_id % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'resource' WHEN 2 THEN 'connectivity' WHEN 3 THEN 'energy' END AS route FROM events")(
    lambda s, d: view(s, d, "SELECT event_id AS ingest_seq FROM events", "events").withColumn("has", F.when(F.col("ingest_seq") % 5 == 0, F.array(*[F.lit(x) for x in ("BytesSent", "BytesRecvd", "Energy")])).when(F.col("ingest_seq") % 5 == 1, F.array(*[F.lit(x) for x in SRU_HAS["resource"]])).when(F.col("ingest_seq") % 5 == 2, F.array(*[F.lit(x) for x in SRU_HAS["connectivity"]])).when(F.col("ingest_seq") % 5 == 3, F.array(F.lit("Energy"))).otherwise(F.array(F.lit("BytesSent")))).select("ingest_seq", normalize.sru_route().alias("route"))
)

MESSAGES = f"""SELECT event_id AS ingest_seq, ts AS timestamp, 'D' AS source_path, 'service_log' AS record_type, CASE WHEN {K} % 13 = 5 THEN 'Cloud' ELSE 'Engine' END AS component, CAST(NULL AS VARCHAR(9)) AS action,
CASE {K} % 11 WHEN 0 THEN 'Service started' WHEN 1 THEN 'service stopped: x' WHEN 2 THEN 'Engine version 1.2' WHEN 3 THEN 'Threat found' WHEN 4 THEN 'Engine loaded' WHEN 5 THEN 'Process scan started' WHEN 6 THEN 'Process scan completed' WHEN 7 THEN 'SubmitReport' WHEN 8 THEN 'Config change' WHEN 9 THEN '' ELSE 'Hello' END AS message FROM events"""
KINDS = "CASE k % 11 WHEN 0 THEN 'defender_service_started' WHEN 1 THEN 'defender_service_stopped' WHEN 2 THEN 'defender_platform_update' WHEN 3 THEN 'malware_detection' WHEN 4 THEN 'defender_engine_loaded' WHEN 5 THEN 'defender_scan_started' WHEN 6 THEN 'defender_scan_completed' WHEN 7 THEN 'defender_cloud_request' ELSE CASE WHEN k % 13 = 5 THEN 'defender_cloud_request' WHEN k % 11 = 8 THEN 'defender_configuration_changed' ELSE 'defender_information' END END"
pair("b22_defender", f"WITH m AS (SELECT *, {K} AS k FROM events) SELECT event_id AS ingest_seq, {KINDS} AS event_type FROM m")(lambda s, d: normalize.defender(view(s, d, MESSAGES, "events")).select("ingest_seq", "event_type"))

TASKS = """SELECT s_suppkey AS ingest_seq, 'T' AS source_path, s_name AS task_name, CASE WHEN s_suppkey % 3 <> 0 THEN concat('run ', s_suppkey) END AS command, concat('u', s_nationkey) AS "user" FROM supplier"""


def _tasks(s, d):
    t = {n: F.lit(None).cast("string") for n in ("author", "description", "arguments", "working_directory", "run_level")}
    return view(s, d, TASKS, "supplier").withColumns(t | {"registration_date": F.timestamp_add("DAY", F.col("ingest_seq").cast("long"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")), "enabled": F.lit(True), "hidden": F.lit(False), "triggers": F.array(F.lit("TimeTrigger"))})


pair("b23_scheduled_tasks", f"""WITH t AS ({TASKS}) SELECT ingest_seq, task_name AS object_name, coalesce(command, '') AS object_path, "user", 'Scheduled task ''' || task_name || ''' configured to run: ' || coalesce(command, '') AS description FROM t""")(lambda s, d: normalize.scheduled_tasks(_tasks(s, d)).select("ingest_seq", "object_name", "object_path", "user", "description"))
pair("b24_dispatch", f"""WITH {EVTX_EVENTS_SQL}, m AS (SELECT *, {K} AS k FROM events) SELECT artifact_type, event_type, count(*) AS n FROM (SELECT artifact_type, event_type FROM xe UNION ALL SELECT 'defender', {KINDS} FROM m UNION ALL SELECT 'scheduled_task', 'persistence' FROM supplier) GROUP BY ALL""")(
    lambda s, d: normalize.normalize({"evtx": evtx_landing(s, d), "defender": view(s, d, MESSAGES, "events"), "scheduled_task": _tasks(s, d), "unheard_of": _tasks(s, d)}).groupBy("artifact_type", "event_type").agg(F.count("*").alias("n"))
)
pair("b25_compact_usn", f"""WITH {USN_SQL}, e AS (SELECT *, CASE WHEN event_type = 'file_renamed' THEN parent_frn END AS kp, CASE WHEN event_type = 'file_renamed' THEN file_name END AS kn FROM u WHERE event_type IS NOT NULL),
g AS (SELECT event_type, frn, kp, kn, count(*) AS n, min(usn) AS first_usn, max(usn) AS last_usn, list_sort(list(DISTINCT usn))[1:20] AS usns FROM e GROUP BY event_type, frn, kp, kn),
x AS (SELECT event_type, frn, kp, kn, ingest_seq, unnest(flags) AS fl, generate_subscripts(flags, 1) AS p FROM e), y AS (SELECT event_type, frn, kp, kn, fl, min((ingest_seq, p)) AS pos FROM x GROUP BY ALL), f AS (SELECT event_type, frn, kp, kn, list(fl ORDER BY pos) AS fs FROM y GROUP BY ALL)
SELECT first_usn AS usn, g.event_type, n AS usn_record_count, CASE WHEN n > 1 THEN last_usn END AS last_usn, CASE WHEN n > 1 THEN array_to_string(usns, '|') END AS related_usns, array_to_string(fs, '|') AS reason_flags FROM g JOIN f ON g.event_type = f.event_type AND g.frn = f.frn AND g.kp IS NOT DISTINCT FROM f.kp AND g.kn IS NOT DISTINCT FROM f.kn""")(
    lambda s, d: normalize.compact_usn(_usn(s, d)).select("usn", "event_type", "usn_record_count", "last_usn", joined(F.col("related_usns").cast("array<string>")).alias("related_usns"), joined("reason_flags").alias("reason_flags"))
)
pair("b26_merge_usb", f"""WITH {USB_SQL}, i AS (SELECT *, lower(vendor) AS x, p_brand || '|' || p_size || '|' || serial_number AS device FROM u) SELECT min(ingest_seq) AS ingest_seq, count(DISTINCT hive || key_path) - 1 AS more FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN 'SOFTWARE' ELSE 'NTUSER.DAT' END AS hive FROM i) GROUP BY device""")(
    lambda s, d: normalize.merge_usb_devices(normalize.usb_devices(_keys(s, d))).select("ingest_seq", F.col("n_occurrences").alias("more"))
)
pair("b27_merge_recent", f"""WITH r AS ({KEYS}), x AS (SELECT *, {DOC} AS doc FROM r WHERE ingest_seq % 8 = 6 AND p_size % 7 <> 0 AND p_size % 4 <> 0) SELECT min(ingest_seq) AS ingest_seq, doc AS document_path, CASE WHEN count(*) > 1 THEN 1 END AS n_keys FROM x GROUP BY doc, p_size""")(
    lambda s, d: normalize.merge_recent_documents(normalize.recent_documents(_keys(s, d))).select("ingest_seq", "document_path", F.when(F.col("related_registry_keys").isNotNull(), F.size("related_registry_keys")).alias("n_keys"))
)
pair("b28_merge_evidence", f"""WITH r AS ({EVT}), x AS (SELECT *, concat('{{"key_path":"', replace(key_path, chr(92), chr(92) || chr(92)), '"}}') AS ev FROM r WHERE artifact_type = 'registry') SELECT object_path AS document_path, count(DISTINCT ev) - 1 AS more FROM x GROUP BY object_path""")(
    lambda s, d: _merged_registry(s, d)
)


def _merged_registry(s, d):
    rows = evt(s, d).where("artifact_type = 'registry'").withColumn("evidence_str", C.text_map({"key_path": "key_path"}))
    merged = normalize.merge_evidence(rows, {"path": F.col("object_path")})
    return merged.select(F.col("object_path").alias("document_path"), F.col("n_occurrences").alias("more"))


# --- C: times
TIMES = "SELECT event_id, ts, value, epoch_us(ts) AS us FROM events"
times = lambda s, d: view(s, d, "SELECT event_id, ts, value FROM events", "events").withColumn("us", F.timestamp_diff("MICROSECOND", F.expr(C.EPOCH), F.col("ts")))
pair("c1_chrome_time", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS t FROM events")(lambda s, d: times(s, d).select("event_id", C.chrome_time(F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("us") + C.MICROS_1601)).alias("t")))
pair("c2_filetime", "SELECT event_id, ts AS t FROM events")(lambda s, d: times(s, d).select("event_id", C.filetime((F.col("us") + C.MICROS_1601) * 10 + 7).alias("t")))
pair("c3_unix_time", "SELECT event_id, date_trunc('second', ts) AS t FROM events")(lambda s, d: times(s, d).select("event_id", C.unix_time(F.floor(F.col("us") / 1_000_000)).alias("t")))
pair("c4_ole_time", "SELECT event_id, date_trunc('day', ts) + INTERVAL 12 HOUR AS t FROM events")(lambda s, d: times(s, d).select("event_id", C.ole_time(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) + C.DAYS_1899 + 0.5).alias("t")))
pair("c5_coerce_time", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR WHEN 2 THEN ts END AS t FROM ({TIMES})")(lambda s, d: times(s, d).select("event_id", C.coerce_time(F.when(F.col("event_id") % 4 == 0, F.concat(C.iso("ts"), F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(C.iso("ts"), F.lit("+02:00"))).when(F.col("event_id") % 4 == 2, F.replace(C.iso("ts"), F.lit("T"), F.lit(" "))).otherwise("no time")).alias("t")))

# --- D: timeline
def broken(s, d):
    """The events with types, categories and times missing here and there."""
    spoiled = {"artifact_type": F.when(F.col("ingest_seq") % 29 != 0, F.col("artifact_type")), "category": F.when(F.col("ingest_seq") % 31 != 0, F.col("category")).otherwise(""), "raw_time": F.when(F.col("ingest_seq") % 37 == 0, "bad").when(F.col("ingest_seq") % 41 != 0, "good"), "timestamp": F.when((F.col("ingest_seq") % 37 != 0) & (F.col("ingest_seq") % 41 != 0), F.col("timestamp"))}
    return evt(s, d).withColumns(spoiled)



REASON = "CASE WHEN ingest_seq % 29 = 0 THEN 'missing_artifact_type' WHEN ingest_seq % 31 = 0 THEN 'missing_category' WHEN ingest_seq % 37 = 0 THEN 'invalid_timestamp' WHEN ingest_seq % 41 = 0 THEN 'missing_timestamp' {more} END"
pair("d1_validate", f"WITH {EVT_SQL} SELECT ingest_seq, {REASON.format(more='')} AS reason FROM evt")(lambda s, d: broken(s, d).select("ingest_seq", timeline.reject_reason("raw_time").alias("reason")))
pair("d2_eligible", f"WITH {EVT_SQL} SELECT ingest_seq FROM evt WHERE NOT timeline_eligible")(lambda s, d: timeline.validated(evt(s, d)).where("reject_reason = 'timeline_eligible_false'").select("ingest_seq"))
pair("d3_timeline", f"WITH {TL_SQL} SELECT event_id, ingest_seq, tl_pos FROM tl")(lambda s, d: tl(s, d).select("event_id", "ingest_seq", "tl_pos"))
_ALL = REASON.format(more="WHEN NOT timeline_eligible THEN 'timeline_eligible_false'")
pair("d4_build_report", f"WITH {EVT_SQL}, r AS (SELECT coalesce({_ALL}, 'output') AS reason, count(*) AS n FROM evt GROUP BY 1) SELECT * FROM r UNION ALL SELECT 'input', CAST(sum(n) AS BIGINT) FROM r")(lambda s, d: timeline.build_report(broken(s, d), "raw_time"))
pair("d5_skip_samples", f"WITH {EVT_SQL}, r AS (SELECT ingest_seq, {_ALL} AS reason FROM evt) SELECT ingest_seq, reason FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reason ORDER BY ingest_seq) <= 20")(lambda s, d: timeline.skip_samples(broken(s, d), "raw_time").select("ingest_seq", F.col("reject_reason").alias("reason")))

# --- E: entities
pair("e1_fallback_key", f"WITH {EVT_SQL} SELECT ingest_seq, {key_sql()} AS entity_key FROM evt")(lambda s, d: evt(s, d).select("ingest_seq", entities.fallback_value().alias("entity_key")))


def _keyed(s, d):
    key = lambda kind, value, strength: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit("file").alias("entity_type"), F.lit(strength).alias("strength"))
    rows = evt(s, d)
    return rows.withColumn("identity_keys", F.array_compact(F.array(key("path", F.col("object_path"), 1), F.when(F.col("k") % 5 == 0, key("hash", F.concat(F.lit("h"), F.col("k").cast("string")), 3)), F.when(F.col("k") % 7 == 0, key("ref", F.concat(F.lit("r"), (F.col("ingest_seq") % 50).cast("string")), 2)))))


BEST = "CASE WHEN k % 5 = 0 THEN sha256('hash|file|h' || k) WHEN k % 7 = 0 THEN sha256('ref|file|r' || (ingest_seq % 50)) ELSE sha256('path|file|' || coalesce(object_path, '')) END"
pair("e2_entity_id", f"WITH r AS ({EVT}) SELECT ingest_seq, {BEST} AS entity_id FROM r")(lambda s, d: _keyed(s, d).select("ingest_seq", entities.entity_id_of(F.col("identity_keys")).alias("entity_id")))
pair("e3_event_entity", f"WITH {TL_SQL} SELECT event_id, ingest_seq, entity_id FROM tl")(lambda s, d: tl(s, d).select("event_id", "ingest_seq", "entity_id"))
pair("e4_entities", f"""WITH {TL_SQL}, k AS (SELECT * FROM tl WHERE entity_id IS NOT NULL), f AS (SELECT entity_id, min(tl_pos) FILTER (object_path IS NOT NULL) AS p, max(tl_pos) AS l FROM k GROUP BY 1),
h AS (SELECT f.entity_id, f.p, CASE WHEN f.p IS NULL THEN kl.object_name ELSE kp.object_name END AS name, kp.object_path AS path FROM f JOIN k kl ON kl.tl_pos = f.l LEFT JOIN k kp ON kp.tl_pos = f.p),
a AS (SELECT entity_id, list_sort(list_distinct(list(alias))) AS aliases FROM (SELECT h.entity_id, unnest([CASE WHEN k.object_name IS DISTINCT FROM h.name THEN k.object_name END, CASE WHEN k.object_path IS DISTINCT FROM h.path THEN k.object_path END]) AS alias FROM h JOIN k ON k.entity_id = h.entity_id AND k.tl_pos > h.p) WHERE alias IS NOT NULL GROUP BY 1)
SELECT entity_id, name, path, coalesce(array_to_string(aliases, '|'), '') AS aliases FROM h LEFT JOIN a USING (entity_id)""")(lambda s, d: entities.entities(tl(s, d)).select("entity_id", "name", "path", joined("aliases").alias("aliases")))
E5_SQL = f"""r AS (SELECT * FROM evt), ks AS (SELECT DISTINCT event_id, {BEST} AS own, unnest([{{'d': sha256('path|file|' || coalesce(object_path, '')), 's': 1}}, {{'d': CASE WHEN k % 5 = 0 THEN sha256('hash|file|h' || k) END, 's': 3}}, {{'d': CASE WHEN k % 7 = 0 THEN sha256('ref|file|r' || (ingest_seq % 50)) END, 's': 2}}]) AS x FROM r),
keyed AS (SELECT event_id, own, x.d AS key, x.s AS strength FROM ks WHERE x.d IS NOT NULL),
firm AS (SELECT DISTINCT 'e' || event_id AS a, 'k' || key AS b FROM keyed WHERE strength >= 2), firm_ways AS (SELECT a, b FROM firm UNION SELECT b, a FROM firm),
firm_reach(node, root) AS (SELECT a, least(a, min(b)) FROM firm_ways GROUP BY a UNION SELECT w.b, f.root FROM firm_reach f JOIN firm_ways w ON w.a = f.node WHERE f.root < w.b),
firm_roots AS (SELECT substr(node, 2) AS event_id, min(root) AS root FROM firm_reach WHERE node LIKE 'e%' GROUP BY node),
firm_best AS (SELECT root, arg_min(key, (-strength, key)) AS entity_id FROM keyed JOIN firm_roots USING (event_id) GROUP BY root), united AS (SELECT event_id, entity_id FROM firm_roots JOIN firm_best USING (root)),
leads AS (SELECT key, min(entity_id) AS low, max(entity_id) AS high FROM keyed JOIN united USING (event_id) WHERE strength = 1 GROUP BY key),
led AS (SELECT k.event_id, min(own) AS own, min(low) AS low, max(high) AS high FROM keyed k LEFT JOIN leads USING (key) WHERE strength = 1 AND event_id NOT IN (SELECT event_id FROM united) GROUP BY k.event_id),
loose AS (SELECT DISTINCT 'e' || event_id AS a, 'k' || key AS b FROM keyed WHERE event_id IN (SELECT event_id FROM led WHERE low IS NULL)), loose_ways AS (SELECT a, b FROM loose UNION SELECT b, a FROM loose),
loose_reach(node, root) AS (SELECT a, least(a, min(b)) FROM loose_ways GROUP BY a UNION SELECT w.b, f.root FROM loose_reach f JOIN loose_ways w ON w.a = f.node WHERE f.root < w.b),
loose_roots AS (SELECT substr(node, 2) AS event_id, min(root) AS root FROM loose_reach WHERE node LIKE 'e%' GROUP BY node),
loose_best AS (SELECT root, min(key) AS entity_id FROM keyed JOIN loose_roots USING (event_id) GROUP BY root)"""
E5_ROWS = "SELECT event_id, entity_id FROM united UNION ALL SELECT event_id, CASE WHEN low = high THEN low ELSE own END FROM led WHERE low IS NOT NULL UNION ALL SELECT event_id, entity_id FROM loose_roots JOIN loose_best USING (root)"
pair("e5_resolve", f"WITH RECURSIVE {EVT_SQL}, {E5_SQL} {E5_ROWS}")(lambda s, d: entities.resolve(_keyed(s, d)))


def _parts(s, d):
    rows = evt(s, d).where("object_path IS NOT NULL")
    return rows.select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("entity_id"), (F.col("ingest_seq") % 3 + 1).alias("strength"), F.col("object_name").alias("name"), F.col("object_path").alias("path"), C.strings().alias("aliases"), F.create_map(F.lit("type"), F.array("artifact_type")).alias("metadata"))


pair("e6_merge_entities", f"""WITH r AS ({EVT}), p AS (SELECT 'n' || k AS entity_id, ingest_seq % 3 + 1 AS strength, object_name AS name, object_path AS path, artifact_type FROM r WHERE object_path IS NOT NULL),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY strength DESC, name, path) = 1), x AS (SELECT p.entity_id, unnest([p.name, p.path]) AS v FROM p)
SELECT b.entity_id, b.strength, b.name, b.path, coalesce((SELECT array_to_string(list_sort(list_distinct(list(v))), '|') FROM x WHERE x.entity_id = b.entity_id AND v <> b.name AND v <> b.path), '') AS aliases, (SELECT array_to_string(list_sort(list_distinct(list(artifact_type))), '|') FROM p WHERE p.entity_id = b.entity_id) AS types FROM b""")(
    lambda s, d: entities.merge_entities(_parts(s, d)).select("entity_id", "strength", "name", "path", joined("aliases").alias("aliases"), joined(F.element_at("metadata", F.lit("type"))).alias("types"))
)
pair("e7_components", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT node, min(root) AS root FROM reach GROUP BY node")(lambda s, d: _graph(s, d))


def _graph(s, d):
    from emberline.operators import incidents

    links = incidents.shared_ids(findings(s, d)).select(F.concat(F.lit("c:"), "correlation_id").alias("a"), F.col("link").alias("b")).distinct()
    return graph.components(links)


# --- K: context
pair("k1_neighbours", f"WITH {TL_SQL} SELECT tl_pos, lag(event_id) OVER (ORDER BY tl_pos) AS prev_event_id, lead(event_id) OVER (ORDER BY tl_pos) AS next_event_id FROM tl")(lambda s, d: timeline.neighbours(tl(s, d)).select("tl_pos", "prev_event_id", "next_event_id"))
_PATH = "lower(trim(coalesce(nullif(object_path, ''), nullif(object_name, ''))))"
RELATED_SQL = f"""{EVTX_EVENTS_SQL}, rel AS (SELECT tl_pos, entity_id, CAST(number % 13 AS VARCHAR) AS process_key, {_PATH} AS path_key, lower("user") AS user_key, CASE WHEN record_id % 7 > 0 THEN 'l' || record_id % 7 END AS logon_key, computer AS host_key FROM xtl)"""
pair("k2_relation_keys", f"WITH {RELATED_SQL} SELECT * FROM rel")(lambda s, d: timeline.relation_keys(_related_tl(s, d)).select("tl_pos", "entity_id", *timeline.KEYS))


def _related_tl(s, d):
    """The event log with a process, a logon and a host of each event, in upper case and with blanks."""
    rows = evtx_tl(s, d)
    number = F.get_json_object(F.to_json("evidence_other"), "$.event_id").cast("long")
    logon = F.col("record_id").cast("long") % 7
    return rows.withColumns({"process_id": F.concat(F.lit(" "), (number % 13).cast("string")), "logon_id": F.when(logon > 0, F.concat(F.lit("L"), logon.cast("string"), F.lit(" "))), "host": F.upper("computer")})


_COUNTS = ", ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {k}) - 1 END AS {k}" for k in ("entity_id", "process_key", "path_key", "user_key", "logon_key", "host_key"))


@pair("k2_relation_counts", f"WITH {RELATED_SQL} SELECT tl_pos, {_COUNTS} FROM rel")
def _relation_counts(s, d):
    rows = timeline.relation_keys(_related_tl(s, d)).select("tl_pos", F.col("tl_pos").alias("event_id"), "entity_id", *timeline.KEYS)
    out = rows.select("tl_pos")
    for key in ("entity_id", *timeline.KEYS):
        out = out.join(timeline.related_counts(rows, key).select(F.col("event_id").alias("tl_pos"), F.col("related").alias(key)), "tl_pos")
    return out


_CLASSES = " UNION ALL ".join(f"SELECT '{k}' AS relation, {k} AS key, count(*) AS n FROM rel WHERE {k} IS NOT NULL GROUP BY 2 HAVING count(*) > 1" for k in ("entity_id", "process_key", "path_key", "user_key", "logon_key", "host_key"))
pair("k3_relation_classes", f"WITH {RELATED_SQL} {_CLASSES}")(lambda s, d: timeline.relation_classes(timeline.relation_keys(_related_tl(s, d))))
pair("k3_related_counts", f"WITH {TL_SQL} SELECT event_id, CASE WHEN entity_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY entity_id) - 1 END AS related FROM tl")(lambda s, d: timeline.related_counts(tl(s, d), "entity_id"))
pair("k3_related", f"WITH {TL_SQL} SELECT a.event_id, b.event_id AS related_event_id FROM tl a JOIN tl b ON a.entity_id = b.entity_id AND a.tl_pos <> b.tl_pos")(lambda s, d: timeline.related(tl(s, d), "entity_id"))
