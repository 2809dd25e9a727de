"""Queries of sources (A): manifests, classification, records out of text, browser tables, looks into files."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.operators.store import shared_path
from emberline.sources import files, looks, records

from .adapters import EVT, SEP, view
from .core import joined, pair

#: A path for each kind of artifact, and its type; the last ones are of no type.
PATHS = {
    r"C:\Logs\Security.evtx": "evtx", r"C:\Windows\Prefetch\CALC.EXE-1.pf": "prefetch", r"C:\x\calc.pf": None, r"C:\Windows\AppCompat\Amcache.hve": "amcache", r"C:\Windows\System32\config\SYSTEM": "registry_system",
    r"C:\Users\bob\NTUSER.DAT": "registry_ntuser", r"C:\Users\bob\ntuser.dat.LOG1": "registry_transaction_log", r"C:\$MFT": "mft", r"C:\$Extend\$J": "usn", r"C:\Windows\Tasks\Update": "scheduled_task", r"C:\SRU\SRUDB.dat": "sru",
    r"C:\SRU\SRU00.log": "ese_support", r"C:\Users\eve\a.LNK": "lnk", r"C:\r\x.automaticDestinations-ms": "jumplist", r"C:\Users\eve\Google\Chrome\History": "browser", r"C:\Users\eve\Firefox\p\places.sqlite": "browser",
    r"C:\odd\notes.TXT": None, r"C:\odd\README": None, r"C:\odd\t.csv": None, r"C:\odd\a.json": None,
}
#: For a path with a backslash after the drive, as SQL that both engines read alike.
_sql_path = lambda p: "concat(" + f", {SEP}, ".join(f"'{x}'" for x in p.split("\\")) + ")"
_CASE = "CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN {_sql_path(p)}" for i, p in enumerate(PATHS)) + " END"
MANIFEST = f"SELECT p_partkey AS seq, p_size AS size, {_CASE.format(n=len(PATHS))} AS path FROM part"
TYPE = f"CASE seq % {len(PATHS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PATHS.values()) if t) + " END"
classified = lambda s, d: view(s, d, MANIFEST, "part").withColumn("artifact_type", files.artifact_type("path"))

pair("a1_manifest")(lambda s, d: files.manifest(s, d).select(C.basename("path").alias("name"), "size"))
pair("a2_classify", f"WITH m AS ({MANIFEST}) SELECT seq, {TYPE} AS artifact_type FROM m")(lambda s, d: classified(s, d).select("seq", "artifact_type"))
pair("a3_inventory", f"WITH m AS ({MANIFEST}), c AS (SELECT {TYPE} AS artifact_type FROM m), g AS (SELECT artifact_type, count(*) AS n FROM c WHERE artifact_type IS NOT NULL GROUP BY 1) SELECT * FROM g UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT) FROM g")(lambda s, d: files.inventory(classified(s, d)))
pair("a4_unknown_extensions", f"WITH m AS ({MANIFEST}) SELECT CASE seq % {len(PATHS)} WHEN 2 THEN '.pf' WHEN 16 THEN '.txt' WHEN 17 THEN '<no_extension>' WHEN 18 THEN '.csv' ELSE '.json' END AS extension, count(*) AS n FROM m WHERE {TYPE} IS NULL GROUP BY 1")(lambda s, d: files.unknown_extensions(classified(s, d)))
pair("a5_read_landing", "SELECT event_id, event_type, value FROM events")(lambda s, d: records.read_landing(s, f"{d}/events.parquet", "event_id long, event_type string, value double", "parquet"))
pair("a6_unparsed", f"WITH m AS ({MANIFEST}), c AS (SELECT seq, {TYPE} AS artifact_type FROM m) SELECT seq, artifact_type FROM c WHERE artifact_type IN ('registry_transaction_log', 'ese_support')")(lambda s, d: files.unparsed(classified(s, d)).select("seq", "artifact_type"))


def _browser_tables(s, d):
    pages, events = s.read.parquet(f"{d}/pages.parquet"), s.read.parquet(f"{d}/events.parquet")
    micros = F.timestamp_diff("MICROSECOND", F.expr(C.EPOCH), F.col("ts"))
    urls = pages.select(F.col("page_id").alias("id"), F.col("page_id").alias("place"), "url", F.lit("t").alias("title"), F.lit(3).alias("visit_count"), F.lit(1).alias("typed_count"), F.lit(0).alias("last_visit_time"))
    visits = events.select((F.col("event_id") % 700).alias("url"), (F.col("event_id") % 700).alias("place_id"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(micros + C.MICROS_1601).alias("visit_time"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(micros).alias("visit_date"), F.lit(1).alias("transition"), F.lit(2).alias("visit_duration"), F.lit(r"C:\u\Google\Chrome\History").alias("source_path"), F.col("event_id").alias("ingest_seq"))
    return urls, visits


_VISITS = "SELECT event_id AS ingest_seq, url, '{browser}' AS browser, CASE WHEN event_id % 11 <> 0 THEN ts END AS visit_time FROM events JOIN pages ON page_id = event_id % 700"
pair("a7_chromium_history", _VISITS.format(browser="chrome"))(lambda s, d: records.chromium_history(*_browser_tables(s, d)).select("ingest_seq", "url", "browser", "visit_time"))
pair("a8_chromium_downloads", f"WITH e AS ({EVT}) SELECT ingest_seq, object_path AS target_path, 'edge' AS browser, timestamp AS start_time FROM e WHERE event_type = 'file_download'")(lambda s, d: _chromium_downloads(s, d).select("ingest_seq", "target_path", "browser", "start_time"))
pair("a9_firefox_history", _VISITS.format(browser="firefox"))(lambda s, d: records.firefox_history(*_browser_tables(s, d)).select("ingest_seq", "url", "browser", "visit_time"))
pair("a10_browser_of_path", f"WITH m AS ({MANIFEST}) SELECT seq, CASE seq % {len(PATHS)} WHEN 14 THEN 'chrome' WHEN 15 THEN 'firefox' ELSE 'unknown' END AS browser FROM m")(lambda s, d: view(s, d, MANIFEST, "part").select("seq", C.browser_of_path("path").alias("browser")))


def _chromium_downloads(s, d):
    rows = view(s, d, EVT, "events").where("event_type = 'file_download'")
    micros = F.timestamp_diff("MICROSECOND", F.expr(C.EPOCH), F.col("timestamp")) + C.MICROS_1601
    t = F.lit(None).cast("string")
    made = rows.select("ingest_seq", F.col("object_path").alias("target_path"), micros.alias("start_time"), F.lit(0).alias("end_time"), *[t.alias(n) for n in ("current_path", "referrer", "site_url", "tab_url", "mime_type", "state", "danger_type", "received_bytes", "total_bytes")], F.lit(r"C:\Edge\History").alias("source_path"))
    return records.chromium_downloads(made)


pair("a11_event_xml", "SELECT event_id AS record_id, CAST(event_id % 5000 AS INT) AS event_id, event_type AS provider, date_trunc('millisecond', ts) AS timestamp, 'pc' || user_id AS computer, 'run ' || event_id % 7 AS command_line FROM events")(lambda s, d: _event_xml(s, d))


def _event_xml(s, d):
    rows = s.read.parquet(f"{d}/events.parquet")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("000"))
    xml = F.concat(F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="'), "event_type", F.lit('"/><EventID>'), (F.col("event_id") % 5000).cast("string"), F.lit('</EventID><TimeCreated SystemTime="'), iso, F.lit('1Z"/><EventRecordID>'), F.col("event_id").cast("string"), F.lit("</EventRecordID><Channel>Main</Channel><Computer>pc"), F.col("user_id").cast("string"), F.lit('</Computer></System><EventData><Data Name="A">1</Data><Data Name="CommandLine">run '), (F.col("event_id") % 7).cast("string"), F.lit('</Data><Data Name="CommandLine">no</Data></EventData></Event>'))
    return records.event_records(rows.select(xml.alias("xml"))).select("record_id", "event_id", "provider", "timestamp", "computer", "command_line")


PAYLOAD = "SELECT event_id, concat('<string> sum ', event_id % 9, ' </string>', CASE WHEN event_id % 4 <> 0 THEN concat('<string>', chr(10), ' ScriptName=s', event_id % 3, '.ps1', chr(10), 'HostApplication=a', chr(10), 'b', chr(10), ' Empty=', chr(10), 'ScriptName=t', event_id % 5, '</string>') ELSE '' END) AS raw FROM events"
pair("a12_pipeline_details", "SELECT event_id, 'sum ' || event_id % 9 AS command_summary, CASE WHEN event_id % 4 <> 0 THEN 't' || event_id % 5 END AS script_name, CASE WHEN event_id % 4 <> 0 THEN 'a' || chr(10) || 'b' END AS host_application FROM events")(
    lambda s, d: view(s, d, PAYLOAD, "events").withColumn("m", records.pipeline_details("raw")).select("event_id", *[F.try_element_at("m", F.lit(k)).alias(n) for k, n in (("command_summary", "command_summary"), ("ScriptName", "script_name"), ("HostApplication", "host_application"))])
)
LINES = f"SELECT event_id, concat('C:', {SEP}, CASE event_id % 3 WHEN 0 THEN 'MPLog-1.log' WHEN 1 THEN 'MPDetection-1.log' ELSE 'other.log' END) AS source_path, CASE WHEN event_id % 5 = 0 THEN 'no time here' ELSE concat('2024-01-02T03:04:05.', 100 + event_id % 900, 'Z [Cloud] Scan it: ', event_id) END AS line FROM events"
pair("a13_defender_lines", """SELECT 'C:' || chr(92) || CASE event_id % 3 WHEN 0 THEN 'MPLog-1.log' ELSE 'MPDetection-1.log' END AS source_path, TIMESTAMP '2024-01-02 03:04:05' + to_milliseconds(100 + event_id % 900) AS timestamp, CASE WHEN event_id % 3 = 0 THEN 'Cloud' END AS component, CASE WHEN event_id % 3 = 0 THEN 'Scan it' END AS action,
CASE WHEN event_id % 3 = 0 THEN '' ELSE '[Cloud] ' END || 'Scan it: ' || event_id AS message FROM events WHERE event_id % 3 < 2 AND event_id % 5 <> 0""")(lambda s, d: records.defender_lines(view(s, d, LINES, "events")).select("source_path", "timestamp", "component", "action", "message"))
TASK = """SELECT s_suppkey, concat('<?xml version="1.0"?><Task xmlns="http://x"><RegistrationInfo><Author>a', s_nationkey, '</Author><URI>', s_name, '</URI></RegistrationInfo><Triggers>', CASE s_suppkey % 2 WHEN 0 THEN '<TimeTrigger><Enabled>true</Enabled></TimeTrigger><LogonTrigger/>' ELSE '' END, '</Triggers><Principals><Principal><UserId>u</UserId></Principal></Principals><Settings>', CASE s_suppkey % 3 WHEN 0 THEN '<Enabled>false</Enabled><Hidden>true</Hidden>' ELSE '' END, '</Settings><Actions><Exec><Command>c', s_suppkey, '</Command></Exec><Exec><Command>second</Command></Exec></Actions></Task>') AS xml FROM supplier"""
pair("a14_task_xml", "SELECT s_suppkey, s_name AS task_name, 'a' || s_nationkey AS author, 'c' || s_suppkey AS command, s_suppkey % 3 <> 0 AS enabled, s_suppkey % 3 = 0 AS hidden, CASE s_suppkey % 2 WHEN 0 THEN 'TimeTrigger|LogonTrigger' ELSE '' END AS triggers FROM supplier")(lambda s, d: records.task_records(view(s, d, TASK, "supplier")).select("s_suppkey", "task_name", "author", "command", "enabled", "hidden", joined("triggers").alias("triggers")))


def _sru(s, d):
    ids = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id_index"), (F.col("c_custkey") % 4).alias("id_type"), F.when(F.col("c_custkey") % 4 == 3, F.unhex(F.concat(F.lit("0102000000000005"), F.lit("20000000"), F.lit("22020000")))).otherwise(F.encode(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("!!app"), F.col("c_custkey").cast("string"), F.lit("!t!h!"))).otherwise(F.concat(F.lit("C:\\p\\"), F.col("c_custkey").cast("string"))), "UTF-16LE")).alias("id_blob"))
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 300).alias("AppId"), F.col("user_id").alias("UserId"))
    return records.resolve_sru(rows, ids)


pair("a15_resolve_sru", """WITH r AS (SELECT event_id, event_id % 300 AS a, user_id AS u FROM events), n AS (SELECT count(*) AS c FROM customer) SELECT event_id, CASE WHEN a < c THEN CASE a % 4 WHEN 0 THEN 'app' || a WHEN 3 THEN 'binary' ELSE 'C:' || chr(92) || 'p' || chr(92) || a END END AS application, CASE WHEN a < c AND a % 4 IN (1, 2) THEN 'C:' || chr(92) || 'p' || chr(92) || a END AS application_path,
CASE WHEN u < c AND u % 4 = 3 THEN 'S-1-5-32-546' END AS user_sid FROM r, n""")(lambda s, d: _sru(s, d).select("event_id", F.when(F.col("AppId") % 4 == 3, F.when(F.col("application").isNotNull(), "binary")).otherwise(F.col("application")).alias("application"), F.when(F.col("AppId") % 4 != 3, F.col("application_path")).alias("application_path"), "user_sid"))
pair("a16_sid_text", "SELECT c_custkey, 'S-1-5-21-' || c_custkey || '-' || (c_custkey % 256) AS sid FROM customer")(
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.sid_text(F.unhex(F.concat(F.lit("0103000000000005" + "15000000"), *[F.substr(F.lpad(F.hex("c_custkey"), 8, "0"), F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)], F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"), F.lit("000000")))).alias("sid"))
)
pair("a17_sru_application", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS application FROM part")(lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", C.sru_application(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("!!"), "p_brand", F.lit("!2020!ab!"))).otherwise(F.col("p_name"))).alias("application")))
pair("a18_file_reference", "SELECT o_orderkey, CAST(o_custkey % 7 AS BIGINT) * 281474976710656 + o_orderkey AS ref FROM orders")(lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", C.file_reference("o_orderkey", F.col("o_custkey") % 7).alias("ref")))
pair("a19_user_of_path", f"WITH e AS ({EVT}) SELECT ingest_seq, CASE WHEN artifact_type = 'browser' THEN \"user\" END AS owner FROM e")(lambda s, d: view(s, d, EVT, "events").select("ingest_seq", C.user_of_path("object_path").alias("owner")))
KIND = f"CASE seq % {len(PATHS)} WHEN 6 THEN 'log' WHEN 11 THEN 'log' WHEN 15 THEN 'sqlite' WHEN 16 THEN 'text' WHEN 17 THEN 'markdown' WHEN 18 THEN 'csv' WHEN 19 THEN 'json' ELSE 'binary' END"
pair("a20_category", f"WITH m AS ({MANIFEST}) SELECT seq, {KIND} AS category FROM m")(lambda s, d: view(s, d, MANIFEST, "part").select("seq", files.category("path").alias("category")))


def _contents(s, d, kind: str, column):
    rows = s.read.parquet(f"{d}/documents.parquet")
    return looks.look_into(rows.select(F.col("doc_id").cast("string").alias("path"), F.lit(kind).alias("category"), F.encode(column, "UTF-8").alias("content")))


pair("a21_text_context", "SELECT doc_id::VARCHAR AS path, length(text) - length(replace(text, chr(10), '')) AS lines, 'utf-8' AS encoding FROM documents")(lambda s, d: _contents(s, d, "text", F.col("text")).select("path", "lines", "encoding"))
pair("a22_csv_context", "SELECT doc_id::VARCHAR AS path, 'a|b' AS columns, CAST(doc_id AS VARCHAR) || '|x,y' AS first_row FROM documents")(lambda s, d: _contents(s, d, "csv", F.concat(F.lit("a,b\n"), F.col("doc_id").cast("string"), F.lit(',"x,y"\n'))).select("path", joined("columns").alias("columns"), joined(F.get("preview_rows", F.lit(0))).alias("first_row")))
JSONS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('[', event_id, ',2]') WHEN 2 THEN '{bad' ELSE concat('{"z":1,"a":', event_id, '}') END AS text FROM events"""
pair("a23_json_context", """SELECT event_id, event_id % 4 <> 2 AS valid, CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 3 THEN 'object' END AS kind, CASE event_id % 4 WHEN 0 THEN 'k' WHEN 3 THEN 'a|z' END AS keys, CASE event_id % 4 WHEN 1 THEN 2 END AS length FROM events""")(lambda s, d: view(s, d, JSONS, "events").select("event_id", files.json_context("text").alias("c")).select("event_id", "c.valid", "c.kind", joined("c.keys").alias("keys"), "c.length"))


@pair(
    "a23_json_look",
    """SELECT event_id::VARCHAR AS path, event_id % 4 <> 2 AS valid, CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 3 THEN 'object' END AS kind, CASE event_id % 4 WHEN 0 THEN 'k' WHEN 3 THEN 'a|z' END AS keys,
CASE event_id % 4 WHEN 1 THEN 2 END AS length, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('[', event_id, ',2]') WHEN 2 THEN '{bad' ELSE concat('{"z":1,"a":', event_id, '}') END AS preview FROM events""",
)
def _json_look(s, d):
    rows = view(s, d, JSONS, "events").select(F.col("event_id").cast("string").alias("path"), F.lit("json").alias("category"), F.encode("text", "UTF-8").alias("content"))
    seen = looks.look_into(rows)
    return seen.select("path", F.col("json_valid").alias("valid"), F.col("json_type").alias("kind"), joined("json_keys").alias("keys"), F.col("json_length").cast("int").alias("length"), "preview")


pair("a24_xml_context", "SELECT doc_id::VARCHAR AS path, doc_id % 2 = 0 AS xml_valid, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id END AS root_tag FROM documents")(lambda s, d: _contents(s, d, "xml", F.concat(F.lit("<r"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "/>").otherwise(">"))).select("path", "xml_valid", "root_tag"))
pair("a25_unreadable", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 'unreadable' ELSE 'text' END AS category, CASE WHEN doc_id % 3 = 0 THEN 'no content' END AS error FROM documents")(lambda s, d: _contents(s, d, "text", F.when(F.col("doc_id") % 3 != 0, F.col("text"))).select("path", "category", "error"))
pair("a26_inventory_context", f"""WITH m AS ({MANIFEST}), c AS (SELECT *, {KIND} AS category FROM m), o AS (SELECT path, category, min(seq) AS seq FROM c GROUP BY 1, 2), h AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY category ORDER BY seq) <= 3)
SELECT category, (SELECT count(*) FROM o WHERE o.category = h.category) AS n, string_agg(path, '|' ORDER BY path) AS artifacts FROM h GROUP BY category""")(
    lambda s, d: files.inventory_context(view(s, d, MANIFEST, "part").select("path", C.basename("path").alias("name"), files.category("path").alias("category"), "seq")).select("category", "n", F.array_join(F.transform("artifacts", lambda a: a["path"]), "|").alias("artifacts"))
)


def _exported(s, d):
    path = shared_path(s, "export")
    records.export_json(s.read.parquet(f"{d}/events.parquet").select("event_id", "ts", F.unhex(F.lit("FF00")).alias("odd"), F.encode("event_type", "UTF-8").alias("plain")), path)
    return s.read.schema("event_id long, ts string, odd string, plain string").json(path)


pair("a27_export_json", r"SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '') AS ts, 'ff00' AS odd, event_type AS plain FROM events")(_exported)
DETECTIONS = """SELECT event_id, CASE event_type WHEN 'click' THEN 'crit' WHEN 'view' THEN ' High ' WHEN 'purchase' THEN 'med' WHEN 'signup' THEN 'informational' ELSE 'odd' END AS Level, CASE WHEN user_id % 5 = 0 THEN ' ' ELSE concat('c', user_id % 7) END AS Channel, concat('r', event_id % 97) AS RuleID, concat('', event_id % 31) AS EventID, concat('pc', user_id) AS Computer FROM events"""


def _detections(s, d):
    path = shared_path(s, "detections")
    rows = view(s, d, DETECTIONS, "events")
    rows.withColumnRenamed("event_id", "﻿event_id").write.option("header", "true").csv(path)
    return records.read_detections(s, path)


pair("a28_read_detections", f"WITH x AS ({DETECTIONS}) SELECT event_id::VARCHAR AS event_id, trim(Level) AS level, RuleID AS rule FROM x")(lambda s, d: _detections(s, d).select("event_id", F.trim("Level").alias("level"), F.col("RuleID").alias("rule")))
pair("a29_detection_statistics", f"""WITH x AS ({DETECTIONS}) SELECT count(*) AS detections, count(*) FILTER (Level = 'crit') AS critical, count(*) FILTER (trim(Level) = 'High') AS high, count(*) FILTER (Level = 'med') AS medium, CAST(0 AS BIGINT) AS low, count(*) FILTER (Level = 'informational') AS info, count(DISTINCT nullif(trim(Channel), '')) AS channels, count(DISTINCT RuleID) AS rules, count(DISTINCT EventID) AS event_ids, count(DISTINCT Computer) AS computers FROM x""")(lambda s, d: records.detection_statistics(view(s, d, DETECTIONS, "events")))
