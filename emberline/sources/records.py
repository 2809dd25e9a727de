"""Text and exported tables to landing records: event XML, defender logs, task XML, browser tables, resource usage, detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import columns as C

EVENT_XML = """System struct<EventID: string, Provider: struct<_Name: string>, TimeCreated: struct<_SystemTime: string>, Computer: string, Channel: string, EventRecordID: string>,
EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"""
TASK_XML = """RegistrationInfo struct<Author: string, Date: string, Description: string, URI: string>,
Principals struct<Principal: array<struct<UserId: string, RunLevel: string>>>, Settings struct<Enabled: string, Hidden: string>,
Actions struct<Exec: array<struct<Command: string, Arguments: string, WorkingDirectory: string>>>"""
#: Levels of detections and their other names.
LEVELS = {"critical": "critical", "crit": "critical", "high": "high", "medium": "medium", "med": "medium", "low": "low", "info": "info", "informational": "info"}


def read_landing(spark: SparkSession, path: str, schema: str, form: str = "json", **options) -> DataFrame:
    """A landing table with a fixed schema; rows that don't fit get NULLs. In CSV a quote within quotes is doubled."""
    quotes = {"escape": '"'} if form == "csv" else {}
    return spark.read.schema(schema).options(mode="PERMISSIVE", **(quotes | options)).format(form).load(path)


def pipeline_details(raw: str | Column) -> Column:
    """A map of the two <string> blocks of a PowerShell pipeline record: command_summary, and the key=value lines, values of several lines included."""
    blocks = F.regexp_extract_all(C.col(raw), F.lit("(?s)<string>(.*?)</string>"), F.lit(1))
    pattern = r"(?ms)^[ \t]*(\w+)=(.*?)(?=\n[ \t]*\w+=|\z)"
    second = F.get(blocks, F.lit(1))
    names, values = F.regexp_extract_all(second, F.lit(pattern), F.lit(1)), F.regexp_extract_all(second, F.lit(pattern), F.lit(2))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pairs = F.filter(F.arrays_zip(names.alias("k"), F.transform(values, strip).alias("v")), lambda p: p["v"] != "")
    # of equal names the last counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    summary = F.array(F.struct(F.lit("command_summary").alias("k"), strip(F.get(blocks, F.lit(0))).alias("v")))
    rest = F.when(F.size(blocks) > 1, last).otherwise(F.slice(summary, 1, 0))
    return F.when(F.size(blocks) > 0, F.map_from_entries(F.concat(summary, rest)))


def event_records(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Event XML to landing records of the event log; bad XML gives NULLs. Namespaces are taken off first."""
    plain = F.regexp_replace(C.col(xml), r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    parsed = rows.withColumn("_x", F.from_xml(plain, EVENT_XML))
    data = F.transform("_x.EventData.Data", lambda d: F.struct(d["_Name"].alias("name"), d["_VALUE"].alias("value")))
    out = parsed.withColumns({"event_id": F.col("_x.System.EventID").try_cast("int"), "provider": F.col("_x.System.Provider._Name"), "timestamp": C.coerce_time("_x.System.TimeCreated._SystemTime"), "computer": F.col("_x.System.Computer"), "channel": F.col("_x.System.Channel"), "record_id": F.col("_x.System.EventRecordID").try_cast("long"), "data": data})
    out = out.withColumn("command_line", F.get(F.filter("data", lambda d: d["name"] == "CommandLine"), F.lit(0))["value"])
    details = F.when(F.col("event_id") == 800, pipeline_details(F.replace(F.replace(F.array_join(F.transform("data", lambda d: d["value"]), "\n"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))))
    out = out.withColumn("_d", details)
    names = {"script_name": "ScriptName", "host_application": "HostApplication", "command_summary": "command_summary"}
    return out.withColumns({n: F.try_element_at("_d", F.lit(k)) for n, k in names.items()}).drop("_x", "_d")


def defender_lines(lines: DataFrame, line: str = "line", path: str = "source_path") -> DataFrame:
    """Lines of the two defender logs (by file name) to landing records; lines without a time are left out."""
    name, text = F.lower(C.basename(path)), F.trim(line)
    kind = F.when(name.contains("mpdetection"), "detection_log").when(name.contains("mplog"), "service_log")
    stamp = r"^(\d{4}-\d{2}-\d{2}T.*?Z)\s*(.*)$"
    rows = lines.withColumns({"record_type": kind, "_t": text}).where(F.col("record_type").isNotNull() & F.col("_t").rlike(stamp))
    said, component = F.regexp_extract("_t", stamp, 2), r"^\[([^\]]+)\]\s*(.*)$"
    service = (F.col("record_type") == "service_log") & said.rlike(component)
    message = F.when(service, F.regexp_extract(said, component, 2)).otherwise(said)
    action = C.truthy(F.trim(F.regexp_extract(message, r"^([A-Za-z0-9 _\-/]+?)(?:\:|\(|\.|$)", 1)))
    return rows.select(path, "record_type", C.coerce_time(F.regexp_extract("_t", stamp, 1)).alias("timestamp"), F.when(service, F.regexp_extract(said, component, 1)).alias("component"), action.alias("action"), message.alias("message"))


def read_defender_logs(spark: SparkSession, folder: str) -> DataFrame:
    """UTF-16LE logs, a file a row, to landing records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{MPLog,MPDetection,mplog,mpdetection}*").load(folder)
    lines = files.select(F.col("path").alias("source_path"), F.explode(F.split(F.decode("content", "UTF-16LE"), r"\r?\n")).alias("line"))
    return defender_lines(lines)


def task_records(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Task XML to landing records: the first action and principal; enabled unless it says false, hidden only if it says true."""
    plain = F.regexp_replace(F.regexp_replace(C.col(xml), r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", ""), r"^\s*<\?xml[^>]*\?>", "")
    t = rows.withColumn("_t", F.from_xml(plain, TASK_XML))
    inside = F.regexp_extract(plain, r"(?s)<Triggers>(.*)</Triggers>", 1)
    triggers = F.filter(F.regexp_extract_all(inside, F.lit(r"<(\w+Trigger)\b"), F.lit(1)), lambda x: x != "")
    action, principal = F.get("_t.Actions.Exec", F.lit(0)), F.get("_t.Principals.Principal", F.lit(0))
    return t.withColumns({
        "task_name": F.col("_t.RegistrationInfo.URI"), "author": F.col("_t.RegistrationInfo.Author"), "description": F.col("_t.RegistrationInfo.Description"), "registration_date": C.coerce_time("_t.RegistrationInfo.Date"),
        "command": action["Command"], "arguments": action["Arguments"], "working_directory": action["WorkingDirectory"], "user": principal["UserId"], "run_level": principal["RunLevel"],
        "enabled": F.coalesce(F.lower(F.trim("_t.Settings.Enabled")) != "false", F.lit(True)), "hidden": F.coalesce(F.lower(F.trim("_t.Settings.Hidden")) == "true", F.lit(False)), "triggers": triggers,
    }).drop("_t")


def chromium_history(urls: DataFrame, visits: DataFrame, source_path: str = "source_path") -> DataFrame:
    """One record for each visit of a known address."""
    v = visits.select(F.col("url").alias("_url"), "visit_time", "transition", "visit_duration", source_path, "ingest_seq")
    return urls.join(v, F.col("id") == F.col("_url")).select(C.browser_of_path(source_path).alias("browser"), "url", "title", "visit_count", "typed_count", C.chrome_time("visit_time").alias("visit_time"), C.chrome_time("last_visit_time").alias("last_visit_time"), "transition", "visit_duration", F.col(source_path).alias("source_path"), "ingest_seq")


def chromium_downloads(downloads: DataFrame, source_path: str = "source_path") -> DataFrame:
    plain = ("current_path", "target_path", "received_bytes", "total_bytes", "state", "danger_type", "referrer", "site_url", "tab_url", "mime_type", "ingest_seq")
    return downloads.select(C.browser_of_path(source_path).alias("browser"), *plain, C.chrome_time("start_time").alias("start_time"), C.chrome_time("end_time").alias("end_time"), F.col(source_path).alias("source_path"))


def firefox_history(places: DataFrame, visits: DataFrame, source_path: str = "source_path") -> DataFrame:
    v = visits.select("place_id", "visit_date", source_path, "ingest_seq")
    return places.join(v, F.col("id") == F.col("place_id")).select(F.lit("firefox").alias("browser"), "url", "title", "visit_count", C.firefox_time("visit_date").alias("visit_time"), F.col(source_path).alias("source_path"), "ingest_seq")


def resolve_sru(rows: DataFrame, ids: DataFrame, ids_bounded: bool = False) -> DataFrame:
    """Names of application and user by two look-ups in the id table (id_index, id_type, id_blob); SIDs are of type 3; paths begin with a drive."""
    look = F.broadcast if ids_bounded else lambda df: df
    app = ids.select(F.col("id_index").alias("_a"), F.decode("id_blob", "UTF-16LE").alias("_app"))
    user = ids.where("id_type = 3").select(F.col("id_index").alias("_u"), C.sid_text("id_blob").alias("user_sid"))
    joined = rows.join(look(app), F.col("AppId") == F.col("_a"), "left").join(look(user), F.col("UserId") == F.col("_u"), "left")
    name = C.sru_application(F.regexp_replace("_app", "\0+$", ""))
    return joined.withColumns({"application": name, "application_path": F.when(name.rlike(r"^[A-Za-z]:\\"), name), "application_id": F.col("AppId"), "user_id": F.col("UserId")}).drop("_a", "_u", "_app")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """The scanner's CSV, all texts; a byte-order mark before the first name is taken off."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def detection_statistics(rows: DataFrame) -> DataFrame:
    """One row: detections, counts by level, and distinct channels, rules, event ids and computers that are not blank."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.lower(F.trim(F.coalesce("Level", F.lit("")))))
    distinct = {"channels": "Channel", "rules": "RuleID", "event_ids": "EventID", "computers": "Computer"}
    return rows.withColumn("_l", level).agg(F.count("*").alias("detections"), *[F.count_if(F.col("_l") == x).alias(x) for x in ("critical", "high", "medium", "low", "info")], *[F.count_distinct(C.truthy(F.trim(c))).alias(n) for n, c in distinct.items()])


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, times as ISO text, bytes as text where they are UTF-8 and as hex where not."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind.startswith("timestamp"):
            c = C.iso(c)
        elif kind == "binary":
            c = F.coalesce(F.try_validate_utf8(c.cast("string")), F.lower(F.hex(c)))
        shown.append(c.alias(f.name))
    df.select(*shown).write.json(path)
