"""Landing tables to the one event schema: a projection, a filter or an explode for each artifact type.

Landing tables carry ``ingest_seq`` (their place in the record stream); ``emit_ord`` tells apart the
events of one record. Evidence is two maps: texts, and everything else as JSON or plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

from .tops import first_distinct, joined_on

CORE = (
    "event_id", "artifact_type", "event_type", "category", "timestamp", "object_name", "object_path", "related_objects", "user", "computer",
    "description", "confidence", "evidence_str", "evidence_other", "source_file", "record_id", "ingest_seq", "emit_ord",
)


def events(rows: DataFrame, artifact: str, event_type, category, timestamp, *, name=None, path=None, related: Column | None = None, user=None, computer=None, description=None, confidence=1.0, evidence: dict | None = None, other: dict | None = None, source="source_path", record_id=None, hash_record_id: bool = True, extra: dict | None = None, emit: Column | None = None) -> DataFrame:
    """The core columns of a normalized event from columns or expressions of ``rows``, and ``extra`` ones."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    none, null = F.expr("cast(map() as map<string, string>)"), F.lit(None).cast("string")
    name, path, user, computer, source = (null if c is None else C.col(c) for c in (name, path, user, computer, source))
    timestamp, description = C.col(timestamp), null if description is None else text(description)
    record = null if record_id is None else C.col(record_id).cast("string")
    core = {
        "event_id": C.event_id(F.lit(artifact), text(event_type), timestamp, source, name, path, record if hash_record_id and record_id is not None else None),
        "artifact_type": F.lit(artifact),
        "event_type": text(event_type),
        "category": text(category),
        "timestamp": timestamp,
        "object_name": name,
        "object_path": path,
        "related_objects": C.strings() if related is None else related,
        "user": user,
        "computer": computer,
        "description": description,
        "confidence": text(confidence).cast("double"),
        "evidence_str": C.text_map(evidence) if evidence else none,
        "evidence_other": C.text_map(other) if other else none,
        "source_file": source,
        "record_id": record,
        "ingest_seq": F.col("ingest_seq"),
        "emit_ord": F.lit(0) if emit is None else emit,
    }
    return rows.select(*[c.alias(n) for n, c in core.items()], *[C.col(c).alias(n) for n, c in (extra or {}).items()])


# --- event log

#: Fixed values: (provider, event id) to event type, category, description.
EVTX_TYPES = {
    ("Microsoft-Windows-Security-Auditing", 4624): ("successful_logon", "authentication", "Successful logon"),
    ("Microsoft-Windows-Security-Auditing", 4625): ("failed_logon", "authentication", "Failed logon"),
    ("Microsoft-Windows-Security-Auditing", 4688): ("process_execution", "execution", "Process execution"),
    ("Microsoft-Windows-Security-Auditing", 4689): ("process_termination", "execution", "Process terminated"),
    ("Service Control Manager", 7045): ("service_install", "persistence", "Service installed"),
    ("Microsoft-Windows-Eventlog", 1102): ("log_cleared", "system", "Windows event log cleared"),
    ("Microsoft-Windows-Eventlog", 104): ("log_cleared", "system", "Windows event log cleared"),
    ("PowerShell", 800): ("powershell_pipeline_execution", "execution", "PowerShell pipeline execution"),
}


def evtx(rows: DataFrame) -> DataFrame:
    """``data`` is array<struct<name, value>>, the record's EventData in order (NULL where there is none)."""
    provider = F.coalesce(F.trim("provider"), F.lit(""))
    looked_up = F.element_at(F.create_map(*[x for (p, i), v in EVTX_TYPES.items() for x in (F.lit(f"{p}|{i}"), F.struct(*[F.lit(t).alias(n) for t, n in zip(v, "tcd", strict=True)]))]), F.concat_ws("|", provider, F.col("event_id").cast("string")))
    last = lambda keep: F.try_element_at(F.filter("data", lambda d: (F.coalesce(d["value"], F.lit("")) != "") & keep(d)), F.lit(-1))["value"]
    rows = rows.withColumns({"_known": looked_up, "_process": last(lambda d: d["name"].isin("NewProcessName", "ProcessName")), "_user": last(lambda d: d["name"].isin("TargetUserName", "SubjectUserName") & (d["value"] != "-")), "_script": C.truthy("script_name")})
    path = F.when(F.col("event_id") == 800, F.coalesce("_script", "_process")).otherwise(F.col("_process"))
    number = F.col("event_id").cast("string")
    plain = F.when(provider != "", F.concat(F.lit("Windows Event "), number, F.lit(" ("), provider, F.lit(")"))).otherwise(F.concat(F.lit("Windows Event "), number))
    event_type = F.coalesce(F.col("_known.t"), F.lit("unknown_event"))
    said = F.when((event_type == "powershell_pipeline_execution") & F.col("_script").isNotNull(), F.concat(F.lit("PowerShell script executed: "), "_script")).otherwise(F.coalesce(F.col("_known.d"), plain))
    texts = ("provider", "channel", "command_line", "script_name", "host_application", "command_summary")
    return events(rows, "evtx", event_type, F.coalesce(F.col("_known.c"), F.lit("system")), "timestamp", name=C.last_part(path), path=path, user=C.truthy("_user"), computer="computer", description=said, evidence={t: t for t in texts}, other={"event_id": "event_id", "record_id": "record_id"}, record_id="record_id", extra={t: t for t in ("command_line", "script_name", "host_application")})


def prefetch(rows: DataFrame) -> DataFrame:
    """An execution for each of the last run times that is not NULL."""
    runs = rows.select("*", F.posexplode("last_run_times").alias("_ord", "_time")).where("_time IS NOT NULL")
    other = {"prefetch_version": "prefetch_version", "run_count": "run_count", "all_last_run_times": F.to_json("last_run_times"), "loaded_files_count": F.size("loaded_files")}
    return events(runs, "prefetch", "process_execution", "execution", "_time", name="filename", related=F.coalesce("loaded_files", C.strings()), description=F.concat("filename", F.lit(" was executed")), confidence=0.95, evidence={"prefetch_hash": "prefetch_hash"}, other=other, emit=F.col("_ord"))


# --- registry


def registry_route(key_path: str | Column = "key_path") -> Column:
    """run, services, userassist, usbstor, recentdocs or NULL; the first that fits."""
    low = F.lower(F.coalesce(C.col(key_path), F.lit("")))
    routes = (("run", r"\currentversion\run"), ("services", r"\services"), ("userassist", r"\userassist"), ("usbstor", r"\usbstor"), ("recentdocs", r"\recentdocs"))
    return F.coalesce(*[F.when(low.contains(mark), route) for route, mark in routes])


def _routed(rows: DataFrame, route: str) -> DataFrame:
    return rows.where(registry_route() == route)


def run_keys(rows: DataFrame) -> DataFrame:
    """values: array<struct<name, type, value_data (text), value_bytes>>; a persistence event for each."""
    v = _routed(rows, "run").select("*", F.posexplode("values").alias("_ord", "_v"))
    return events(v, "registry", "persistence", "persistence", "last_written", name=F.coalesce(C.truthy("_v.name"), F.lit("(Default)")), path=F.col("_v.value_data"), description=F.concat(F.lit("Registry Run key: "), F.coalesce(F.col("_v.name"), F.lit("None"))), confidence=0.95, evidence={"key_path": "key_path"}, emit=F.col("_ord"))


def _last_value(name: str, field: str = "value_data", lower: bool = False) -> Column:
    """The last value of that name, in the sense of the last that was written to a dictionary."""
    return F.try_element_at(F.filter("values", lambda v: (F.lower(v["name"]) if lower else v["name"]) == name), F.lit(-1))[field]


def utf16(data: Column) -> Column:
    return F.regexp_replace(F.decode(data, "UTF-16LE"), "\0+$", "")


START_TYPES = {0: "Boot", 1: "System", 2: "Automatic", 3: "Manual", 4: "Disabled"}  # fixed values


def services(rows: DataFrame) -> DataFrame:
    image = F.coalesce(_last_value("ImagePath"), utf16(_last_value("ImagePath", "value_bytes")))
    s = _routed(rows, "services").withColumns({"_image": image, "_name": F.coalesce(C.truthy(_last_value("DisplayName")), F.col("key_name"))}).where("_image IS NOT NULL")
    start = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in START_TYPES.items() for x in kv]), _last_value("Start").try_cast("int")), F.lit("Unknown"))
    said = F.concat(F.lit("Windows service '"), F.coalesce("_name", F.lit("None")), F.lit("' configured to start from "), "_image")
    return events(s, "registry", "service_created", "persistence", "last_written", name="_name", path="_image", description=said, confidence=0.95, evidence={"key_path": "key_path", "service_name": "_name", "image_path": "_image"}, extra={"start_type": start})


def userassist(rows: DataFrame) -> DataFrame:
    v = _routed(rows, "userassist").select("*", F.posexplode("values").alias("_ord", "_v")).where("_v.type = 'REG_BINARY'")
    v = v.withColumn("_name", C.rot13(F.coalesce(F.col("_v.name"), F.lit("")))).where(~F.col("_name").startswith("UEME_"))
    return events(v, "registry", "process_execution", "execution", "last_written", name="_name", description=F.concat(F.lit("UserAssist execution: "), "_name"), confidence=0.90, evidence={"key_path": "key_path", "encoded_name": "_v.name", "decoded_name": "_name"}, emit=F.col("_ord"))


USB_DEVICE = r"(?i)^Disk&Ven_([^&]+)&Prod_([^&]+)&Rev_(.+)$"
USB_VALUES = ("friendly_name", "parent_id_prefix", "container_id", "class_guid", "service")


def usb_devices(rows: DataFrame) -> DataFrame:
    """Keys ...\\Enum\\USBSTOR\\<device>\\<serial>, no deeper and no shallower."""
    parts = F.filter(F.split(F.regexp_replace("key_path", "/", r"\\"), r"\\"), lambda p: p != "")
    u = _routed(rows, "usbstor").withColumn("_p", parts).withColumn("_at", F.array_position(F.transform("_p", F.lower), F.lit("usbstor")).cast("int"))
    u = u.where((F.col("_at") >= 2) & (F.size("_p") == F.col("_at") + 2)).where(F.lower(F.get("_p", F.col("_at") - 2)) == "enum")
    device, serial = F.get("_p", F.col("_at")), F.get("_p", F.col("_at") + 1)
    u = u.where(device.rlike(USB_DEVICE)).withColumns({n: F.trim(F.regexp_replace(F.regexp_extract(device, USB_DEVICE, i), "_", " ")) for i, n in enumerate(("vendor", "product", "revision"), 1)})
    u = u.withColumns({n: F.regexp_replace(F.coalesce(_last_value(n.replace("_", ""), lower=True), F.decode(_last_value(n.replace("_", ""), "value_bytes", lower=True), "UTF-16LE")), "\0+$", "") for n in USB_VALUES} | {"_serial": serial, "_device": device})
    both = F.concat("vendor", F.lit(" "), "product")
    extra = {n: n for n in ("vendor", "product", "revision")} | {"serial_number": "_serial", "device_instance_id": F.concat("_device", F.lit("\\"), "_serial")} | {n: n for n in USB_VALUES} | {"timestamp_semantics": F.lit("registry_key_last_written")}
    return events(u, "registry", "usb_device_connected", "device", "last_written", name=F.coalesce(C.truthy("friendly_name"), both), description=F.concat(F.lit("USB storage device history: "), both, F.lit(" ("), "_serial", F.lit(")")), confidence=0.95, evidence={"hive": "hive", "key_path": "key_path"}, extra=extra)


#: File name extensions of documents that are of interest.
DOCUMENT_EXTENSIONS = (
    "exe", "lnk", "txt", "csv", "log", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z", "msi", "ps1", "bat", "cmd", "py",
    "js", "vbs", "json", "xml", "yml", "yaml", "dll", "sys", "conf", "config", "ini", "reg", "evtx", "sqlite", "db-wal", "db-shm", "db",
)


def document_in(text: Column) -> Column:
    """The best document name in NUL-separated text: a full path before a bare name, then the shortest."""
    ends = r"\.(?:" + "|".join(DOCUMENT_EXTENSIONS) + ")"
    items = F.filter(F.transform(F.split(text, "\0"), F.trim), lambda s: s != "")
    found = lambda pattern, score: F.transform(F.filter(items, lambda s: s.rlike(pattern)), lambda s: F.struct(F.lit(score).alias("score"), F.regexp_extract(s, pattern, 1).alias("name")))
    paths, names = found(rf"(?i)([A-Za-z]:\\[^\x00\r\n]+?{ends})$", 100), found(rf"(?i)([^\\/\x00\r\n]+?{ends})$", 50)
    printable = F.filter(names, lambda c: ~c["name"].rlike(r"\p{C}"))
    plain = F.filter(F.concat(paths, printable), lambda c: ~C.basename(F.lower(c["name"])).startswith("~$") & ~C.basename(F.lower(c["name"])).isin("thumbs.db", "desktop.ini"))
    return F.array_max(F.transform(plain, lambda c: F.struct(c["score"].alias("score"), (-F.length(c["name"])).alias("size"), c["name"].alias("name"))))["name"]


def recent_documents(rows: DataFrame) -> DataFrame:
    """Values with decimal names of a user's hives; their bytes, or hex text of them, hold the name."""
    v = _routed(rows, "recentdocs").where(F.lower("hive").isin("ntuser.dat", "usrclass.dat")).select("*", F.posexplode("values").alias("_ord", "_v")).where("_v.name RLIKE '^[0-9]+$' AND _v.type = 'REG_BINARY'")
    text = F.trim("_v.value_data")
    data = F.coalesce("_v.value_bytes", F.when(text.rlike("^(?:[0-9a-fA-F]{2})+$"), F.unhex(text)))
    v = v.withColumn("_doc", document_in(F.decode(data, "UTF-16LE"))).where(C.truthy("_doc").isNotNull())
    extra = {"document": C.basename("_doc"), "document_path": "_doc", "registry_key": "key_path", "registry_value": "_v.name", "timestamp_semantics": F.lit("registry_key_last_written")}
    return events(v, "registry", "document_opened", "user_activity", "last_written", name=C.basename("_doc"), path="_doc", user="user", description=F.concat(F.lit("RecentDocs reference: "), "_doc"), confidence=0.65, evidence={"hive": "hive", "key_path": "key_path", "value_name": "_v.name"}, emit=F.col("_ord"), extra=extra)


# --- shortcuts, programs, browser


def _shortcut(rows: DataFrame, artifact: str, event_type: str, timestamp: str, own_name: str, plain: str, said: str, confidence: float) -> DataFrame:
    target = C.truthy("target_path")
    name = F.when(target.isNotNull(), C.last_part(target)).otherwise(F.col(own_name))
    texts = ("relative_path", "working_directory", "description", "command_line_arguments", "icon_location", "drive_serial", "drive_type", "volume_label")
    return events(rows, artifact, event_type, "user_activity", timestamp, name=name, path="target_path", description=F.when(target.isNotNull(), F.concat(F.lit(said), name)).otherwise(plain), confidence=confidence, evidence={own_name: own_name} | {t: t for t in texts}, other={"file_size": "file_size"}, source=None)


def lnk(rows: DataFrame) -> DataFrame:
    """``source_file`` is NULL, as the parser and the normalizer disagree on its name."""
    return _shortcut(rows, "lnk", "shortcut_reference", "modified_time", "lnk_name", "Shortcut reference", "Shortcut referencing ", 0.80)


def jumplist(rows: DataFrame) -> DataFrame:
    return _shortcut(rows, "jumplist", "jumplist_reference", "access_time", "entry_name", "Jump List entry", "Recent access to ", 0.90)


#: Categories that become events, with their confidence.
AMCACHE = {"InventoryApplication": 0.80, "InventoryApplicationFile": 0.70, "InventoryApplicationShortcut": 0.60, "InventoryDriverBinary": 0.85, "InventoryDriverPackage": 0.85}


def amcache(rows: DataFrame) -> DataFrame:
    """``values`` is a map of the entry's value names."""
    of = lambda *names: C.first_truthy(*[F.col(n[1:]) if n[0] == "." else F.try_element_at("values", F.lit(n)) for n in names])
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in AMCACHE.items() for x in kv]), F.col("category"))
    name, path = of("Name", "ProgramName", "DriverName", "FileName", ".entry_name"), of("LowerCaseLongPath", "Path", "FilePath", "Directory", ".entry_path")
    when = F.coalesce("last_written", C.coerce_time(of("InstallDate", "DriverLastWriteTime")))
    extra = {"sha1": of("SHA1", "Sha1", "FileId", "ProgramId", "DriverId"), "publisher": of("Publisher", "CompanyName", "DriverCompany"), "version": of("Version", "ProductVersion", "DriverVersion"), "amcache_category": "category"}
    said = F.concat(F.lit("Amcache "), "category", F.lit(" entry: "), F.coalesce(name, path, F.lit("unknown")))
    return events(rows.where(F.col("category").isin(*AMCACHE)), "amcache", "application_inventory", "system", when, name=name, path=path, description=said, confidence=confidence, evidence={"amcache_category": "category"}, extra=extra)


def browser_history(rows: DataFrame) -> DataFrame:
    other = {n: n for n in ("visit_count", "typed_count", "last_visit_time", "transition", "visit_duration")}
    return events(rows, "browser", "url_visit", "browser", "visit_time", name="title", path="url", description=F.concat(F.lit("Visited "), "url"), evidence={"browser": "browser"}, other=other)


def browser_downloads(rows: DataFrame) -> DataFrame:
    texts, numbers = ("browser", "current_path", "referrer", "mime_type"), ("end_time", "received_bytes", "total_bytes", "state", "danger_type")
    name = F.when(C.truthy("target_path").isNotNull(), C.basename("target_path"))
    return events(rows, "browser", "file_download", "browser", "start_time", name=name, path="target_path", related=F.array("site_url", "tab_url"), description=F.concat(F.lit("Downloaded "), "target_path"), evidence={t: t for t in texts}, other={n: n for n in numbers})


# --- file system


def mft(rows: DataFrame) -> DataFrame:
    """Up to three events for a record: created, deleted, and times that disagree by over two seconds."""
    differ = lambda a, b: F.coalesce(F.abs(F.timestamp_diff("MICROSECOND", F.col(a), F.col(b))) > 2_000_000, F.lit(False))
    directory, used = F.coalesce("is_directory", F.lit(False)), F.coalesce("in_use", F.lit(False))
    kind = lambda d, f: F.when(directory, d).otherwise(f)
    option = lambda order, what, when, said: F.struct(F.lit(order).alias("ord"), what.alias("type"), when.alias("time"), F.concat(said, F.coalesce("primary_path", F.lit("None"))).alias("said"))
    made = F.when(F.col("si_created").isNotNull(), option(0, kind("directory_created", "file_creation"), F.col("si_created"), kind("Directory created: ", "File created: ")))
    gone = F.when(~used, option(1, kind("directory_deleted", "file_deletion"), F.coalesce("si_entry_modified", "fn_entry_modified"), kind("Deleted directory: ", "Deleted file: ")))
    odd = F.when(differ("si_created", "fn_created") | differ("si_modified", "fn_modified"), option(2, F.lit("timestamp_inconsistency"), F.coalesce("si_entry_modified", "fn_entry_modified", "si_modified"), F.lit("Possible timestamp manipulation detected on ")))
    rows = rows.withColumn("_e", F.explode(F.array_compact(F.array(made, gone, odd))))
    other = {n: n for n in ("file_reference", "mft_reference", "sequence_number", "allocated_size", "real_size", "usn")}
    return events(rows, "mft", F.col("_e.type"), "filesystem", F.col("_e.time"), name="filename", path="primary_path", description=F.col("_e.said"), other=other, emit=F.col("_e.ord"))


#: The journal's reasons, in order.
USN_REASONS = {
    "DATA_OVERWRITE": 0x1, "DATA_EXTEND": 0x2, "DATA_TRUNCATION": 0x4, "NAMED_DATA_OVERWRITE": 0x10, "NAMED_DATA_EXTEND": 0x20, "NAMED_DATA_TRUNCATION": 0x40,
    "FILE_CREATE": 0x100, "FILE_DELETE": 0x200, "EA_CHANGE": 0x400, "SECURITY_CHANGE": 0x800, "RENAME_OLD_NAME": 0x1000, "RENAME_NEW_NAME": 0x2000,
    "INDEXABLE_CHANGE": 0x4000, "BASIC_INFO_CHANGE": 0x8000, "HARD_LINK_CHANGE": 0x10000, "COMPRESSION_CHANGE": 0x20000, "ENCRYPTION_CHANGE": 0x40000,
    "OBJECT_ID_CHANGE": 0x80000, "REPARSE_POINT_CHANGE": 0x100000, "STREAM_CHANGE": 0x200000, "TRANSACTED_CHANGE": 0x400000, "CLOSE": 0x80000000,
}
DATA_CHANGE = 0x77


def usn(rows: DataFrame) -> DataFrame:
    has = lambda bits: F.coalesce(F.col("reason_code").cast("long").bitwiseAND(F.lit(bits).cast("long")) != 0, F.lit(False))
    low = F.lower(F.trim(F.coalesce("file_name", F.lit(""))))
    noise = (low == "") | low.isin("thumbs.db", "desktop.ini") | low.startswith("~$") | (F.coalesce(F.col("file_attributes_code").cast("long"), F.lit(0)).bitwiseAND(F.lit(16).cast("long")) != 0)
    what = lambda create, delete, rename, change: F.when(has(0x100), create).when(has(0x200), delete).when(has(0x2000), rename).when(has(DATA_CHANGE), change)
    rows = rows.where(~noise).withColumns({"_type": what("file_creation", "file_deletion", "file_renamed", "file_modification"), "_done": what("created", "deleted", "renamed", "modified")}).where("_type IS NOT NULL")
    flags = F.array_compact(F.array(*[F.when(has(bit), name) for name, bit in USN_REASONS.items()]))
    some = lambda c: F.nullif(F.col(c).cast("long"), F.lit(0).cast("long"))
    related = C.strings(F.concat(F.lit("frn:"), some("frn").cast("string")), F.concat(F.lit("parent_frn:"), some("parent_frn").cast("string")))
    extra = {"file_name": "file_name", "file_reference": "frn", "parent_reference": "parent_frn", "usn": "usn", "reason_code": "reason_code", "reason_flags": flags, "usn_version": F.concat_ws(".", "usn_version_major", "usn_version_minor"), "timestamp_semantics": F.lit("usn_record_timestamp"), "timeline_eligible": F.col("_type") != "file_modification"}
    return events(rows, "usn", F.col("_type"), "filesystem", "timestamp", name="file_name", related=related, description=F.concat(F.lit("USN Journal: file "), "_done", F.lit(": "), "file_name"), confidence=0.95, extra=extra)


# --- resource usage


def sru_route() -> Column:
    """By the columns that a record has (``has`` is the array of their names), in order of priority."""
    both = lambda a, b: F.array_contains("has", a) & F.array_contains("has", b)
    return F.when(both("BytesSent", "BytesRecvd"), "network").when(both("ForegroundCycleTime", "BackgroundCycleTime"), "resource").when(both("ConnectedTime", "ConnectStartTime"), "connectivity").when(F.array_contains("has", "Energy"), "energy")


def _sru(rows: DataFrame, event_type: str, category: str, said: str, extra: dict) -> DataFrame:
    name = F.coalesce(C.truthy("application"), F.concat(F.lit("AppId:"), F.col("application_id").cast("string")))
    common = {"application": name, "application_id": "application_id", "user_sid": "user_sid", "user_id": "user_id", "timestamp_semantics": F.lit("sru_accounting_interval")}
    return events(rows, "sru", event_type, category, "TimeStamp", name=name, path="application_path", user="user_sid", description=said, confidence=0.90, record_id="record_id", hash_record_id=False, extra=common | extra)


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long"))


def sru_network(rows: DataFrame) -> DataFrame:
    sent, received = _number("BytesSent"), _number("BytesRecvd")
    moved = rows.where(sru_route() == "network").where((sent != 0) | (received != 0))
    return _sru(moved, "application_network_usage", "network", "Application transferred network data during an SRU accounting interval", {"bytes_sent": sent, "bytes_received": received, "total_bytes": sent + received, "network_interface": "InterfaceLuid", "profile_id": "L2ProfileId"})


def sru_resource(rows: DataFrame) -> DataFrame:
    total = lambda what: _number(f"Foreground{what}") + _number(f"Background{what}")
    return _sru(rows.where(sru_route() == "resource"), "application_resource_usage", "system", "Application consumed CPU and disk resources during an SRU accounting interval", {"total_cycle_time": total("CycleTime"), "total_bytes_read": total("BytesRead"), "total_bytes_written": total("BytesWritten")})


def sru_connectivity(rows: DataFrame) -> DataFrame:
    return _sru(rows.where(sru_route() == "connectivity"), "network_connectivity", "network", "Network connectivity was recorded by SRU", {"network_interface": "InterfaceLuid", "profile_id": "L2ProfileId", "connected_time": "ConnectedTime", "connect_start_time": "ConnectStartTime"})


def sru_energy(rows: DataFrame) -> DataFrame:
    energy = F.col("Energy").try_cast("double")
    return _sru(rows.where((sru_route() == "energy") & energy.isNotNull()), "application_energy_usage", "system", "Application energy usage was recorded by SRU", {"energy": energy})


# --- defender, tasks

#: What a message says, in order, and the event type.
DEFENDER_WORDS = (
    (("service started",), "defender_service_started"),
    (("service stopped",), "defender_service_stopped"),
    (("platform version", "engine version", "security intelligence version", "antivirus version"), "defender_platform_update"),
    (("threat", "malware", "detected", "quarantine", "remediation", "removed", "blocked", "infected"), "malware_detection"),
    (("engine loaded",), "defender_engine_loaded"),
)


def defender(rows: DataFrame) -> DataFrame:
    low, component = F.lower(F.coalesce("message", F.lit(""))), F.lower(F.coalesce("component", F.lit("")))
    scan = low.contains("process scan")
    kinds = [F.when(C.any_of(low, words), kind) for words, kind in DEFENDER_WORDS]
    kinds += [F.when(scan & low.contains("started"), "defender_scan_started"), F.when(scan & C.any_of(low, ("completed", "finished")), "defender_scan_completed")]
    kinds += [F.when((component == "cloud") | C.any_of(low, ("submitreport", "rpcspynet")), "defender_cloud_request"), F.when(C.any_of(low, ("config change", "configuration", "refreshpluginconfiguration")), "defender_configuration_changed")]
    kind = F.coalesce(*kinds, F.lit("defender_information"))
    said = F.coalesce(C.truthy("message"), F.concat(F.lit("Windows Defender event ("), kind, F.lit(")")))
    return events(rows, "defender", kind, "security", "timestamp", name="component", description=said, evidence={n: n for n in ("record_type", "component", "action")})


def scheduled_tasks(rows: DataFrame) -> DataFrame:
    name, command = F.coalesce("task_name", F.lit("")), F.coalesce("command", F.lit(""))
    texts = {"author": "author", "task_description": "description", "arguments": "arguments", "working_directory": "working_directory", "run_level": "run_level"}
    said = F.concat(F.lit("Scheduled task '"), name, F.lit("' configured to run: "), command)
    return events(rows, "scheduled_task", "persistence", "persistence", "registration_date", name=name, path=command, user="user", description=said, evidence=texts, other={"enabled": "enabled", "hidden": "hidden", "triggers": F.to_json("triggers")})


#: Artifact type of a landing table to its normalizers. Callers may add their own.
NORMALIZERS = {
    "evtx": [evtx], "prefetch": [prefetch], "registry": [run_keys, services, userassist, usb_devices, recent_documents], "lnk": [lnk], "jumplist": [jumplist],
    "amcache": [amcache], "browser_history": [browser_history], "browser_download": [browser_downloads], "mft": [mft], "usn": [usn],
    "sru": [sru_network, sru_resource, sru_connectivity, sru_energy], "defender": [defender], "scheduled_task": [scheduled_tasks],
}


def normalize(landing: dict[str, DataFrame], normalizers: dict | None = None) -> DataFrame | None:
    """All events of all landing tables; tables of unknown type are left out."""
    known = NORMALIZERS if normalizers is None else normalizers
    parts = [make(rows) for name, rows in landing.items() for make in known.get(name, [])]
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def hydrate_ids(rows: DataFrame) -> DataFrame:
    """Gives an id to events that were written without one."""
    made = F.when(F.col("record_id").isNotNull(), C.event_id("artifact_type", "event_type", "timestamp", "source_file", "object_name", "object_path", F.col("record_id"))).otherwise(C.event_id("artifact_type", "event_type", "timestamp", "source_file", "object_name", "object_path"))
    return rows.withColumn("event_id", F.coalesce(C.truthy("event_id"), made))


# --- first seen wins


def _order() -> Column:
    return F.struct("ingest_seq", "emit_ord")


def _first_of_each(rows: DataFrame, keys: dict[str, Column], more: dict[str, Column], keep_keys: bool = False) -> DataFrame:
    """The first row of each key in ingest order, and aggregates over all of its rows. Partial aggregation keeps hot keys small."""
    every = F.struct(*rows.columns)
    keyed = rows.withColumns({f"_k{i}": c for i, c in enumerate(keys.values())})
    folded = keyed.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by(every, _order()).alias("_first"), *[c.alias(n) for n, c in more.items()])
    return folded.select("_first.*", *more, *([f"_k{i}" for i in range(len(keys))] if keep_keys else []))


def compact_usn(rows: DataFrame) -> DataFrame:
    """One event for each file and kind of change (renames: each destination), with counts, the last record, all flags and the first 20 numbers."""
    renamed = F.col("event_type") == "file_renamed"
    keys = {"source": F.col("source_file"), "type": F.col("event_type"), "file": F.col("file_reference"), "parent": F.when(renamed, F.col("parent_reference")), "name": F.when(renamed, F.col("file_name"))}
    # when each flag was seen first: a fixed number of small aggregates, however many records a file has
    seen = {f"_f_{name}": F.min(F.when(F.array_contains("reason_flags", name), _order())) for name in USN_REASONS}
    folded = _first_of_each(rows, keys, {"usn_record_count": F.count("*"), "_last": F.max_by(F.struct("usn", "timestamp"), _order())} | seen, keep_keys=True)
    flags = F.array_compact(F.array(*[F.when(F.col(f"_f_{name}").isNotNull(), F.struct(F.col(f"_f_{name}").alias("at"), F.lit(i).alias("bit"), F.lit(name).alias("name"))) for i, name in enumerate(USN_REASONS)]))
    key_columns = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(key_columns, keys.values(), strict=True)))
    listed = first_distinct(keyed, key_columns, F.col("usn"), F.struct(_order(), F.col("usn")), 20, "_usns")
    out, many = joined_on(folded, listed, key_columns), F.col("usn_record_count") > 1
    made = {"reason_flags": F.transform(F.array_sort(flags), lambda x: x["name"]), "last_usn": F.when(many, F.col("_last.usn")), "last_usn_timestamp": F.when(many, F.col("_last.timestamp")), "related_usns": F.when(many, F.col("_usns"))}
    return out.withColumns(made).drop("_last", "_usns", *seen, *key_columns)


#: Occurrences that a merged row lists; it counts all of them.
LISTED = 20


def merge_evidence(rows: DataFrame, keys: dict[str, Column], lists: dict[str, Column] | None = None) -> DataFrame:
    """The first row of each key, n_rows, and the evidence of the others as far as it differs: n_occurrences, and the first LISTED in ``occurrences``.

    ``lists`` are further columns of which the first LISTED different values are wanted.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, keys.values(), strict=True)) | {"_evidence": F.to_json("evidence_str")})
    out = _first_of_each(rows, keys, {"n_rows": F.count("*")}, keep_keys=True)
    different = keyed.where(F.col("_evidence").isNotNull()).select(*names, "_evidence").distinct()
    counted = different.groupBy(*names).agg(F.count("*").alias("_n"))
    found = first_distinct(keyed, names, F.col("_evidence"), _order(), LISTED + 1, "_seen")
    out = joined_on(joined_on(out, counted, names), found, names)
    for name, value in (lists or {}).items():
        out = joined_on(out, first_distinct(keyed, names, value, _order(), LISTED, name), names)
    rest = F.coalesce(F.slice("_seen", F.lit(2), F.lit(LISTED)), C.strings())
    more = F.greatest(F.coalesce("_n", F.lit(0)) - 1, F.lit(0))
    return out.withColumns({"occurrences": rest, "n_occurrences": more}).drop("_seen", "_n", *names)


def merge_usb_devices(rows: DataFrame) -> DataFrame:
    return merge_evidence(rows, {"source": F.col("source_file"), "device": F.col("device_instance_id")}).drop("n_rows")


def merge_recent_documents(rows: DataFrame) -> DataFrame:
    keys = {n: F.col(n) for n in ("source_file", "user", "document_path", "timestamp")}
    out = merge_evidence(rows, keys, {"_keys": C.truthy("registry_key")})
    return out.withColumn("related_registry_keys", F.when(F.col("n_rows") > 1, F.coalesce("_keys", C.strings()))).drop("_keys", "n_rows")
