"""Golden rows of the operators, worked out by hand, and plain-Python models of those that depend on order."""

import datetime as dt
import hashlib
import random

import pytest
from emberline.functions import columns as C
from emberline.operators import entities, graph, incidents, ioc, normalize, rollups, rules, timeline
from emberline.sources import files, records
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 1, 12, 0, 0)


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_event_ids_equal_the_plain_digest(spark):
    rows = [(NOW, "n", "p", None), (NOW.replace(microsecond=5), "ü", None, "7"), (None, None, None, None)]
    df = one(spark, "t timestamp_ntz, n string, p string, r string", *rows)
    with_record = C.event_id(F.lit("a"), F.lit("b"), "t", F.lit("s"), "n", "p", F.col("r"))
    got = [r[0] for r in df.select(F.when(F.col("r").isNull(), C.event_id(F.lit("a"), F.lit("b"), "t", F.lit("s"), "n", "p")).otherwise(with_record)).collect()]
    want = [hashlib.sha256("|".join(["a", "b", t.isoformat() if t else "", "s", n or "", p or "", *([r] if r else [])]).encode()).hexdigest() for t, n, p, r in rows]
    assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-01-01T00:00:00.9255319Z", dt.datetime(2024, 1, 1, 0, 0, 0, 925531)), ("2024-01-01 10:00:00", dt.datetime(2024, 1, 1, 10)), ("2024-01-01T10:00:00+02:00", dt.datetime(2024, 1, 1, 8)), ("2024-01-01", dt.datetime(2024, 1, 1)), ("soon", None), (None, None)],
)
def test_times(spark, text, want):
    assert one(spark, "s string", (text,)).select(C.coerce_time("s")).first()[0] == want


def test_times_of_other_epochs(spark):
    row = one(spark, "z long", (0,)).select(C.chrome_time("z"), C.unix_time("z"), C.ole_time(F.lit(25569.5)), C.filetime(F.lit(116444736000000019))).first()
    assert list(row) == [None, dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 1, 12), dt.datetime(1970, 1, 1, 0, 0, 0, 1)]


def usn_row(**more):
    base = {"ingest_seq": 1, "usn": 1, "timestamp": NOW, "source_path": "J", "frn": 123, "parent_frn": 5, "reason_code": 0x100, "file_name": "malware.exe", "file_attributes_code": 32, "usn_version_major": 2, "usn_version_minor": 0}
    return tuple((base | more).values())


USN = "ingest_seq long, usn long, timestamp timestamp_ntz, source_path string, frn long, parent_frn long, reason_code long, file_name string, file_attributes_code int, usn_version_major int, usn_version_minor int"


def test_journal(spark):
    rows = [usn_row(ingest_seq=i, reason_code=r, **m) for i, (r, m) in enumerate([(0x100, {}), (0x200, {}), (0x2000, {}), (1, {}), (0x8000, {}), (0x100, {"file_name": "~$Report.docx"}), (0x100, {"file_attributes_code": 16}), (0x100, {"file_name": " "})])]
    got = normalize.usn(one(spark, USN, *rows)).orderBy("ingest_seq").select("event_type", "timeline_eligible").collect()
    assert [tuple(r) for r in got] == [("file_creation", True), ("file_deletion", True), ("file_renamed", True), ("file_modification", False)]


def test_journal_burst_becomes_one_event(spark):
    rows = [usn_row(ingest_seq=i, usn=10 + i, reason_code=r, timestamp=NOW + dt.timedelta(seconds=i)) for i, r in enumerate((1, 2, 4))]
    r = normalize.compact_usn(normalize.usn(one(spark, USN, *rows).repartition(3))).collect()
    assert len(r) == 1 and r[0].usn_record_count == 3 and r[0].last_usn == 12 and r[0].usn == 10
    assert r[0].reason_flags == ["DATA_OVERWRITE", "DATA_EXTEND", "DATA_TRUNCATION"] and r[0].related_usns == [10, 11, 12]
    assert timeline.timeline(normalize.usn(one(spark, USN, *rows))).count() == 0


KEY = "ingest_seq long, hive string, user string, source_path string, key_path string, key_name string, last_written timestamp_ntz, values array<struct<name: string, type: string, value_data: string, value_bytes: binary>>"


def key(path, values, hive="NTUSER.DAT"):
    return (1, hive, "bob", "H", path, "k", NOW, values)


def utf16(text):
    return bytearray(text.encode("utf-16-le"))


def test_recent_documents(spark):
    values = [("MRUListEx", "REG_BINARY", None, bytearray()), ("0", "REG_BINARY", None, utf16("Firefox Installer.exe\0metadata\0")), ("1", "REG_BINARY", None, utf16("desktop.ini\0")), ("2", "REG_BINARY", utf16("x\0C:\\d\\full.txt\0~$full.txt\0").hex(), None)]
    df = one(spark, KEY, key(r"Software\Explorer\RecentDocs", values), key(r"Software\Explorer\RecentDocs", [("ViewStream", "REG_BINARY", None, bytearray(b"a"))], "SOFTWARE"))
    got = normalize.recent_documents(df).orderBy("emit_ord").collect()
    assert [(r.document_path, r.user) for r in got] == [("Firefox Installer.exe", "bob"), (r"C:\d\full.txt", "bob")]


def test_usb_devices(spark):
    good = r"SYSTEM\Enum\USBSTOR\Disk&Ven_SanDisk&Prod_Ultra_X&Rev_1.00\4C53"
    df = one(spark, KEY, key(good, [("FriendlyName", "REG_SZ", "SanDisk Ultra\0", None)]), key(r"SYSTEM\Control\USBSTOR\a\b", []), key(good + r"\deeper", []))
    r = normalize.usb_devices(df).collect()
    assert len(r) == 1 and (r[0].vendor, r[0].product, r[0].revision, r[0].serial_number, r[0].object_name) == ("SanDisk", "Ultra X", "1.00", "4C53", "SanDisk Ultra")


def events(spark, rows):
    """(seq, seconds, artifact, type, name, path)"""
    df = one(spark, "ingest_seq long, s long, artifact_type string, event_type string, object_name string, object_path string", *rows)
    full = df.withColumns({"timestamp": F.timestamp_add("SECOND", F.col("s"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")), "category": F.lit("c"), "evidence_str": F.create_map(F.lit("k"), F.lit("v")), "emit_ord": F.lit(0), "confidence": F.lit(1.0), "event_id": F.concat(F.lit("e"), "ingest_seq"), "user": F.lit("u"), "description": F.lit("d")})
    return entities.with_entity(timeline.timeline(full))


def test_download_window_edges(spark):
    week = 7 * 86400
    rows = [(1, 0, "browser", "file_download", None, r"C:\d\a.exe"), (2, week, "prefetch", "process_execution", "A.EXE", None), (3, 0, "browser", "file_download", None, r"C:\d\b.exe"), (4, week + 1, "prefetch", "process_execution", "b.exe", None), (5, 10, "browser", "file_download", None, r"C:\d\c.exe"), (6, 5, "prefetch", "process_execution", "c.exe", None), (7, 10, "prefetch", "process_execution", "c.exe", None), (8, 10, "prefetch", "process_execution", "C.exe", None)]
    got = {tuple(r.event_ids) for r in rules.download_execution(events(spark, rows)).collect()}
    assert got == {("e1", "e2"), ("e5", "e8")}  # of equal times the first in the timeline: C.exe sorts before c.exe


@pytest.mark.parametrize(("text", "want"), [("powershell -ep bypass", "medium"), ("x -EncodedCommand QQ==", "medium"), ("-w hidden -WindowStyle Hidden", None), ("[Reflection.Assembly]::Load(1)", "high"), ("ls", None), ("iex", "medium"), ("hexiexa", None)])
def test_powershell_severity(spark, text, want):
    df = events(spark, [(1, 0, "evtx", "powershell_pipeline_execution", None, None)]).withColumns({"command_line": F.lit(text), "script_name": F.lit(None).cast("string"), "host_application": F.lit("powershell -enc QQ")})
    got = [r.severity for r in rules.powershell_execution(df).collect()]
    assert got == ([want] if want else [])


def plain_entity(seen):
    """Name, path and aliases as a step-by-step run gives them: a first path takes over, later ones are aliases."""
    name, path, aliases = None, None, set()
    for n, p in seen:
        if path is None:
            name, path = n, p
            continue
        aliases |= {x for x, own in ((n, name), (p, path)) if x is not None and x != own}
    return name, path, sorted(aliases)


def test_entities_equal_the_plain_model(spark):
    rng, rows, seen = random.Random(2), [], {}
    for i in range(400):
        e, n, p = rng.randrange(40), rng.choice(["a", "b", "c"]), rng.choice([None, None, "p", "q"])
        rows.append((i, f"id{e}", n, p))
        seen.setdefault(f"id{e}", []).append((n, p))
    df = one(spark, "tl_pos long, entity_id string, object_name string, object_path string", *rows).repartition(5)
    for r in entities.entities(df).collect():
        assert (r.name, r.path, r.aliases) == plain_entity(seen[r.entity_id])


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in graph.components(one(spark, "a string, b string", *edges)).collect()}
    assert got == {n: find(n) for n in root}


def test_several_keys(spark):
    k = "identity_keys array<struct<kind: string, value: string, entity_type: string, strength: int>>"
    rows = [("a", [("h", "1", "file", 3), ("p", "x", "file", 1)]), ("b", [("h", "1", "file", 3), ("r", "9", "file", 2)]), ("c", [("r", "9", "file", 2)]), ("d", [("p", "x", "file", 1)]), ("e", [("p", "alone", "file", 1)]), ("f", [])]
    got = {r.event_id: r.entity_id for r in entities.resolve(one(spark, f"event_id string, {k}", *rows)).collect()}
    assert got["a"] == got["b"] == got["c"] == got["d"] == hashlib.sha256(b"h|file|1").hexdigest()
    assert got["e"] not in (got["a"], None) and "f" not in got


def finding(i, ids, start=0, rule="browser_activity", severity="low", confidence=1.0):
    t = NOW + dt.timedelta(seconds=start)
    return (f"c{i}", rule, "t", severity, confidence, t, t, ids, [], "d", {"object_name": "X.exe "}, 6, i)


FINDING = "correlation_id string, rule_name string, title string, severity string, confidence double, start_time timestamp_ntz, end_time timestamp_ntz, event_ids array<string>, entity_ids array<string>, description string, evidence map<string, string>, rule_ord int, tl_pos long"


def test_edges_and_incidents(spark):
    df = one(spark, FINDING, finding(1, ["e1"]), finding(2, ["e1", "e2"], 300), finding(3, ["e2"], 601, severity="high", confidence=0.5), finding(4, ["e9"]), finding(4, ["e9"], 5))
    edges = {(r.source, r.target): (r.score, r.matched_criteria) for r in incidents.edges(df).collect()}
    assert edges[("c1", "c2")] == (140, ["shared_event", "same_executable", "temporal_proximity"])
    assert edges[("c2", "c3")] == (135, ["shared_event", "same_executable"]) and ("c1", "c3") not in edges
    made = {tuple(r.primary_correlation_ids): r for r in incidents.incidents(df).listed().collect()}
    big = made[("c1", "c2", "c3")]
    assert (big.severity, big.confidence, big.event_ids) == ("high", 0.5, ["e1", "e2"]) and big.incident_id == hashlib.sha256(b"c1|c2|c3").hexdigest()
    ranked = [r.priority_rank for r in incidents.prioritize(incidents.incidents(df)).orderBy("priority_rank").collect()]
    assert ranked == [1, 2]


@pytest.mark.parametrize(("confidence", "n", "m", "seconds", "rules_", "kept"), [(0.55, 3, 5, 10, ["x"], True), (0.5499, 3, 5, 10, ["x"], False), (0.9, 2, 5, 10, ["x"], False), (0.9, 3, 4, 10, ["x"], False), (0.9, 3, 5, 9, ["x"], False), (0.9, 3, 5, 10, ["browser_activity"], False), (0.9, 3, 5, 10, [], False)])
def test_filter_edges(spark, confidence, n, m, seconds, rules_, kept):
    row = ("i", confidence, n, m, rules_, NOW, NOW + dt.timedelta(seconds=seconds))
    head = one(spark, "incident_id string, confidence double, n_primary long, n_events long, rule_names array<string>, start_time timestamp_ntz, end_time timestamp_ntz", row)
    links = one(spark, "incident_id string, correlation_id string, supporting boolean", ("i", "c", False), ("j", "d", False))
    ids = one(spark, "incident_id string, id string, n long", ("i", "e", 1), ("j", "f", 1))
    left = incidents.keep_incidents(incidents.Incidents(head, links, ids, ids))
    assert {t.count() for t in (left.head, left.correlations, left.events, left.entities)} == {int(kept)}


def test_candidate_texts(spark):
    df = one(spark, "kind string, v string", ("command_line", "run " + "A" * 200), ("command_line", "A" * 199), ("filename", " a\0b" + "x" * 1001), ("command_line", "z " * 450))
    got = [r[0] for r in df.select(ioc.clean_candidate(F.col("kind"), F.col("v"))).collect()]
    assert got[0] == "run <BASE64_PAYLOAD>" and got[1] == "A" * 199
    assert got[2].startswith("abx") and got[2].endswith(" ...<TRUNCATED>") and len(got[2]) == 1015 and len(got[3]) == 815


def test_answers_with_repairs(spark):
    good = '{"iocs": [{"type": "IP", "value": " 1.2.3.4 ", "confidence": "HIGH"}, {"type": "url"}, 5]}'
    texts = [good, f"```json\n{good}\n```", f"Sure: {good} done", good.replace("]}", ",]}"), "nothing", '{"other": []}', None]
    rows = ioc.model_iocs(one(spark, "batch long, text string", *enumerate(texts))).collect()
    assert sorted(r.batch for r in rows) == [0, 1, 2, 3]
    assert {(r.type, r.value, r.confidence, r.reason) for r in rows} == {("ip_address", "1.2.3.4", "high", "[reported type: IP]")}


def test_indicator_merge(spark):
    t = "ioc_type string, value string, source_artifact string, first_seen timestamp_ntz, last_seen timestamp_ntz, confidence double, event_ids array<string>, correlation_ids array<string>, snippet string, severity string, cand_ord long"
    rows = [("url", v, "s", NOW, NOW, 0.5 + i / 10, [f"e{i}"], [], f"s{i % 6}", None if i == 0 else "low", i) for i, v in enumerate(("HTTP://A ", "http://a", " http://A", "http://b", " ", "http://a", "http://a", "http://a"))]
    got = {r.key: r for r in ioc.merge(one(spark, t, *rows)).head.collect()}
    a = got["http://a"]
    assert set(got) == {"http://a", "http://b"} and a.value == "HTTP://A " and a.occurrences == 6 and a.severity == "low" and a.snippets == ["s0", "s1", "s2", "s5"]


def test_rejects_in_order(spark):
    rows = [(None, "e", "c", {"a": "b"}, NOW, "x"), ("a", "", "c", {"a": "b"}, NOW, "x"), ("a", "e", None, {"a": "b"}, NOW, "x"), ("a", "e", "c", None, NOW, "x"), ("a", "e", "c", {}, None, ""), ("a", "e", "c", {}, None, "bad"), ("a", "e", "c", {}, NOW, "x")]
    schema = "artifact_type string, event_type string, category string, evidence_str map<string, string>, timestamp timestamp_ntz, raw string"
    got = [r[0] for r in one(spark, schema, *rows).select(timeline.reject_reason("raw")).collect()]
    assert got == ["missing_artifact_type", "missing_event_type", "missing_category", "evidence_not_a_dict", "missing_timestamp", "invalid_timestamp", None]


def test_timeline_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5) * 86400 + rng.randrange(3), rng.choice("ab"), "t", rng.choice([None, "n"]), None) for i in range(300)]
    df = events(spark, rows)
    again = events(spark, rows[::-1])
    pos = lambda d: [(r.event_id, r.tl_pos) for r in d.orderBy("tl_pos").select("event_id", "tl_pos").collect()]
    assert pos(df) == pos(again) and [p for _, p in pos(df)] == list(range(300))


def test_manifest_and_defender_logs(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "MPLog-1.log").write_bytes("2024-01-02T03:04:05.6Z [Cloud] Threat found: x\r\nno time\r\n".encode("utf-16-le"))
    assert [r.size for r in files.manifest(spark, str(tmp_path)).collect()] == [(tmp_path / "x" / "MPLog-1.log").stat().st_size]
    r = records.read_defender_logs(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].component, r[0].message, r[0].action) == ("Cloud", "Threat found: x", "Threat found")


def test_values_are_cut(spark):
    df = one(spark, "v string", ("A" * 80 + "==",), ("b" + " c" * 300,))
    got = [r[0] for r in df.select(rollups.compact_value(F.col("v"))).collect()]
    assert got[0] == "<base64:82 chars omitted>" and got[1].endswith("... <101 more chars truncated>")


def test_plans_have_no_cartesian_product(spark):
    rows = [(i, i, "browser", "file_download", None, rf"C:\d\{i}.exe") for i in range(20)]
    plan = rules.download_execution(events(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_landings_of_json_and_csv(spark, tmp_path):
    schema = "record_id long, provider string, timestamp timestamp_ntz"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"record_id": 1, "provider": "P", "timestamp": "2024-01-01T00:00:00.5"}\n{"record_id": "x", "provider": 5}\nnot json\n')
    got = records.read_landing(spark, str(tmp_path / "j"), schema).collect()
    assert [tuple(r) for r in got] == [(1, "P", dt.datetime(2024, 1, 1, 0, 0, 0, 500000)), (None, "5", None), (None, None, None)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text('1,"a, ""b""",2024-01-01 00:00:00\nx,,\n2\n')
    got = records.read_landing(spark, str(tmp_path / "c"), schema, "csv").collect()
    assert [tuple(r) for r in got] == [(1, 'a, "b"', dt.datetime(2024, 1, 1)), (None, None, None), (2, None, None)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.csv").write_text("record_id,provider,timestamp\n3,x,2024-01-01\n")
    assert [r.record_id for r in records.read_landing(spark, str(tmp_path / "h"), schema, "csv", header=True).collect()] == [3]
