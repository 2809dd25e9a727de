"""Queries of rules, incidents, indicators and roll-ups (G, H, I, J), and the first slice end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.operators import incidents as inc
from emberline.operators import ioc, rollups, rules, timeline
from emberline.operators.store import settled, written

from .adapters import CLUSTERS_SQL, EVT, EVTX_EVENTS_SQL, FINDING_RULES, FINDINGS_SQL, INCIDENTS_SQL, MFT, SRU_NET, TL_SQL, evt, evtx_tl, findings, iso_sql, tl, view
from .core import joined, pair

FOUND = ["correlation_id", "severity", "confidence", "start_time", "end_time"]
shown = lambda df: df.select(*FOUND, joined("event_ids").alias("event_ids"), joined("entity_ids").alias("entity_ids"))
COR_COLUMNS = "correlation_id, severity, CAST(confidence AS DOUBLE) AS confidence, start_time, end_time, array_to_string(event_ids, '|') AS event_ids, array_to_string(entity_ids, '|') AS entity_ids"


# --- G: rules
def _single(name: str, rule: str):
    pair(name, f"WITH {FINDINGS_SQL} SELECT {COR_COLUMNS} FROM cor WHERE rule_name = '{rule}'")(lambda s, d: shown(rules.OPERATORS[rule](tl(s, d))))


_single("g1_registry_persistence", "registry_persistence")
_single("g4_defender_detection", "defender_detection")
_single("g7_browser_activity", "browser_activity")
_single("g9_download_execution", "browser_download_execution")

_X = "SELECT sha256(concat_ws('|', '{rule}', event_id)) AS correlation_id, '{severity}' AS severity, {confidence} AS confidence, timestamp AS start_time, timestamp AS end_time, event_id AS event_ids, coalesce(entity_id, '') AS entity_ids FROM xtl WHERE {where}"


def _evtx(name: str, rule: str, severity: str, where: str):
    pair(name, f"WITH {EVTX_EVENTS_SQL} " + _X.format(rule=rule, severity=severity, confidence="CAST(1.0 AS DOUBLE)", where=where))(lambda s, d: shown(rules.OPERATORS[rule](evtx_tl(s, d))))


_evtx("g3_service_installation", "service_installation", "low", "event_type = 'service_install'")
_evtx("g5_log_cleared", "event_log_cleared", "high", "event_type = 'log_cleared'")
pair("g2_task_persistence", """SELECT s_suppkey AS ingest_seq, 'scheduled_task_persistence' AS rule_name, 'low' AS severity, concat('Scheduled Task persistence') AS title FROM supplier""")(lambda s, d: _task_findings(s, d).select("ingest_seq", "rule_name", "severity", "title"))


def _task_tl(s, d):
    from emberline.operators import entities, normalize

    from .core import _tasks

    return entities.with_entity(timeline.timeline(normalize.scheduled_tasks(_tasks(s, d))))


def _task_findings(s, d):
    rows = _task_tl(s, d)
    found = rules.OPERATORS["scheduled_task_persistence"](rows)
    return found.join(rows.select("tl_pos", "ingest_seq"), "tl_pos")


def _usb_tl(s, d):
    from emberline.operators import entities, normalize

    from .core import _keys

    return entities.with_entity(timeline.timeline(normalize.usb_devices(_keys(s, d))))


def _usb_sql():
    from .core import USB_SQL

    return f"WITH {USB_SQL} SELECT vendor, product, serial_number, 'low' AS severity, count(*) AS n FROM u GROUP BY ALL"


of = lambda k: F.try_element_at("evidence", F.lit(k)).alias(k)
pair("g6_usb_connection", _usb_sql())(lambda s, d: rules.OPERATORS["usb_connection"](_usb_tl(s, d)).groupBy(of("vendor"), of("product"), of("serial_number"), "severity").agg(F.count("*").alias("n")))

TEXT = "CASE event_type WHEN 'process_execution' THEN CASE WHEN lower(object_name) IN ('powershell.exe', 'powershell_ise.exe', 'pwsh.exe') THEN concat_ws(' ', nullif(command_line, ''), nullif(host_application, '')) END WHEN 'powershell_pipeline_execution' THEN command_line END"
HITS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, (p, _) in rules.INDICATORS.items()) + "], lambda x: x IS NOT NULL))"
POWERSHELL_SQL = f"""{EVTX_EVENTS_SQL}, pt AS (SELECT *, {TEXT} AS text FROM xtl), ph AS (SELECT *, {HITS} AS hits FROM pt WHERE text <> ''),
ps AS (SELECT *, CASE WHEN list_has_any(hits, ['reflective_load', 'base64_payload']) THEN 'high' WHEN list_has_any(hits, ['execution_policy_bypass', 'encoded_command', 'download_cradle', 'invoke_expression']) THEN 'medium' END AS severity, sha256(concat_ws('|', 'powershell_execution', event_id)) AS correlation_id FROM ph)"""
pair("g8_powershell", f"WITH {POWERSHELL_SQL} SELECT correlation_id, severity, CAST(0.75 AS DOUBLE) AS confidence, timestamp AS start_time, array_to_string(hits, ',') AS matched FROM ps WHERE severity IS NOT NULL")(
    lambda s, d: rules.powershell_execution(evtx_tl(s, d)).select("correlation_id", "severity", "confidence", "start_time", F.element_at("evidence", F.lit("matched_indicators")).alias("matched"))
)
pair("g10_best_identity", f"WITH {TL_SQL} SELECT event_id, string_split(lower(trim(coalesce(nullif(object_name, ''), object_path))), chr(92))[-1] AS file FROM tl")(lambda s, d: tl(s, d).select("event_id", C.best_identity("object_name", "object_path").alias("file")))


def _asof(s, d):
    orders, items = (s.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    late = items.select("l_suppkey", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    found = rules.asof_within(orders.withColumn("key", (F.col("o_custkey") % 10).cast("string")), late.withColumn("key", (F.col("l_suppkey") % 10).cast("string")), [F.col("key")], [F.col("key")], "o_orderdate", "l_shipdate", "item", 7, "o_orderkey")
    return found.select("o_orderkey", F.col("match.item").alias("item"))


pair("g11_asof_within", """SELECT o_orderkey, item FROM orders o, LATERAL (SELECT l_orderkey * 10 + l_linenumber AS item FROM lineitem WHERE l_suppkey % 10 = o.o_custkey % 10 AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 7 DAY ORDER BY l_shipdate, item LIMIT 1)""")(_asof)
pair("g12_combined_confidence", f"WITH r AS ({EVT}) SELECT ingest_seq, CAST(least(confidence, CASE WHEN k % 2 = 0 THEN 0.5 END, 1.0) AS DOUBLE) AS c FROM r")(lambda s, d: evt(s, d).select("ingest_seq", C.combined_confidence("confidence", F.when(F.col("k") % 2 == 0, F.lit(0.5))).alias("c")))
pair("g14_techniques", f"WITH {FINDINGS_SQL} SELECT correlation_id, CASE rule_name WHEN 'registry_persistence' THEN 'T1547.001' WHEN 'defender_detection' THEN 'T1562.001' WHEN 'browser_activity' THEN 'T1016' ELSE 'T1105|T1204.002' END AS techniques FROM cor")(lambda s, d: rules.with_techniques(findings(s, d)).select("correlation_id", joined("techniques").alias("techniques")))

# --- H: incidents
_SHARE = "s AS (SELECT DISTINCT rule_ord, tl_pos, unnest(list_concat(event_ids, entity_ids)) AS link FROM cor), cand AS (SELECT DISTINCT a.rule_ord AS ao, a.tl_pos AS ap, b.rule_ord AS bo, b.tl_pos AS bp FROM s a JOIN s b ON a.link = b.link AND (a.rule_ord < b.rule_ord OR (a.rule_ord = b.rule_ord AND a.tl_pos < b.tl_pos)))"
pair("h1_edge_candidates", f"WITH {FINDINGS_SQL}, {_SHARE} SELECT ao AS a_ord, ap AS a_pos, bo AS b_ord, bp AS b_pos FROM cand")(lambda s, d: inc.edge_candidates(findings(s, d)).select(*[F.col(f"{x}_ord.{c}").alias(n) for x, c, n in (("source", "rule_ord", "a_ord"), ("source", "tl_pos", "a_pos"), ("target", "rule_ord", "b_ord"), ("target", "tl_pos", "b_pos"))]))
_PROGRAMS = "list_distinct(list_filter([lower(trim(x.ev_name)), lower(trim(x.ev_executed))], lambda v: v IS NOT NULL))"
_TESTS = f"""list_has_any(a.event_ids, b.event_ids) AS t1, list_has_any(a.entity_ids, b.entity_ids) AS t2, list_has_any({_PROGRAMS.replace("x.", "a.")}, {_PROGRAMS.replace("x.", "b.")}) AS t3, coalesce(lower(a.ev_user) = lower(b.ev_user), false) AS t4, abs(epoch_us(a.start_time) - epoch_us(b.start_time)) <= 300000000 AS t5"""
pair("h2_edges", f"""WITH {FINDINGS_SQL}, {_SHARE}, t AS (SELECT a.correlation_id AS source, b.correlation_id AS target, {_TESTS} FROM cand JOIN cor a ON a.rule_ord = ao AND a.tl_pos = ap JOIN cor b ON b.rule_ord = bo AND b.tl_pos = bp)
SELECT source, target, CAST(t1::INT * 120 + t2::INT * 80 + t3::INT * 15 + t4::INT * 10 + t5::INT * 5 AS INT) AS score, array_to_string(list_filter([CASE WHEN t1 THEN 'shared_event' END, CASE WHEN t2 THEN 'shared_entity' END, CASE WHEN t3 THEN 'same_executable' END, CASE WHEN t4 THEN 'same_user' END, CASE WHEN t5 THEN 'temporal_proximity' END], lambda v: v IS NOT NULL), '|') AS criteria FROM t""")(
    lambda s, d: inc.edges(findings(s, d)).select("source", "target", "score", joined("matched_criteria").alias("criteria"))
)
pair("h3_evidence_values", f"""WITH {FINDINGS_SQL} SELECT rule_ord, tl_pos, array_to_string({_PROGRAMS.replace("x.", "")}, '|') AS programs, coalesce(lower(ev_user), '') AS users FROM cor""")(lambda s, d: findings(s, d).select("rule_ord", "tl_pos", joined(inc.evidence_values(inc.EXECUTABLE_FIELDS)).alias("programs"), joined(inc.evidence_values(inc.USER_FIELDS)).alias("users")))
pair("h4_clusters", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT correlation_id, root FROM roots")(lambda s, d: inc.clusters(findings(s, d)))


def _incidents(s, d):
    found = settled(lambda: rules.with_techniques(findings(s, d)), "findings")
    return inc.incidents(found), found


made = lambda s, d: _incidents(s, d)[0]
pair("h5_incident_id", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT incident_id, CAST(len(primary_ids) AS INT) AS n FROM incidents")(lambda s, d: made(s, d).head.select("incident_id", F.col("n_primary").cast("int").alias("n")))
pair("h6_incidents", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT incident_id, start_time, end_time, severity, CAST(confidence AS DOUBLE) AS confidence, array_to_string(event_ids, '|') AS event_ids, array_to_string(entity_ids, '|') AS entity_ids, array_to_string(rule_names, '|') AS rule_names FROM incidents")(
    lambda s, d: made(s, d).listed().select("incident_id", "start_time", "end_time", "severity", "confidence", joined("event_ids").alias("event_ids"), joined("entity_ids").alias("entity_ids"), joined("rule_names").alias("rule_names"))
)
KEPT = "confidence >= 0.55 AND len(primary_ids) >= 3 AND len(event_ids) >= 5 AND epoch_us(end_time) - epoch_us(start_time) >= 10000000 AND NOT list_has_all(['registry_persistence', 'scheduled_task_persistence', 'browser_activity', 'logon_activity', 'process_execution'], rule_names)"
_ENRICHED = f"""{INCIDENTS_SQL}, kept AS (SELECT * FROM incidents WHERE {KEPT}), prim AS (SELECT DISTINCT unnest(primary_ids) AS correlation_id FROM kept), ctx AS (SELECT * FROM last_cor WHERE rule_name IN ('registry_persistence', 'browser_activity') AND correlation_id NOT IN (SELECT correlation_id FROM prim)),
near AS (SELECT incident_id, ctx.correlation_id FROM kept JOIN ctx ON ctx.start_time >= kept.start_time - INTERVAL 10 MINUTE AND ctx.start_time <= kept.end_time + INTERVAL 10 MINUTE UNION SELECT incident_id, ctx.correlation_id FROM (SELECT incident_id, unnest(list_concat(event_ids, entity_ids)) AS l FROM kept) JOIN (SELECT correlation_id, unnest(list_concat(event_ids, entity_ids)) AS l FROM ctx) ctx USING (l))"""
pair("h7_enrich", f"WITH RECURSIVE {_ENRICHED} SELECT incident_id, CAST(count(n.correlation_id) AS INT) AS n, coalesce(sha256(string_agg(n.correlation_id, '|' ORDER BY n.correlation_id)), 'none') AS ids FROM kept LEFT JOIN near n USING (incident_id) GROUP BY incident_id")(lambda s, d: _supporting(_enriched(s, d)[0]))


def _enriched(s, d):
    incs, found = _incidents(s, d)
    return inc.enrich(inc.keep_incidents(incs), found), found


def _supporting(incs):
    ids = incs.supporting_lists(separator="|").select("incident_id", F.col("digest").alias("ids"))
    return incs.head.join(ids, "incident_id", "left").select("incident_id", F.col("n_supporting").cast("int").alias("n"), F.coalesce("ids", F.lit("none")).alias("ids"))


pair("h8_keep", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT incident_id FROM incidents WHERE {KEPT}")(lambda s, d: inc.keep_incidents(made(s, d)).head.select("incident_id"))


def _serialized(s, d):
    incs, found = _incidents(s, d)
    out = inc.serialize(incs, found)
    at = lambda p: F.get_json_object("json", p)
    return out.select("incident_id", at("$.severity").alias("severity"), at("$.start_time").alias("start_time"), at("$.primary_correlations[0].correlation_id").alias("first_id"), F.json_array_length(at("$.primary_correlations")).alias("n"))


pair("h9_serialize", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT incident_id, severity, {iso_sql('start_time')} AS start_time, primary_ids[1] AS first_id, CAST(len(primary_ids) AS INT) AS n FROM incidents")(_serialized)
pair("h10_prioritize", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT incident_id, priority_rank FROM ranked")(lambda s, d: inc.prioritize(made(s, d)).select("incident_id", "priority_rank"))
pair("h11_incident_timelines", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT incident_id, event_id, tl_pos FROM (SELECT DISTINCT incident_id, unnest(event_ids) AS event_id FROM incidents) JOIN tl USING (event_id)")(lambda s, d: inc.incident_timelines(made(s, d), tl(s, d)).select("incident_id", "event_id", "tl_pos"))


def _chain(s, d):
    incs, found = _incidents(s, d)
    stage = F.when(F.col("rule_name") == "browser_activity", "initial_access").when(F.col("rule_name") == "browser_download_execution", "execution").when(F.col("rule_name") == "registry_persistence", "persistence")
    return inc.attack_chain(incs, found.withColumn("attack_stage", stage)).select("stage", F.col("stage_order").cast("int").alias("stage_order"), "n")


pair("h12_attack_chain", f"WITH {FINDINGS_SQL} SELECT CASE rule_name WHEN 'browser_activity' THEN 'initial_access' WHEN 'browser_download_execution' THEN 'execution' ELSE 'persistence' END AS stage, CASE rule_name WHEN 'browser_activity' THEN 1 WHEN 'browser_download_execution' THEN 2 ELSE 3 END AS stage_order, count(DISTINCT correlation_id) AS n FROM cor WHERE rule_name <> 'defender_detection' GROUP BY ALL")(_chain)


def _verdicts(s, d):
    incs = _enriched(s, d)[0]
    verdict = F.when(F.substring("incident_id", 1, 1) < "4", "AGREE").when(F.substring("incident_id", 1, 1) < "c", "PARTIALLY_AGREE")
    least = incs.primary().groupBy("incident_id").agg(F.array(F.min("correlation_id")).alias("p"))
    lists = incs.head.select("incident_id").join(least, "incident_id", "left").join(incs.supporting_lists(2), "incident_id", "left")
    first = written(lists.select("incident_id", F.coalesce("p", C.strings()).alias("p"), F.coalesce("first", C.strings()).alias("promote")), "first-ids")
    given = first.select("incident_id", verdict.alias("verdict"), F.concat("p", F.array(F.lit("unheard of"))).alias("remove"), "promote").where("verdict IS NOT NULL")
    out, changes = inc.apply_verdicts(incs, given)
    count = lambda change: F.count_if(F.col("change") == change).cast("int").alias(f"n_{change}")
    joined_ = out.head.join(changes.groupBy("incident_id").agg(count("removed"), count("promoted")), "incident_id", "left")
    own = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_removed", "n_promoted")]
    return joined_.select("incident_id", "verdict", *own, *[F.col(n).cast("int").alias(n) for n in ("n_primary", "n_supporting")])


pair("h13_apply_verdicts", f"""WITH RECURSIVE {_ENRICHED}, sup AS (SELECT incident_id, CAST(count(n.correlation_id) AS INT) AS ns FROM kept LEFT JOIN near n USING (incident_id) GROUP BY incident_id),
v AS (SELECT incident_id, CAST(len(primary_ids) AS INT) AS np, ns, CASE WHEN incident_id[1] < '4' THEN 'AGREE' WHEN incident_id[1] < 'c' THEN 'PARTIALLY_AGREE' END AS verdict FROM kept JOIN sup USING (incident_id)), w AS (SELECT *, coalesce(verdict = 'PARTIALLY_AGREE', false)::INT AS p FROM v)
SELECT incident_id, verdict, p AS n_removed, CAST(p * least(ns, 2) AS INT) AS n_promoted, CAST(np - p + p * least(ns, 2) AS INT) AS n_primary, CAST(ns - p * least(ns, 2) AS INT) AS n_supporting FROM w""")(_verdicts)

ANSWERS = """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '{"verdict":"AGREE","confidence":0.5,"reasoning":"r","suggested_additions":[],"suggested_removals":["a"]}' WHEN 1 THEN '{"verdict":"MAYBE","confidence":0.5,"reasoning":"r","suggested_additions":[],"suggested_removals":[]}'
WHEN 2 THEN 'no json' WHEN 3 THEN '{"verdict":"AGREE","confidence":true,"reasoning":"r","suggested_additions":[],"suggested_removals":[]}' WHEN 4 THEN '{"verdict":"AGREE","confidence":1,"reasoning":"r","suggested_additions":[1],"suggested_removals":[]}' ELSE '{"verdict":"AGREE","confidence":1}' END AS answer FROM conversations"""
pair("h14_verdict_error", "SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 1 THEN 'unknown verdict' WHEN 2 THEN 'not an object' WHEN 3 THEN 'confidence is no number' WHEN 4 THEN 'suggested_additions is no list of texts' WHEN 5 THEN 'missing reasoning' END AS error FROM conversations")(lambda s, d: view(s, d, ANSWERS, "conversations").select("conv_id", "turn", inc.verdict_error("answer").alias("error")))

# --- I: indicators
def _with_findings(rows, name):
    """The candidates of one extractor on a timeline and the findings of all rules on it."""
    return ioc.extract(rows, rules.run_rules(rows), (name,))


pair("i1_lookups", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT correlation_id, incident_id AS incident_ids FROM (SELECT incident_id, unnest(primary_ids) AS correlation_id FROM incidents)")(lambda s, d: ioc.incident_lookup(made(s, d)).select("correlation_id", F.col("incident_id").alias("incident_ids")))
FILES_SQL = f"""{TL_SQL}, fi AS (SELECT CASE WHEN artifact_type = 'browser' AND event_type = 'file_download' THEN 'dropped_file' WHEN lower(object_path) SIMILAR TO '.*\\.(exe|dll)' THEN 'executable' ELSE 'file' END AS ioc_type, object_path AS value, tl_pos FROM tl WHERE contains(object_path, chr(92)))"""
pair("i2_files", f"WITH {FILES_SQL} SELECT ioc_type, value, tl_pos FROM fi")(lambda s, d: ioc.extract(tl(s, d), None, ("files",)).select("ioc_type", "value", F.col("cand_ord.pos").alias("tl_pos")))
pair("i3_registry", f"""WITH {TL_SQL}, r AS (SELECT * FROM tl WHERE artifact_type = 'registry') SELECT ioc_type, value, count(*) AS n FROM (SELECT 'registry_key' AS ioc_type, key_path AS value FROM r UNION ALL SELECT 'registry_value', key_path || chr(92) || object_name || ' = ' || object_path FROM r UNION ALL SELECT 'persistence_location', key_path FROM r) GROUP BY ALL""")(lambda s, d: _with_findings(tl(s, d), "registry").groupBy("ioc_type", "value").agg(F.count("*").alias("n")))
pair("i4_powershell", f"""WITH {POWERSHELL_SQL}, e AS (SELECT * FROM ps WHERE severity IS NOT NULL) SELECT ioc_type, value, severity, count(*) AS n FROM (SELECT 'command_line' AS ioc_type, command_line AS value, NULL AS severity FROM xtl UNION ALL SELECT 'powershell_script', script_name, NULL FROM xtl WHERE script_name IS NOT NULL UNION ALL SELECT 'command_line', command_line, severity FROM e UNION ALL SELECT 'powershell_script', script_name, severity FROM e WHERE script_name IS NOT NULL) GROUP BY ALL""")(
    lambda s, d: _with_findings(evtx_tl(s, d), "powershell").groupBy("ioc_type", "value", "severity").agg(F.count("*").alias("n"))
)


def _texts(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("p"), "page_id").alias("id"), F.concat("url", F.lit(" "), "html").alias("text"))
    return docs.union(pages)


NET_SQL = "t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, url || ' ' || html FROM pages), m AS (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS type, unnest(regexp_extract_all(text, '{pattern}', 0)) AS value FROM t"
    for kind, pattern in (("url", ioc.URL.replace("'", "''").replace(r"\"", '"')), ("ipv4", ioc.IPV4), ("ipv6", ioc.IPV6), ("domain", ioc.DOMAIN))
) + ")"
pair("i5_network", f"WITH {NET_SQL} SELECT type, CASE WHEN type = 'url' THEN regexp_replace(value, '[).,;''\"]+$', '') ELSE value END AS value, count(*) AS n FROM m WHERE CASE type WHEN 'domain' THEN NOT regexp_full_match(value, '{ioc.IPV4}') WHEN 'ipv6' THEN len(string_split(value, ':')) > 2 ELSE true END GROUP BY ALL")(
    lambda s, d: _texts(s, d).select(F.explode(ioc.text_indicators(F.col("text"))).alias("i")).groupBy("i.type", "i.value").agg(F.count("*").alias("n"))
)


def _referred(s, d):
    ref = F.when((F.col("k") % 3 == 0) & (F.col("artifact_type") == "browser"), F.concat(F.lit("https://r.example.com/"), F.col("k").cast("string"))).when(F.col("k") % 3 == 1, "about:blank")
    return tl(s, d).withColumn("evidence_str", C.text_map({"referrer": ref}))


pair("i6_browser", f"""WITH {TL_SQL}, b AS (SELECT * FROM tl WHERE artifact_type = 'browser'), c AS (SELECT 'url' AS ioc_type, object_path AS value FROM b WHERE event_type = 'url_visit' UNION ALL SELECT 'dropped_file', object_path FROM b WHERE event_type = 'file_download' UNION ALL SELECT 'url', 'https://r.example.com/' || k FROM b WHERE event_type = 'file_download' AND k % 3 = 0) SELECT ioc_type, value, count(*) AS n FROM c GROUP BY ALL""")(lambda s, d: ioc.extract(_referred(s, d), None, ("browser",)).groupBy("ioc_type", "value").agg(F.count("*").alias("n")))
pair("i7_services", f"WITH {FINDINGS_SQL}, e AS (SELECT event_ids[1] AS event_id, correlation_id FROM cor WHERE rule_name = 'registry_persistence'), l AS (SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tl_pos DESC) = 1) SELECT 'service' AS ioc_type, l.object_name AS value, e.correlation_id, 'low' AS severity FROM e JOIN l USING (event_id)")(lambda s, d: _with_findings(tl(s, d), "services").select("ioc_type", "value", F.get("correlation_ids", F.lit(0)).alias("correlation_id"), "severity"))
pair("i8_tasks", "SELECT 'scheduled_task' AS ioc_type, s_name AS value, 'low' AS severity FROM supplier UNION ALL SELECT 'command_line', 'run ' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 3 <> 0")(lambda s, d: _with_findings(_task_tl(s, d), "tasks").select("ioc_type", "value", "severity"))


def _hashed(s, d):
    digest = F.when(F.col("k") % 4 == 0, F.sha2(F.col("k").cast("string"), 256)).when(F.col("k") % 4 == 1, F.concat(F.lit(" "), F.sha1(F.col("k").cast("string")), F.lit(" "))).when(F.col("k") % 4 == 2, F.md5(F.col("k").cast("string"))).otherwise("abc")
    return tl(s, d).withColumns({"evidence_str": F.create_map(F.lit("h"), digest), "sha1": F.when(F.col("k") % 5 == 0, F.sha1(F.lit("x")))})


pair("i9_hashes", f"""WITH {TL_SQL}, h AS (SELECT CASE k % 4 WHEN 0 THEN 'hash_sha256' WHEN 1 THEN 'hash_sha1' WHEN 2 THEN 'hash_md5' END AS ioc_type, CASE k % 4 WHEN 0 THEN sha256(k::VARCHAR) WHEN 1 THEN sha1(k::VARCHAR) WHEN 2 THEN md5(k::VARCHAR) END AS value FROM tl WHERE k % 4 <> 3 UNION ALL SELECT 'hash_sha1', sha1('x') FROM tl WHERE k % 5 = 0) SELECT ioc_type, value, count(*) AS n FROM h GROUP BY ALL""")(lambda s, d: ioc.extract(_hashed(s, d), None, ("hashes",)).groupBy("ioc_type", "value").agg(F.count("*").alias("n")))
def _candidates(s, d):
    incs, found = _incidents(s, d)
    member = inc.members(incs, found).withColumn("member_ord", F.struct(F.lit(0).alias("kind"), F.col("correlation_id").alias("id")))
    return ioc.candidates(inc.prioritize(incs), member)


C_SQL = f"""{INCIDENTS_SQL}, mem AS (SELECT incident_id, priority_rank, unnest(primary_ids) AS correlation_id FROM ranked), fields AS (SELECT m.*, unnest([{{'f': 'key_path', 'k': 'registry_key', 'v': c.ev_key}}, {{'f': 'object_name', 'k': 'process_name', 'v': c.ev_name}}, {{'f': 'user', 'k': 'username', 'v': c.ev_user}}, {{'f': 'executed_name', 'k': 'process_name', 'v': c.ev_executed}}]) AS x FROM mem m JOIN last_cor c USING (correlation_id)),
cc AS (SELECT x.k AS kind, lower(x.v) AS key, arg_min(x.v, (priority_rank, correlation_id, x.f)) AS value, count(*) AS occurrences, min((priority_rank, correlation_id, x.f)) AS first_ord FROM fields WHERE x.v IS NOT NULL AND length(x.v) >= 3 GROUP BY 1, 2)"""
pair("i14_candidates", f"WITH RECURSIVE {C_SQL} SELECT kind, key, value, occurrences FROM cc")(lambda s, d: _candidates(s, d).select("kind", "key", "value", "occurrences"))
NOISE = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('C:', chr(92), 'Windows', chr(92), 'System32', chr(92), p_name) WHEN 1 THEN 'EventLog' WHEN 2 THEN concat('HKLM', chr(92), 'Services', chr(92), 'KSecPkg', chr(92), p_size) WHEN 3 THEN p_name ELSE p_brand END AS value, CASE p_partkey % 2 WHEN 0 THEN 'registry_key' ELSE 'service_name' END AS kind FROM part"
pair("i15_noise", "SELECT p_partkey, p_partkey % 6 IN (0, 1, 2) AS noise FROM part")(lambda s, d: view(s, d, NOISE, "part").select("p_partkey", ioc.is_noise(F.col("kind"), F.col("value")).alias("noise")))
pair("i16_batches", f"WITH RECURSIVE {C_SQL} SELECT kind, key, row_number() OVER (ORDER BY first_ord, kind, key) AS cand_pos, CAST(floor((row_number() OVER (ORDER BY first_ord, kind, key) - 1) / 100) AS BIGINT) AS batch FROM cc")(lambda s, d: ioc.batched(_candidates(s, d), 100).select("kind", "key", "cand_pos", "batch"))

REPLIES = """SELECT conv_id * 100 + turn AS batch, concat(CASE turn % 4 WHEN 1 THEN concat('```json', chr(10)) WHEN 2 THEN 'Here it is: ' ELSE '' END, '{"iocs": [{"type": "', CASE conv_id % 4 WHEN 0 THEN 'IP' WHEN 1 THEN 'hash-md5' WHEN 2 THEN 'odd thing' ELSE 'file path' END, '", "value": "V', conv_id % 10, '", "confidence": "', CASE turn % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' ELSE 'sure' END, '", "source": "s", "reason": "r', turn, '"}, {"type": "url", "value": "http://x', turn, '"', CASE turn % 4 WHEN 3 THEN '},]' ELSE '}, {"type": "url"}]' END, '}', CASE turn % 4 WHEN 1 THEN concat(chr(10), '```') ELSE '' END) AS text FROM conversations"""
R_SQL = """r0 AS (SELECT DISTINCT conv_id * 100 + turn AS batch, conv_id, turn FROM conversations), r1 AS (SELECT batch, 0 AS entry, CASE conv_id % 4 WHEN 0 THEN 'ip_address' WHEN 1 THEN 'hash_md5' WHEN 2 THEN 'other' ELSE 'file_path' END AS type, 'V' || conv_id % 10 AS value, CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
CASE conv_id % 4 WHEN 0 THEN '[reported type: IP] r' || turn WHEN 2 THEN '[reported type: odd thing] r' || turn ELSE 'r' || turn END AS reason FROM r0 UNION ALL SELECT batch, 1, 'url', 'http://x' || turn, 'low', '' FROM r0)"""
replies = lambda s, d: view(s, d, REPLIES, "conversations").distinct()
pair("i17_parse_responses", f"WITH {R_SQL} SELECT batch, count(*) AS n FROM r1 GROUP BY 1")(lambda s, d: ioc.model_iocs(replies(s, d)).groupBy("batch").agg(F.count("*").alias("n")))
pair("i18_coerce_types", f"WITH {R_SQL} SELECT batch, entry, type, confidence, reason FROM r1")(lambda s, d: ioc.model_iocs(replies(s, d)).select("batch", "entry", "type", "confidence", "reason"))
pair("i19_dedup", f"WITH {R_SQL} SELECT type, lower(value) AS key, arg_max(value, (batch, entry)) AS value, arg_max(confidence, (batch, entry)) AS confidence, min(batch) AS first_batch FROM r1 GROUP BY 1, 2")(lambda s, d: ioc.dedup_model_iocs(ioc.model_iocs(replies(s, d))).select("type", "key", "value", "confidence", F.col("place.batch").alias("first_batch")))
pair("i20_high_confidence", f"WITH {R_SQL} SELECT count(*) FILTER (confidence = 'high') AS n FROM r1")(lambda s, d: ioc.high_confidence(ioc.model_iocs(replies(s, d))))

# --- J: roll-ups
ranked = lambda s, d: inc.prioritize(made(s, d))
pair("j1_tiers_narrow", f"WITH RECURSIVE {INCIDENTS_SQL}, n AS (SELECT *, severity = 'low' AND len(primary_ids) <= 1 AND len(rule_names) <= 1 AS noise FROM ranked) SELECT incident_id, CASE WHEN noise THEN 'noise' WHEN row_number() OVER (PARTITION BY noise ORDER BY priority_rank) <= 25 THEN 'detailed' ELSE 'summarized' END AS tier FROM n")(lambda s, d: rollups.tiers(ranked(s, d), rollups.noise_narrow(), 25).select("incident_id", "tier"))
pair("j2_tiers_wide", f"WITH RECURSIVE {INCIDENTS_SQL}, n AS (SELECT *, severity = 'low' AND (len(primary_ids) <= 2 OR list_has_all(['registry_persistence', 'browser_activity'], rule_names)) AS noise FROM ranked) SELECT incident_id, CASE WHEN noise THEN 'noise' WHEN row_number() OVER (PARTITION BY noise ORDER BY priority_rank) <= 40 THEN 'detailed' ELSE 'summarized' END AS tier FROM n")(lambda s, d: rollups.tiers(ranked(s, d), rollups.noise_wide(), 40).select("incident_id", "tier"))
pair("j3_overview", f"""WITH RECURSIVE {INCIDENTS_SQL} SELECT 'total' AS section, 'events' AS key, count(*)::VARCHAR AS value FROM tl UNION ALL SELECT 'span', 'first', {iso_sql('min(timestamp)')} FROM tl UNION ALL SELECT 'span', 'last', {iso_sql('max(timestamp)')} FROM tl UNION ALL SELECT 'total', 'incidents', count(*)::VARCHAR FROM incidents
UNION ALL SELECT 'severity', severity, count(*)::VARCHAR FROM incidents GROUP BY severity UNION ALL SELECT 'rule', r, count(*)::VARCHAR FROM (SELECT unnest(rule_names) AS r FROM incidents) GROUP BY r""")(lambda s, d: _overview(s, d))
def _overview(s, d):
    rows = tl(s, d)
    return rollups.overview(inc.incidents(rules.run_rules(rows, FINDING_RULES)).head, rows)


pair("j4_timeline_digest", f"WITH {TL_SQL} SELECT artifact_type, event_type, count(*) AS n FROM tl GROUP BY ALL")(lambda s, d: rollups.counts_by_type(tl(s, d)))
pair("j5_noise_by_rule", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT r AS rule_name, count(*) AS n FROM (SELECT unnest(rule_names) AS r FROM incidents WHERE severity = 'low' AND len(primary_ids) <= 1) GROUP BY r")(lambda s, d: rollups.by_rule(made(s, d).head.where(rollups.noise_narrow())))
pair("j6_incident_index", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT incident_id[1:12] AS short_id, severity, CAST(confidence AS DOUBLE) AS confidence, CAST(len(primary_ids) AS INT) AS n_findings, CAST(len(event_ids) AS INT) AS n_events, array_to_string(rule_names, ', ') AS rules, {iso_sql('start_time')} AS start_time, {iso_sql('end_time')} AS end_time FROM incidents")(lambda s, d: _index(s, d))
def _index(s, d):
    return rollups.incident_index(made(s, d).head).withColumns({n: F.col(n).cast("int") for n in ("n_findings", "n_events")})


pair("j7_detailed_order", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT severity, CAST(confidence AS DOUBLE) AS confidence, CAST(len(primary_ids) AS INT) AS n FROM incidents ORDER BY list_position(['low', 'medium', 'high', 'critical'], severity) DESC, confidence DESC, n DESC")(lambda s, d: made(s, d).head.orderBy(*rollups.detailed_order()).select("severity", "confidence", F.col("n_primary").cast("int").alias("n")))
J8 = "SELECT doc_id, concat('x ', CASE WHEN doc_id % 2 = 0 THEN repeat('QUJD', 25) ELSE '' END, ' y ', text) AS value FROM documents"
pair("j8_compact_evidence", f"WITH d AS ({J8}), c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(value, repeat('QUJD', 25), '<base64:100 chars omitted>') ELSE value END AS v FROM d) SELECT doc_id, CASE WHEN length(v) <= 500 THEN v ELSE v[1:500] || '... <' || (length(v) - 500) || ' more chars truncated>' END AS value FROM c")(lambda s, d: view(s, d, J8, "documents").select("doc_id", F.create_map(F.lit("v"), F.col("value")).alias("e")).select("doc_id", F.element_at(rollups.compact_evidence("e"), F.lit("v")).alias("value")))
pair("j9_important_evidence", f"WITH {TL_SQL} SELECT event_id, tl_pos, 'registry_key=' || key_path AS kept FROM tl")(lambda s, d: tl(s, d).select("event_id", "tl_pos", F.create_map(F.lit("registry_key"), F.col("key_path"), F.lit("hive"), F.lit("x")).alias("e")).select("event_id", "tl_pos", F.array_join(F.transform(F.map_entries(rollups.important_evidence("e")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("kept")))
_TECH = "CASE r WHEN 'registry_persistence' THEN ['T1547.001'] WHEN 'defender_detection' THEN ['T1562.001'] WHEN 'browser_activity' THEN ['T1016'] ELSE ['T1105', 'T1204.002'] END"
pair("j10_techniques", f"WITH RECURSIVE {INCIDENTS_SQL} SELECT incident_id, array_to_string(list_sort(list_distinct(flatten(list_transform(rule_names, lambda r: {_TECH})))), '|') AS techniques FROM incidents")(lambda s, d: rollups.techniques_per_incident(*_incidents(s, d)).select("incident_id", joined("techniques").alias("techniques")))
pair("j11_findings_per_rule", f"WITH {FINDINGS_SQL} SELECT rule_name, count(*) AS n FROM cor GROUP BY 1")(lambda s, d: rollups.findings_per_rule(findings(s, d)))
pair("j12_powershell_commands", f"WITH {EVTX_EVENTS_SQL} SELECT event_id, timestamp, object_name, command_line FROM xtl WHERE event_type = 'process_execution' AND command_line <> ''")(lambda s, d: rollups.powershell_commands(evtx_tl(s, d)))
pair("j13_sru_summary", f"{SRU_NET} SELECT application, 'S-' || user_id AS user_sid, CAST(app % 3 AS INT) AS network_interface, CAST(sum(sent) AS BIGINT) AS uploaded, CAST(sum(received) AS BIGINT) AS downloaded, count(*) AS samples FROM n WHERE sent <> 0 OR received <> 0 GROUP BY 1, 2, 3")(lambda s, d: _sru_summary(s, d))


def _sru_summary(s, d):
    from emberline.operators import normalize

    from .core import _sru

    return rollups.sru_network_summary(normalize.sru_network(_sru(s, d, "network"))).drop("profile_id")


pair("j14_mft_totals", f"WITH m AS ({MFT}) SELECT count(*) FILTER (is_file) AS files, count(*) FILTER (is_directory) AS directories, count(*) FILTER (NOT in_use) AS deleted FROM m")(lambda s, d: rollups.mft_totals(view(s, d, MFT, "orders")))


def slice1(s, d):
    """From event-log records to ranked incidents of suspicious PowerShell."""
    found = rules.powershell_execution(evtx_tl(s, d))
    alone = found.select("correlation_id", F.col("correlation_id").alias("root")).distinct()
    return inc.prioritize(inc.incidents(found, alone)).select("incident_id", "priority_rank", "severity", "confidence", "start_time")


pair("slice1_ranked_powershell", f"WITH {POWERSHELL_SQL}, i AS (SELECT sha256(correlation_id) AS incident_id, severity, timestamp AS start_time FROM ps WHERE severity IS NOT NULL) SELECT incident_id, row_number() OVER (ORDER BY severity = 'high' DESC, incident_id) AS priority_rank, severity, CAST(0.75 AS DOUBLE) AS confidence, start_time FROM i")(slice1)
