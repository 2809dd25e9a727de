"""Ranks, running values, digests, windows and merges that are spread over tasks, against plain Python."""

import datetime as dt
import hashlib
import random

import pytest
from emberline.operators import digests, entities, incidents, ioc, normalize, rules, scan, tops
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables would be put into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def parts_of(df):
    return df.select("part").distinct().count()


def test_ranks_of_one_tie_are_spread(spark):
    df = spark.range(20_000).select("id", F.lit(7).alias("t"))
    assert parts_of(scan.spread(df, [F.col("t").asc()], "tie")) > 1
    places = sorted(r["n"] for r in scan.ranked(df, [F.col("t").asc()], "n").select("n").collect())
    assert places == list(range(20_000))


def test_ranks_follow_the_full_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a int, b string").repartition(5)
    got = [r["id"] for r in scan.ranked(df, [F.col("a").desc_nulls_last(), F.col("b").asc(), F.col("id").asc()], "n").orderBy("n").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))]
    assert scan.ranked(df.where("false"), [F.col("id").asc()], "n").count() == 0


def test_running_values_cross_parts(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "hot", "hot", "hot", "cold"]), i, rng.choice([None, None, rng.randrange(99)])) for i in range(4000)]
    df = scan.spread(spark.createDataFrame(rows, "k string, i long, v long"), [F.col("k").asc(), F.col("i").asc()], "rows")
    assert parts_of(df.where("k = 'hot'")) > 1
    got = scan.running(df, ["k"], {"n": scan.count(), "x": scan.xor(F.col("i")), "last": scan.last(F.col("v"))}).collect()
    state = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        n, x, last = state.get(k, (0, 0, None))
        state[k] = (n + 1, x ^ i, last if v is None else v)
        state[(k, i)] = state[k]
    assert len(got) == len(rows)
    assert all((r["n"], r["x"], r["last"]) == state[(r["k"], r["i"])] for r in got)


def by_hand_asof(left, right, days):
    best = {}
    for i, t, keys in left:
        fit = [(u, o) for o, u, other in right if t <= u <= t + dt.timedelta(days=days) and any(a is not None and a == b for a, b in zip(keys, other, strict=True))]
        if fit:
            best[i] = min(fit)[1]
    return best


def test_asof_under_a_hot_key(spark):
    rng = random.Random(3)
    keys = lambda: (rng.choice(["hot", "hot", "x", None]), rng.choice(["hot", None, "y"]))
    left = [(i, at(rng.randrange(20 * 86400)), keys()) for i in range(400)]
    right = [(i, at(rng.randrange(20 * 86400)), keys()) for i in range(150)] + [(900 + i, at(86400), ("hot", None)) for i in range(3)]
    schema = "i long, t timestamp_ntz, k struct<a: string, b: string>"
    df = lambda rows: spark.createDataFrame(rows, schema).select("i", "t", "k.a", "k.b")
    found = rules.asof_within(df(left), df(right), [F.col("a"), F.col("b")], [F.col("a"), F.col("b")], "t", "t", "i", 2, "i")
    assert {r["i"]: r["match"]["i"] for r in found.select("i", "match").collect()} == by_hand_asof(left, right, 2)


def test_digest_of_long_groups(spark, monkeypatch):
    monkeypatch.setattr(digests, "CHUNK_BYTES", 50)
    rows = [("hot", f"id{i:05}") for i in range(3000)] + [("a", "x"), ("b", "z"), ("b", "y"), (None, "q"), ("c", None)]
    random.Random(1).shuffle(rows)
    got = {r["k"]: r["d"] for r in digests.streamed_sha256(spark.createDataFrame(rows, "k string, v string"), ["k"], "v", "d", "|").collect()}
    want = {k: hashlib.sha256("|".join(sorted(v for x, v in rows if x == k and v)).encode()).hexdigest() for k in ("hot", "a", "b", None)}
    assert got == want


def finding(i, rule, start, ids, entities_=(), severity="low"):
    return (f"c{i:04}", rule, "t", severity, 0.9, at(start), at(start), list(ids), list(entities_), "d", {"key_path": "k"}, 6, i)


FINDING = "correlation_id string, rule_name string, title string, severity string, confidence double, start_time timestamp_ntz, end_time timestamp_ntz, event_ids array<string>, entity_ids array<string>, description string, evidence map<string, string>, rule_ord int, tl_pos long"


def test_windows_and_moments(spark):
    rng = random.Random(5)
    windows = [(i, at(a := rng.randrange(-10**6, 10**7)), at(a + rng.choice([0, 1, 59, 60, 3600, 10**5, 4 * 10**7]))) for i in range(60)] + [(99, at(5), at(4))]
    moments = [(i, at(rng.randrange(-(10**6), 5 * 10**7))) for i in range(300)] + [(1000, windows[0][1]), (1001, windows[0][2])]
    w = spark.createDataFrame(windows, "w long, a timestamp_ntz, b timestamp_ntz")
    m = spark.createDataFrame(moments, "m long, t timestamp_ntz")
    got = sorted((r["w"], r["m"]) for r in incidents.within_windows(w, m, "a", "b", "t").collect())
    assert got == sorted((i, j) for i, a, b in windows for j, t in moments if a <= t <= b)
    assert w.select(F.max(F.size(incidents.window_bins(F.col("a"), F.col("b"))))).first()[0] < 60
    assert incidents.within_windows(w.where("false"), m, "a", "b", "t").count() == 0


def test_enrichment_equals_a_plain_walk(spark):
    rng = random.Random(6)
    primary = [finding(i, "defender_detection", rng.randrange(10**6), [f"e{i}", f"e{i + 1}"] if i % 4 else [f"e{i}"], [f"n{i // 8}"], "high") for i in range(40)]
    context = [finding(100 + i, "browser_activity", rng.randrange(10**6), [f"e{rng.randrange(80)}"], [f"n{rng.randrange(9)}"]) for i in range(60)]
    found = spark.createDataFrame(primary + context, FINDING)
    incs = incidents.incidents(found.where("rule_name = 'defender_detection'"))
    got = {r["incident_id"]: r["supporting_correlation_ids"] for r in incidents.enrich(incs, found).listed().collect()}
    margin = dt.timedelta(minutes=10)
    for r in incs.listed().collect():
        near = [c[0] for c in context if set(c[7]) & set(r["event_ids"]) or set(c[8]) & set(r["entity_ids"]) or r["start_time"] - margin <= c[5] <= r["end_time"] + margin]
        assert got[r["incident_id"]] == sorted(near)
        assert r["incident_id"] == hashlib.sha256("|".join(r["primary_correlation_ids"]).encode()).hexdigest()


def test_links_are_counted(spark):
    rows = [finding(i, "browser_activity", i, ["shared", f"e{i % 3}"]) for i in range(50)]
    incs = incidents.incidents(spark.createDataFrame(rows, FINDING))
    assert {r["id"]: r["n"] for r in incs.events.collect()} == {"shared": 50, "e0": 17, "e1": 17, "e2": 16}
    head = incs.head.collect()
    assert [(r["n_primary"], r["n_events"], r["n_entities"], r["n_supporting"]) for r in head] == [(50, 4, 0, 0)]
    lines = incidents.serialize_lines(incs, spark.createDataFrame(rows, FINDING)).collect()
    assert len(lines) == 50


def test_verdicts(spark):
    rows = [finding(i, "browser_activity", 0, ["e"]) for i in range(3)]
    incs = incidents.incidents(spark.createDataFrame(rows, FINDING))
    name = incs.head.first()["incident_id"]
    more = incs.correlations.union(spark.createDataFrame([(name, "s1", True), (name, "s2", True)], "incident_id string, correlation_id string, supporting boolean"))
    wide = incidents.replace(incs, correlations=more)
    given = spark.createDataFrame([(name, "PARTIALLY_AGREE", ["c0000", "s2", "unknown"], ["s1", "s2", "c0001"])], "incident_id string, verdict string, remove array<string>, promote array<string>")
    out, changes = incidents.apply_verdicts(wide, given)
    assert sorted((r["correlation_id"], r["supporting"]) for r in out.correlations.collect()) == [("c0001", False), ("c0002", False), ("s1", False)]
    assert sorted((r["correlation_id"], r["change"]) for r in changes.collect()) == [("c0000", "removed"), ("s1", "promoted"), ("s2", "removed")]
    assert out.head.select("n_primary", "n_supporting", "verdict").first() == (3, 0, "PARTIALLY_AGREE")
    same, none = incidents.apply_verdicts(wide, given.withColumn("verdict", F.lit("DISAGREE")))
    assert same.correlations.count() == 5 and none.count() == 0


def test_first_distinct_values(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, "hot", "hot", "a"]), rng.choice([None, *"abcdefgh"]), i) for i in range(800)]
    got = {r["k"]: r["v"] for r in tops.first_distinct(spark.createDataFrame(rows, "k string, v string, i long").repartition(4), ["k"], F.col("v"), F.col("i"), 5, "v").collect()}
    assert got == {k: list(dict.fromkeys(v for x, v, _ in rows if x == k and v))[:5] for k in (None, "hot", "a")}


def test_report_lines(spark):
    t = "ioc_type string, value string, source_artifact string, first_seen timestamp_ntz, last_seen timestamp_ntz, confidence double, event_ids array<string>, correlation_ids array<string>, snippet string, severity string, cand_ord long"
    rows = [("url", "http://a", "s", START, START, 0.5, ["e"], ["c1", "c2", "c3"], None, "high", 1), ("ipv4", "1.2.3.4", "s", START, START, 0.5, ["e"], [], None, None, 2), ("ipv4", "1.2.3.4", "s", START, START, 0.5, ["f"], [], None, None, 3), ("odd", "x", "s", START, START, 0.5, [], [], None, None, 4)]
    ids = {f"c{i}": hashlib.sha256(str(i).encode()).hexdigest() for i in (1, 2, 3)}
    lookup = spark.createDataFrame(list(ids.items()), "correlation_id string, incident_id string")
    merged = ioc.merge(spark.createDataFrame(rows, t), lookup)
    got = {r["value"]: (r["group_name"], r["line"]) for r in ioc.report(merged).collect()}
    listed = ", ".join(sorted(ids.values()))[:80]
    assert got == {"http://a": ("URLs", f"- `http://a` (seen 1x , severity: high , incidents: {listed} )"), "1.2.3.4": ("IP Addresses", "- `1.2.3.4` (seen 2x )")}
    assert merged.head.where("value = 'http://a'").first()["n_incidents"] == 3


def test_evidence_of_very_many_rows_is_bounded(spark):
    df = spark.range(1000).select(F.lit("d").alias("name"), F.col("id").alias("ingest_seq"), F.lit(0).alias("emit_ord"), F.create_map(F.lit("k"), (F.col("id") % 500).cast("string")).alias("evidence_str"))
    r = normalize.merge_evidence(df, {"name": F.col("name")}).first()
    assert (r["ingest_seq"], r["n_rows"], r["n_occurrences"]) == (0, 1000, 499)
    assert r["occurrences"] == [f'{{"k":"{i}"}}' for i in range(1, 21)]


KEYS = "event_id string, identity_keys array<struct<kind: string, value: string, entity_type: string, strength: int>>"


def digest(key):
    return hashlib.sha256(f"{key[0]}|{key[2]}|{key[1]}".encode()).hexdigest()


def united(events, keep):
    """Groups of events that share keys of the kept strengths."""
    groups = []
    for name, keys in events.items():
        own = {digest(k) for k in keys if keep(k)}
        hit = [g for g in groups if g[1] & own]
        merged = ({name}.union(*(g[0] for g in hit)), own.union(*(g[1] for g in hit)))
        groups = [g for g in groups if g not in hit] + ([merged] if own else [])
    return [g[0] for g in groups]


def by_hand_entities(events):
    out = {}
    best = lambda names: min((-k[3], digest(k)) for n in names for k in events[n])[1]
    for names in united(events, lambda k: k[3] > 1):
        out |= dict.fromkeys(names, best(names))
    leads = {}
    for n, entity in out.items():
        for k in events[n]:
            if k[3] == 1:
                leads.setdefault(digest(k), set()).add(entity)
    free = {}
    for n, keys in events.items():
        if n in out or not keys:
            continue
        to = set().union(*(leads.get(digest(k), set()) for k in keys))
        if len(to) == 1:
            out[n] = to.pop()
        elif to:
            out[n] = digest(min(keys, key=lambda k: (-k[3], k[0], k[2], k[1])))
        else:
            free[n] = keys
    # what one pass has found is no lead for the next
    for names in united(free, lambda k: True):
        out |= dict.fromkeys(names, best(names))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_entities_of_random_key_sets(spark, seed):
    rng = random.Random(seed)
    key = lambda: (rng.choice("pqr"), str(rng.randrange(25)), "file", rng.choice([1, 1, 1, 2, 3]))
    strength = {}
    events = {}
    for i in range(120):
        keys = {key()[:3] for _ in range(rng.randrange(4))}
        events[f"e{i}"] = [(*k, strength.setdefault(k, rng.choice([1, 1, 1, 1, 2, 3]))) for k in sorted(keys)]
    got = {r["event_id"]: r["entity_id"] for r in entities.resolve(spark.createDataFrame(list(events.items()), KEYS)).collect()}
    assert got == by_hand_entities(events)


def test_events_that_share_only_a_weak_key_meet(spark):
    rows = [("e1", [("p", "a", "file", 1), ("p", "b", "file", 1)]), ("e2", [("p", "b", "file", 1)]), ("e3", [("p", "z", "file", 1)])]
    got = {r["event_id"]: r["entity_id"] for r in entities.resolve(spark.createDataFrame(rows, KEYS)).collect()}
    assert got["e1"] == got["e2"] != got["e3"]
