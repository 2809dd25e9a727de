"""Incidents: the graph of findings, its components, and what is made of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

from .digests import streamed_sha256
from .graph import components
from .pairs import pairs_within
from .scan import Running, ranked, running, spread
from .store import removed, settled, written
from .tops import first_distinct

#: Weights, thresholds, evidence fields, rules that only add context, and the order of stages and severities.
WEIGHTS = {"shared_event": 120, "shared_entity": 80, "same_executable": 15, "same_user": 10, "temporal_proximity": 5}
LEAST_SCORE, NEAR_SECONDS = 30, 300
EXECUTABLE_FIELDS, USER_FIELDS = ("object_name", "object_path", "executed_name", "process_name", "image"), ("user", "username", "account", "account_name")
CONTEXTUAL = ("registry_persistence", "scheduled_task_persistence", "browser_activity", "logon_activity", "process_execution")
STAGES = ("initial_access", "execution", "persistence", "privilege_escalation", "credential_access", "discovery", "lateral_movement", "defense_evasion", "collection", "command_and_control", "exfiltration", "impact")
SEVERITIES = ("low", "medium", "high", "critical")
ENRICH_MINUTES = 10


def severity_rank(c: str | Column) -> Column:
    """low 0 to critical 3; anything else -1."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), C.col(c)) - 1, F.lit(-1)).cast("int")


def evidence_values(fields: tuple[str, ...]) -> Column:
    """The distinct values of the evidence's fields, trimmed, in lower case."""
    return F.array_distinct(F.array_compact(F.array(*[F.lower(F.trim(C.truthy(F.try_element_at("evidence", F.lit(f))))) for f in fields])))


def shared_ids(findings: DataFrame) -> DataFrame:
    """correlation_id, link: one row for each event and entity of a finding."""
    links = F.concat(F.transform("event_ids", lambda e: F.concat(F.lit("v:"), e)), F.transform("entity_ids", lambda e: F.concat(F.lit("n:"), e)))
    return findings.select("correlation_id", "rule_ord", "tl_pos", F.explode(F.array_distinct(links)).alias("link"))


def edge_classes(findings: DataFrame) -> DataFrame:
    """link, n, pairs: the findings that share an event or entity, as one class with its size and the number of pairs it stands for.

    :func:`shared_ids` has the members. Both are linear in the findings, whatever they share; pairs can be drawn from them.
    """
    sizes = shared_ids(findings).groupBy("link").agg(F.count_distinct("rule_ord", "tl_pos").alias("n"))
    return sizes.where("n > 1").withColumn("pairs", F.expr("n * (n - 1) DIV 2"))


def _linked_pairs(findings: DataFrame, carried: list[Column], links: DataFrame | None = None) -> DataFrame:
    """x, y: the pairs of findings that share an event or entity (of ``links``, if given), each once, with the carried columns.

    A pair comes from the first link that both have, so the pairs needn't be made distinct: each member of a
    link brings its earlier links along. Pairs are neither shuffled nor written.
    """
    ids = F.concat(F.transform("event_ids", lambda e: F.concat(F.lit("v:"), e)), F.transform("entity_ids", lambda e: F.concat(F.lit("n:"), e)))
    rows = findings.select("rule_ord", "tl_pos", *carried, F.array_sort(F.array_distinct(ids)).alias("_links"))
    if links is not None:
        chosen = shared_ids(findings).join(links.select("link").distinct(), "link", "left_semi").groupBy("rule_ord", "tl_pos").agg(F.array_sort(F.collect_set("link")).alias("_links"))
        rows = rows.drop("_links").join(chosen, ["rule_ord", "tl_pos"])
    each = rows.select("*", F.posexplode("_links").alias("_at", "link")).where("link IS NOT NULL").withColumn("earlier", F.expr("slice(_links, 1, _at)")).drop("_links", "_at")
    each = written(each.dropDuplicates(["rule_ord", "tl_pos", "link"]), "link-members")
    ordered = "(x.rule_ord < y.rule_ord OR (x.rule_ord = y.rule_ord AND x.tl_pos < y.tl_pos))"
    return pairs_within(each, ["link"], ["rule_ord", "tl_pos"], f"{ordered} AND NOT arrays_overlap(x.earlier, y.earlier)")


def pairs_of(findings: DataFrame, links: DataFrame | None) -> DataFrame:
    """The candidate pairs of some classes only (``links``: link), each once."""
    order = lambda side, name: F.struct(F.col(f"{side}.rule_ord").alias("rule_ord"), F.col(f"{side}.tl_pos").alias("tl_pos")).alias(name)
    return _linked_pairs(findings, [], links).select(order("x", "source_ord"), order("y", "target_ord"))


def edge_candidates(findings: DataFrame) -> DataFrame:
    """source_ord, target_ord (struct<rule_ord, tl_pos>): pairs of findings that share an event or entity, each once.

    Only such pairs can reach the least score. Their number grows with the square of what shares an id,
    by contract, so this is on demand; components don't need it.
    """
    return pairs_of(findings, None)


def edges(findings: DataFrame) -> DataFrame:
    """source, target, score, matched_criteria of the pairs that score enough."""
    carried = [F.col(c) for c in ("correlation_id", "event_ids", "entity_ids", "start_time")] + [evidence_values(EXECUTABLE_FIELDS).alias("programs"), evidence_values(USER_FIELDS).alias("users")]
    pairs = _linked_pairs(findings, carried).withColumnsRenamed({"x": "source", "y": "target"})
    overlap = lambda f: F.arrays_overlap(f"source.{f}", f"target.{f}")
    shared = overlap("event_ids") | overlap("entity_ids")
    near = F.abs(F.timestamp_diff("MICROSECOND", F.col("source.start_time"), F.col("target.start_time"))) <= NEAR_SECONDS * 1_000_000
    tests = {"shared_event": overlap("event_ids"), "shared_entity": overlap("entity_ids"), "same_executable": shared & overlap("programs"), "same_user": shared & overlap("users"), "temporal_proximity": shared & near}
    criteria = F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))
    score = sum((F.when(t, WEIGHTS[n]).otherwise(0) for n, t in tests.items()), F.lit(0))
    return pairs.select(F.col("source.correlation_id").alias("source"), F.col("target.correlation_id").alias("target"), score.alias("score"), criteria.alias("matched_criteria")).where(F.col("score") >= LEAST_SCORE)


def clusters(findings: DataFrame) -> DataFrame:
    """correlation_id, root: components of findings joined by events and entities.

    Each finding is tied to the smallest one that has the same event or entity, n edges for n findings of an id.
    """
    links = shared_ids(findings).select("link", "correlation_id")
    first = links.groupBy("link").agg(F.min("correlation_id").alias("first"))
    found = components(links.join(first, "link").select("correlation_id", "first"), "correlation_id", "first")
    return found.select(F.col("node").alias("correlation_id"), F.concat(F.lit("c:"), "root").alias("root"))


def unique_findings(findings: DataFrame) -> DataFrame:
    """One finding for each id: the last in order."""
    return findings.groupBy("correlation_id").agg(F.max_by(F.struct(*findings.columns), F.struct("rule_ord", "tl_pos")).alias("f")).select("f.*")


@dataclass(frozen=True)
class Incidents:
    """Incidents as tables: one row for each, and one for each of its links. No row holds what grows with an incident.

    head: incident_id, start_time, end_time, severity, confidence, n_primary, n_supporting, n_events,
    n_entities, rule_names (of the rules there are).
    correlations: incident_id, correlation_id, supporting.
    events, entities: incident_id, id, n (findings of the incident that name it).
    around: after enrichment, the supporting findings as windows and moments. ``correlations`` then makes their pairs when it is read.
    """

    head: DataFrame
    correlations: DataFrame
    events: DataFrame
    entities: DataFrame
    around: Around | None = None

    def only(self, head: DataFrame) -> Incidents:
        """The incidents of ``head``."""
        ids = head.select("incident_id")
        around = self.around and replace(self.around, **{t: getattr(self.around, t).join(ids, "incident_id", "left_semi") for t in ("windows", "linked")})
        return replace(self, head=head, around=around, **{t: getattr(self, t).join(ids, "incident_id", "left_semi") for t in ("correlations", "events", "entities")})

    def primary(self) -> DataFrame:
        return self.correlations.where("NOT supporting").drop("supporting")

    def supporting(self) -> DataFrame:
        return self.correlations.where("supporting").drop("supporting")

    def counted(self) -> Incidents:
        """With n_primary and n_supporting as the links are."""
        of = lambda rows, name: rows.groupBy("incident_id").agg(F.count("*").alias(name))
        joined = self.head.drop("n_primary", "n_supporting").join(of(self.primary(), "n_primary"), "incident_id", "left")
        joined = joined.join(of(self.supporting(), "n_supporting") if self.around is None else self.around.counts().withColumnRenamed("n", "n_supporting"), "incident_id", "left")
        return replace(self, head=joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_primary", "n_supporting")}))

    def among(self, asked: DataFrame) -> DataFrame:
        """The links among those asked for (incident_id, correlation_id and more), with ``supporting``."""
        on = ["incident_id", "correlation_id"]
        if self.around is None:
            return asked.join(self.correlations, on)
        return asked.join(self.primary(), on).withColumn("supporting", F.lit(False)).unionByName(self.around.among(asked).withColumn("supporting", F.lit(True)))

    def supporting_lists(self, first: int = 0, separator: str | None = None) -> DataFrame:
        """incident_id, digest (of the sorted supporting ids, with a separator), first (the first few of them)."""
        if self.around is not None:
            return self.around.lists(first, separator)
        rows = self.supporting()
        some = first_distinct(rows, ["incident_id"], F.col("correlation_id"), F.col("correlation_id"), first, "first")
        if separator is None:
            return some.withColumn("digest", F.lit(None).cast("string"))
        return some.join(streamed_sha256(rows, ["incident_id"], "correlation_id", "digest", separator), "incident_id", "full")

    def listed(self) -> DataFrame:
        """The head with sorted arrays of ids. On demand: a row then grows with its incident."""
        out = self.head
        links = {"primary_correlation_ids": (self.primary(), "correlation_id"), "supporting_correlation_ids": (self.supporting(), "correlation_id"), "event_ids": (self.events, "id"), "entity_ids": (self.entities, "id")}
        for name, (rows, column) in links.items():
            out = out.join(rows.groupBy("incident_id").agg(F.array_sort(F.collect_list(column)).alias(name)), "incident_id", "left").withColumn(name, F.coalesce(name, C.strings()))
        return out


def incidents(findings: DataFrame, roots: DataFrame | None = None) -> Incidents:
    """The incidents of the findings' components.

    An incident's id is the digest of its findings' ids, which are hashed one after the other.
    """
    needed = [c for c in findings.columns if c not in ("title", "description", "evidence", "techniques")]

    def rooted() -> DataFrame:
        unique = written(unique_findings(findings.select(needed)), "unique-findings")
        return unique.join(clusters(unique) if roots is None else roots, "correlation_id")

    member = settled(rooted, "members")
    named = settled(lambda: streamed_sha256(member, ["root"], "correlation_id", "incident_id", "|"), "incident-ids")
    linked = lambda ids: member.select("root", F.explode(ids).alias("id")).groupBy("root", "id").agg(F.count("*").alias("n"))
    events, entities = (written(linked(ids).join(named, "root").select("incident_id", "id", "n"), ids) for ids in ("event_ids", "entity_ids"))
    primary = written(member.join(named, "root").select("incident_id", "correlation_id", F.lit(False).alias("supporting")), "primary")
    sized = lambda rows, name: rows.groupBy("incident_id").agg(F.count("*").alias(name))
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.max(severity_rank("severity")) + 1)
    span = {"start_time": F.min("start_time"), "end_time": F.max("end_time"), "severity": worst, "confidence": F.min("confidence"), "n_primary": F.count("*")}
    head = member.groupBy("root").agg(*[c.alias(n) for n, c in span.items()], F.array_sort(F.collect_set("rule_name")).alias("rule_names")).join(named, "root").drop("root")
    for rows, name in ((events, "n_events"), (entities, "n_entities")):
        head = head.join(sized(rows, name), "incident_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    whole = written(head.withColumn("n_supporting", F.lit(0).cast("long")), "incidents")
    removed(member, named)
    return Incidents(whole, primary, events, entities)


# --- windows and moments

#: Levels of bins that windows are covered by: the first is a minute, each next one twice as long.
LEVELS = 40
_MINUTE = 60_000_000


def _minute(time: Column) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / _MINUTE)


def window_bins(start: Column, end: Column) -> Column:
    """The bins, struct<level, bin>, that cover a window without overlap: two of each level at most."""
    low, past = _minute(start), _minute(end) + 1

    def bins(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        a, b = F.ceil(low / size), F.floor(past / size)
        own = lambda on, at: F.when((a < b) & on, F.struct(level.alias("level"), at.alias("bin")))
        return F.array_compact(F.array(own(a % 2 != 0, a), own(b % 2 != 0, b - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), bins))


def within_windows(windows: DataFrame, moments: DataFrame, start: str, end: str, time: str) -> DataFrame:
    """All pairs of a window and a moment in it, both ends included.

    A window is in a few bins of each level, a moment in one, so a long window costs no more than some
    eighty rows and a moment one row for each level that windows use.
    """
    covered = written(windows.select("*", F.explode(window_bins(F.col(start), F.col(end))).alias("_bin")), "window-bins")
    levels = covered.select("_bin.level").distinct().groupBy().agg(F.array_sort(F.collect_set("level")).alias("l")).first()["l"]
    own = F.transform(F.array(*[F.lit(x) for x in levels]), lambda x: F.struct(x.alias("level"), F.floor(_minute(F.col(time)) / F.call_function("shiftleft", F.lit(1).cast("long"), x)).alias("bin")))
    probes = moments.select("*", F.explode(own if levels else F.array().cast("array<struct<level: int, bin: bigint>>")).alias("_bin"))
    return covered.join(probes, "_bin").where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_bin")


#: Incidents that a task holds while contextual findings go by, and groups of them that are made at least.
GROUP, GROUPS = 65_536, 12


@dataclass(frozen=True)
class Around:
    """Supporting findings, without a row for each pair: those of ``context`` that start in an incident's window, and some others.

    windows: incident_id, a, b. context: correlation_id, start_time. linked: incident_id, correlation_id of those outside of the window.
    """

    windows: DataFrame
    context: DataFrame
    linked: DataFrame

    def pairs(self) -> DataFrame:
        """incident_id, correlation_id: all of them. They can be as many as incidents times findings; on demand."""
        return within_windows(self.windows, self.context, "a", "b", "start_time").select("incident_id", "correlation_id").union(self.linked)

    def among(self, asked: DataFrame) -> DataFrame:
        """The rows of ``asked`` (incident_id, correlation_id and more) that are supporting."""
        near = asked.join(self.windows, "incident_id").join(self.context, "correlation_id").where("start_time >= a AND start_time <= b").select(asked.columns)
        return near.union(asked.join(self.linked, ["incident_id", "correlation_id"], "left_semi").select(asked.columns))

    def counts(self) -> DataFrame:
        """incident_id, n: by the places of the windows' ends among the moments, so linear in both."""
        row = lambda t, kind, sign: (F.col(t).alias("t"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign"))
        moments = self.context.where("start_time IS NOT NULL").select(*row("start_time", 1, 0), F.lit(None).cast("string").alias("incident_id"))
        ends = [self.windows.where("a <= b").select(*row(c, kind, sign), "incident_id") for c, kind, sign in (("a", 0, -1), ("b", 2, 1))]
        placed = spread(moments.union(ends[0]).union(ends[1]), [F.col("t").asc(), F.col("kind").asc()], "moments")
        seen = Running(F.count(F.when(F.col("kind") == 1, 1)), F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here)
        inside = running(placed, [], {"seen": seen}).where("kind <> 1").select("incident_id", (F.col("sign") * F.col("seen")).alias("n"))
        return inside.union(self.linked.select("incident_id", F.lit(1).cast("long"))).groupBy("incident_id").agg(F.sum("n").alias("n"))

    def lists(self, first: int, separator: str | None) -> DataFrame:
        """incident_id, digest of the sorted ids (if there is a separator), first (the first few).

        Incidents with alike windows form a group. The contextual findings go by a group in order of their ids, a
        batch at a time, and each incident takes from the batch what lies in its window; so a pair is never a row.
        """
        length = F.floor(F.log2(F.greatest(F.timestamp_diff("MINUTE", F.col("a"), F.col("b")), F.lit(0)) + 1))
        total = self.windows.count()
        groups = max(GROUPS, -(-total // GROUP))
        at = F.floor(F.col("_place") * groups / F.lit(max(total, 1))).cast("int")
        order = [F.col(c).asc() for c in ("_length", "a", "incident_id")]
        grouped = ranked(self.windows.withColumn("_length", length), order, "_place").withColumn("group", at).select("group", "incident_id", "a", "b")
        spans = grouped.groupBy("group").agg(F.min("a").alias("low"), F.max("b").alias("high"))  # a row for each group
        none = lambda c: F.lit(None).cast(self.windows.schema[c].dataType).alias(c)
        text = F.lit(None).cast("string")
        rows = grouped.select("group", text.alias("id"), none("a").alias("t"), "incident_id", "a", "b")
        near = self.context.join(F.broadcast(spans), F.col("start_time").between(F.col("low"), F.col("high")))
        rows = rows.union(near.select("group", "correlation_id", F.col("start_time").cast(self.windows.schema["a"].dataType), text, none("a"), none("b")))
        linked = self.linked.join(grouped.select("group", "incident_id"), "incident_id")
        rows = rows.union(linked.select("group", "correlation_id", none("a"), "incident_id", none("a"), none("b")))
        dealt = rows.repartition(groups, "group").sortWithinPartitions("group", F.col("id").asc_nulls_first())
        return dealt.mapInArrow(_walk(first, separator), "incident_id string, digest string, first array<string>")


class _Taken:
    """What the incidents of one group have taken so far."""

    def __init__(self, first: int, separator: str | None):
        self.most, self.separator = first, (separator or "").encode()
        self.hashed, self.names, self.ends = separator is not None, [], []
        self.number: dict[str, int] | None = None

    def windows(self, names: list[str], low: list[int | None], high: list[int | None]) -> None:
        self.names += names
        self.ends += [(1, 0) if a is None or b is None else (a, b) for a, b in zip(low, high, strict=True)]

    def _begin(self) -> None:
        self.number = {n: i for i, n in enumerate(self.names)}
        self.low, self.high = np.array(self.ends, np.int64).reshape(-1, 2).T
        self.states, self.first = [None] * len(self.names), [[] for _ in self.names]
        self.open = np.ones(len(self.names), bool)  # those that take more

    def findings(self, ids: pa.Array, times: pa.Array, owners: list[str | None]) -> None:
        if self.number is None:
            self._begin()
        moved = np.array([o is None for o in owners], bool)
        own: dict[int, list[int]] = {}
        for i in np.flatnonzero(~moved).tolist():
            own.setdefault(self.number[owners[i]], []).append(i)
        at, t = np.flatnonzero(moved), times.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)[moved]
        by_time = np.argsort(t, kind="stable")
        a, b = np.searchsorted(t[by_time], self.low, "left"), np.searchsorted(t[by_time], self.high, "right")
        texts, cut = ids.to_pylist(), None
        if self.hashed:
            raw = [self.separator + x.encode() for x in texts]
            if len({len(x) for x in raw}) == 1:
                cut = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        wanted = (a < b) & (self.low <= self.high)
        wanted[list(own)] = True
        for k in np.flatnonzero(wanted & self.open).tolist():
            inside = by_time[a[k] : max(a[k], b[k])]
            chosen = at[np.sort(inside)] if len(inside) < len(t) else at
            if k in own:
                chosen = np.sort(np.concatenate([chosen, own[k]]))
            if (need := self.most - len(self.first[k])) > 0:
                self.first[k] += [texts[i] for i in chosen[:need].tolist()]
            if self.hashed:
                body = cut[chosen].tobytes() if cut is not None else b"".join([raw[i] for i in chosen.tolist()])
                if self.states[k] is None:
                    self.states[k], body = hashlib.sha256(), body[len(self.separator) :]
                self.states[k].update(body)
            elif len(self.first[k]) >= self.most:
                self.open[k] = False

    def rows(self) -> pa.RecordBatch:
        if self.number is None:
            self._begin()
        digests = [s and s.hexdigest() for s in self.states]
        return pa.RecordBatch.from_arrays([pa.array(self.names, pa.string()), pa.array(digests, pa.string()), pa.array(self.first, pa.list_(pa.string()))], ["incident_id", "digest", "first"])


def _walk(first: int, separator: str | None):
    """Rows of groups, each with its incidents first and then findings by id: incident_id, digest, first."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, None
        for batch in batches:
            group = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if taken is None or group[start] != now:
                    if taken is not None:
                        yield taken.rows()
                    now, taken = group[start], _Taken(first, separator)
                part = batch.slice(start, end - start)
                heads = part.column(1).null_count
                if heads:
                    top = part.slice(0, heads)
                    low, high = (top.column(c).cast(pa.int64()).to_pylist() for c in (4, 5))
                    taken.windows(top.column(3).to_pylist(), low, high)
                if heads < len(part):
                    rest = part.slice(heads)
                    taken.findings(rest.column(1), rest.column(2), rest.column(3).to_pylist())
        if taken is not None:
            yield taken.rows()

    return walked


def enrich(incs: Incidents, findings: DataFrame, minutes: int = ENRICH_MINUTES) -> Incidents:
    """Attaches contextual findings that are primary nowhere: by event, by entity, or by a start near the window.

    Those near the window can be as many as incidents times findings, so they are kept as windows and moments
    (:class:`Around`): counts, digests and chosen links come from there, and pairs are made when ``correlations`` is read.
    """
    primary = incs.primary().select("correlation_id").distinct()
    own = ["correlation_id", "start_time", "event_ids", "entity_ids", "rule_ord", "tl_pos"]
    context = written(unique_findings(findings.where(F.col("rule_name").isin(*CONTEXTUAL)).select(own)).join(primary, "correlation_id", "left_anti"), "context")
    by = lambda links, ids: links.select("incident_id", "id").join(context.select("correlation_id", F.explode(ids).alias("id")), "id").select("incident_id", "correlation_id")
    margin = F.expr(f"interval {minutes} minutes")
    windows = written(incs.head.select("incident_id", (F.col("start_time") - margin).alias("a"), (F.col("end_time") + margin).alias("b")), "windows")
    moments = context.select("correlation_id", "start_time")
    # what is primary in the incident stays so; what lies in the window is not linked once more
    more = incs.supporting().union(by(incs.events, "event_ids")).union(by(incs.entities, "entity_ids")).distinct().join(incs.primary(), ["incident_id", "correlation_id"], "left_anti")
    placed = more.join(windows, "incident_id").join(moments, "correlation_id", "left")
    linked = written(placed.where(~F.coalesce((F.col("start_time") >= F.col("a")) & (F.col("start_time") <= F.col("b")), F.lit(False))).select("incident_id", "correlation_id"), "linked")
    around = Around(windows, moments, linked)
    links = incs.primary().withColumn("supporting", F.lit(False)).union(around.pairs().withColumn("supporting", F.lit(True)))
    return replace(incs, correlations=links, around=around).counted()


def keep_incidents(incs: Incidents, confidence: float = 0.55, correlations: int = 3, events: int = 5, seconds: float = 10) -> Incidents:
    """Those that are sure, large and long enough and not contextual only (no rules count as contextual)."""
    long = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) >= int(seconds * 1_000_000)
    large = (F.col("n_primary") >= correlations) & (F.col("n_events") >= events)
    return incs.only(incs.head.where((F.col("confidence") >= confidence) & large & long & ~F.forall("rule_names", lambda r: r.isin(*CONTEXTUAL))))


def members(incs: Incidents, findings: DataFrame, which: str = "primary") -> DataFrame:
    """incident_id and the findings of its primary or supporting ids; ids that are not known are left out."""
    return (incs.primary() if which == "primary" else incs.supporting()).join(unique_findings(findings), "correlation_id")


def serialize(incs: Incidents, findings: DataFrame) -> DataFrame:
    """incident_id, json: nested, sorted, with ISO times. One text holds an incident, as the format has it; :func:`serialize_lines` doesn't."""
    by_id = lambda a, b: F.when(a["correlation_id"] < b["correlation_id"], -1).when(a["correlation_id"] > b["correlation_id"], 1).otherwise(0)
    # each step by itself, so that only its own shuffle files are there
    shaped = [c for c in findings.columns if c not in ("techniques",)]
    nested = lambda which: written(members(incs, findings.select(shaped), which).groupBy("incident_id").agg(F.array_sort(F.collect_list(_shape()), by_id).alias(f"{which}_correlations")), f"{which}-nested")
    joined = written(incs.listed(), "listed").join(nested("primary"), "incident_id", "left").join(nested("supporting"), "incident_id", "left")
    empty = F.slice("primary_correlations", 1, 0)
    whole = F.struct("incident_id", C.iso("start_time").alias("start_time"), C.iso("end_time").alias("end_time"), "severity", "confidence", "event_ids", "entity_ids", "rule_names", "primary_correlations", F.coalesce("supporting_correlations", empty).alias("supporting_correlations"))
    return joined.select("incident_id", F.to_json(whole).alias("json"))


def _shape() -> Column:
    return F.struct("correlation_id", "rule_name", "title", "severity", "confidence", C.iso("start_time").alias("start_time"), C.iso("end_time").alias("end_time"), "event_ids", "entity_ids", "description", "evidence")


def serialize_lines(incs: Incidents, findings: DataFrame) -> DataFrame:
    """incident_id, supporting, json: a line for each finding of an incident, for incidents of any size."""
    both = incs.correlations.join(unique_findings(findings), "correlation_id")
    return both.select("incident_id", "supporting", F.to_json(_shape()).alias("json"))


def prioritize(incs: Incidents) -> DataFrame:
    """The head with priority_rank 1, 2, ...: severity, confidence, findings, events, then id."""
    order = [F.desc(severity_rank("severity")), F.desc("confidence"), F.desc("n_primary"), F.desc("n_events"), F.asc("incident_id")]
    return ranked(incs.head, order, "priority_rank").withColumn("priority_rank", F.col("priority_rank") + 1)


def incident_timelines(incs: Incidents, timeline: DataFrame) -> DataFrame:
    """The events of each incident, in timeline order (tl_pos)."""
    return incs.events.select("incident_id", F.col("id").alias("event_id")).join(timeline, "event_id")


def attack_chain(incs: Incidents, findings: DataFrame) -> DataFrame:
    """stage, stage_order, n, title, confidence (of the first): findings of all incidents by their attack_stage; none without that column."""
    if "attack_stage" not in findings.columns:
        findings = findings.withColumn("attack_stage", F.lit(None).cast("string"))
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("attack_stage"))
    known = members(incs, findings).withColumn("stage_order", place).where("stage_order > 0")
    first = F.min_by(F.struct("title", "confidence"), F.struct("rule_ord", "tl_pos"))
    return known.groupBy(F.col("attack_stage").alias("stage"), "stage_order").agg(F.count("*").alias("n"), first.alias("f")).select("stage", "stage_order", "n", "f.title", "f.confidence")


def apply_verdicts(incs: Incidents, verdicts: DataFrame) -> tuple[Incidents, DataFrame]:
    """The incidents with verdicts applied (verdicts: incident_id, verdict, remove, promote as arrays of ids), and what changed.

    Only PARTIALLY_AGREE changes anything: known ids are removed first, then supporting ones promoted.
    Changes: incident_id, correlation_id, change (removed or promoted). The head has the verdict.
    """
    partly = verdicts.where("verdict = 'PARTIALLY_AGREE'")
    asked = lambda c: partly.select("incident_id", F.explode(c).alias("correlation_id")).distinct().withColumn(c, F.lit(True))
    both = asked("remove").join(asked("promote"), ["incident_id", "correlation_id"], "full")
    change = F.when(F.col("remove"), "removed").when(F.col("promote") & F.col("supporting"), "promoted")
    changed = written(incs.among(both).withColumn("change", change).where("change IS NOT NULL").select("incident_id", "correlation_id", "supporting", "change"), "verdicts")
    marked = incs.correlations.join(changed.drop("supporting"), ["incident_id", "correlation_id"], "left")
    left = marked.where("change IS NULL OR change <> 'removed'").select("incident_id", "correlation_id", (F.col("supporting") & F.col("change").isNull()).alias("supporting"))
    times = lambda test: F.count_if(F.expr(test))
    moved = changed.groupBy("incident_id").agg((times("change = 'promoted'") - times("change = 'removed' AND NOT supporting")).alias("_primary"), (-times("supporting")).alias("_supporting"))
    head = incs.counted().head.join(moved, "incident_id", "left").withColumns({f"n{c}": F.col(f"n{c}") + F.coalesce(c, F.lit(0)) for c in ("_primary", "_supporting")}).drop("_primary", "_supporting")
    head = head.join(verdicts.select("incident_id", "verdict"), "incident_id", "left")
    return replace(incs, head=head, correlations=left, around=None), changed.drop("supporting")


def verdict_error(raw: str | Column) -> Column:
    """What is wrong with a verdict's JSON text, or NULL: five fields, a known verdict, a number, a text, lists of texts."""
    v = F.try_parse_json(C.col(raw))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    fields = ("verdict", "confidence", "reasoning", "suggested_additions", "suggested_removals")
    checks = [F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not an object")]
    checks += [F.when(kind(f"$.{f}").isNull(), f"missing {f}") for f in fields]
    checks.append(F.when(~F.coalesce(F.try_variant_get(v, "$.verdict", "string").isin("AGREE", "PARTIALLY_AGREE", "DISAGREE"), F.lit(False)), "unknown verdict"))
    checks.append(F.when(~kind("$.confidence").rlike("^(BIGINT|DOUBLE|DECIMAL)"), "confidence is no number"))
    checks.append(F.when(kind("$.reasoning") != "STRING", "reasoning is no text"))
    checks += [F.when(~kind(f"$.{f}").rlike(r"^ARRAY<(STRING|VOID)>$"), f"{f} is no list of texts") for f in ("suggested_additions", "suggested_removals")]
    return F.coalesce(*checks)
