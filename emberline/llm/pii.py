"""Personal data by weak supervision (DataFrame and SQL functions only).

Candidates are the matches of one pattern for each kind. Kinds of BASE are always reported; those of
EXTRA (social security number, local phone number, name after a title) only if the classifier takes
them. Three labelers vote -1, 0 or 1 on each candidate: a stricter pattern, a gazetteer, and the
words before and after. Expectation-maximisation on the counts of vote patterns (a bounded table)
estimates how often kinds are right and how reliable each labeler is; with its posteriors as soft
labels a log-linear (naive Bayes) span classifier is trained on features of the spans, and scores
every candidate.

Positions: ``split`` gives the text between the matches, so lengths of pieces and matches add up to
the places of the matches (code points). Patterns use possessive groups, which run without recursion
on texts of any length, and start only where a match could start, so runs of digits or letters are
read once.

Cases: null texts are empty; texts without matches get no spans; repeated rows are reported each;
without candidates no model is needed; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: The kinds in the order of the digest, and their patterns.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("ssn", "local_phone", "name")
KINDS = BASE + EXTRA
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single blanks or hyphens between, of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
}
#: A text without this (a plain string, or a short pattern) has no match of the kind.
HINTS = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "reach", "@"),
    "ip": ("ip", "host", "server", "address", "from", "login"),
    "card": ("card", "visa", "credit", "pay", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "ssn": ("ssn", "social", "security", "tax"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "name": ("by", "from", "dear", "signed", "contact"),
}
AGAINST = ("version", "build", "order", "invoice", "isbn", "item", "total", "serial", "sku")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
GIVEN_NAMES = ("anna", "carlos", "claire", "david", "elena", "emma", "hans", "james", "jean", "john", "jose", "julia", "karl", "laura", "lucas", "maria", "marie", "michael", "paul", "peter", "pierre", "robert", "sofia", "thomas")
BEFORE, AFTER = 40, 20
LABELERS = ("strict", "gazetteer", "context")
ROUNDS = 12
#: Added to every count of votes and features.
SMOOTHING = 0.5
THRESHOLD = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """The base kinds' checks; failing matches are dropped."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}")
    if kind == "card":
        return F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _strict(kind: str, m: Column) -> Column:
    if kind == "email":
        good = m.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$") & ~m.contains("..")
        return _vote(good, ~good)
    if kind == "ip":
        return _vote(~m.rlike(r"^(?:0|127|2[2-5][0-9])\.|(?:^|\.)0[0-9]"), m.rlike(r"^0\.|(?:^|\.)0[0-9]"))
    if kind == "card":
        return _vote(_digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), _digits(m).rlike("^(?:0|9)|(.)\\1{7}"))
    if kind == "phone":
        return _vote(F.length(_digits(m)).between(10, 13) & ~m.contains(".."), m.rlike("[-().]{3}"))
    if kind == "ssn":
        bad = m.rlike("^(?:000|666|9)|-00-|-0000$")
        return _vote(~bad, bad)
    if kind == "local_phone":
        good = m.rlike(r"^\(?[2-9][0-9]{2}\D{1,2}[2-9]")
        return _vote(good, ~good)
    return _vote(m.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$"), F.lit(False))


def _listed(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.element_at(F.split(m, r"\."), -1)).isin(*TOP_DOMAINS), m.rlike("[0-9]$"))
    if kind == "ip":
        return _vote(m.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), m.rlike(r"^(?:192\.0\.2|198\.51\.100|203\.0\.113)\."))
    if kind in ("phone", "local_phone"):
        d = _digits(m)
        known = d.substr(1, 1).isin(*CALLING_CODES) | d.substr(1, 2).isin(*CALLING_CODES)
        return _vote(known, ~known) if kind == "phone" else F.lit(0)
    if kind == "name":
        return _vote(F.exists(F.split(F.lower(m), r"\x20"), lambda w: w.isin(*GIVEN_NAMES)), F.lit(False))
    return F.lit(0)


def _whole(words: tuple[str, ...]) -> str:
    """A pattern of whole words, or their plurals; marks stand anywhere."""
    marks = [w for w in words if not w.isalpha()]
    return "|".join([rf"(?<!\p{{L}})(?:{'|'.join(w for w in words if w.isalpha())})s?(?!\p{{L}})", *marks])


def _near(kind: str, before: Column, after: Column) -> Column:
    around = F.lower(F.concat(before, F.lit(" "), after))
    return _vote(around.rlike(_whole(CONTEXT[kind])), around.rlike(_whole(AGAINST)))


def _edge(character: Column) -> Column:
    return F.when(character == "", "none").when(character.rlike(r"\s"), "blank").when(character.rlike(r"[\p{L}\p{N}]"), "word").otherwise("mark")


def _candidates(kind: str, number: int, matches: Column, pieces: Column) -> Column:
    """Valid matches as array of start, kind, end, votes, features."""
    starts_of = F.aggregate(
        F.sequence(F.lit(1), F.size(matches)),
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<INT>)").alias("starts")),
        lambda s, i: F.struct((s["at"] + F.length(F.get(pieces, i - 1)) + F.length(F.get(matches, i - 1))).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.length(F.get(pieces, i - 1)))).alias("starts")),
        lambda s: s["starts"],
    )

    def one(m: Column, i: Column, starts: Column) -> Column:
        before, after = F.right(F.get(pieces, i), F.lit(BEFORE)), F.left(F.get(pieces, i + 1), F.lit(AFTER))
        votes = [_strict(kind, m), _listed(kind, m), _near(kind, before, after)]
        feature = lambda name, value: F.concat(F.lit(f"{kind}|{name}="), value.cast("string"))
        features = F.array(
            *[feature(n, v) for n, v in zip(LABELERS, votes, strict=True)],
            feature("length", F.least(F.floor(F.length(m) / 4), F.lit(10))),
            feature("digits", F.least(F.floor(F.length(_digits(m)) / 3), F.lit(7))),
            feature("before", _edge(F.right(before, F.lit(1)))),
            feature("after", _edge(F.left(after, F.lit(1)))),
        )
        start = F.get(starts, i)
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(m)).alias("end"), F.array(*votes).alias("votes"), features.alias("features"), _valid(kind, m).alias("valid"))

    built = F.flatten(F.transform(F.array(starts_of), lambda starts: F.transform(matches, lambda m, i: one(m, i, starts))))
    return F.filter(built, lambda x: x["valid"])


SPAN = "array<struct<start: int, kind: int, end: int, votes: array<int>, features: array<string>, valid: boolean>>"


def find_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans: all candidates by kind; extra ones that overlap a base one are dropped."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    hit = lambda kind: F.col("text").contains(HINTS[kind]) if kind in HINTS else F.lit(True)
    rows = rows.withColumns({f"m_{k}": F.when(hit(k), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    rows = rows.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none) for k in KINDS})
    rows = rows.select("key", *[F.when(F.size(f"m_{k}") > 0, _candidates(k, i, F.col(f"m_{k}"), F.col(f"p_{k}"))).otherwise(F.expr(f"CAST(array() AS {SPAN})")).cast(SPAN).alias(f"s_{k}") for i, k in enumerate(KINDS)])
    base, extra = F.concat(*[F.col(f"s_{k}") for k in BASE]), F.concat(*[F.col(f"s_{k}") for k in EXTRA])
    rows = rows.select("key", base.alias("base"), extra.alias("extra"))
    apart = F.filter("extra", lambda x: ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return rows.select("key", F.concat("base", apart).alias("spans"))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[dict[int, float], list[dict]]:
    """Expectation-maximisation over kind, votes, n: the share of true candidates by kind, and each labeler's chance of each vote for true and false ones.

    The table has at most 27 rows a kind; each round is one aggregation of it to one row.
    """
    prior = dict.fromkeys(range(len(KINDS)), 0.7)
    chance = [{True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.15, 0: 0.35, -1: 0.5}} for _ in LABELERS]
    for _ in range(rounds):
        post = posterior(prior, chance)
        sums = []
        for k in range(len(KINDS)):
            of = F.when(F.col("kind") == k, F.col("n")).otherwise(0.0)
            sums += [F.sum(of * post).alias(f"true_{k}"), F.sum(of).alias(f"all_{k}")]
        for i in range(len(LABELERS)):
            for v in (1, 0, -1):
                of = F.when(F.get("votes", F.lit(i)) == v, F.col("n")).otherwise(0.0)
                sums += [F.sum(of * post).alias(f"yes_{i}_{v}"), F.sum(of * (1 - post)).alias(f"no_{i}_{v}")]
        row = patterns.agg(*sums).first()
        if row["all_0"] is None:
            break
        prior = {k: (row[f"true_{k}"] + SMOOTHING) / (row[f"all_{k}"] + 2 * SMOOTHING) for k in prior}
        for i, table in enumerate(chance):
            for truth, name in ((True, "yes"), (False, "no")):
                total = sum(row[f"{name}_{i}_{v}"] + SMOOTHING for v in (1, 0, -1))
                table[truth] = {v: (row[f"{name}_{i}_{v}"] + SMOOTHING) / total for v in (1, 0, -1)}
    return prior, chance


def posterior(prior: dict[int, float], chance: list[dict]) -> Column:
    """Chance that a candidate (columns kind, votes) is true."""
    logit = F.element_at(F.create_map(*[F.lit(x) for k, p in prior.items() for x in (k, math.log(p / (1 - p)))]), F.col("kind"))
    for i, table in enumerate(chance):
        logit = logit + F.element_at(F.create_map(*[F.lit(x) for v in (1, 0, -1) for x in (v, math.log(table[True][v] / table[False][v]))]), F.get("votes", F.lit(i)))
    return 1 / (1 + F.exp(-logit))


def train(candidates: DataFrame) -> DataFrame:
    """One row: weights, a map from feature to its weight ('' is the constant). Kinds, features and values are bounded."""
    spans = candidates.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    patterns = stored(spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n")), "vote-patterns")
    soft = spans.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).withColumn("p", posterior(*estimate(patterns)))
    total = soft.agg(F.coalesce(F.sum(F.col("n") * F.col("p")), F.lit(0.0)).alias("yes"), F.coalesce(F.sum(F.col("n") * (1 - F.col("p"))), F.lit(0.0)).alias("no"))
    by_feature = soft.select("n", "p", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum(F.col("n") * F.col("p")).alias("f_yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("f_no"))
    ratio = lambda a, b: F.log((F.col(a) + SMOOTHING) / (F.col(b) + SMOOTHING))
    weights = by_feature.crossJoin(total).select("feature", (ratio("f_yes", "f_no") - ratio("yes", "no")).alias("weight")).union(total.select(F.lit(""), ratio("yes", "no")))
    return stored(weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("weights")), "span-classifier")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, found: array of start, kind (its name), end, base, score, by start and kind; base kinds and extra ones at or above the threshold."""
    candidates = stored(find_candidates(docs, key, text), "pii-candidates")
    model = train(candidates)
    names = F.array(*[F.lit(k) for k in KINDS])

    def scored(s: Column) -> Column:
        weight = lambda f: F.coalesce(F.try_element_at("weights", f), F.lit(0.0))
        logit = F.aggregate(s["features"], weight(F.lit("")), lambda total, f: total + weight(f))
        return F.struct(s["start"].alias("start"), s["kind"].alias("order"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"), (s["kind"] < len(BASE)).alias("base"), (1 / (1 + F.exp(-logit))).alias("score"))

    found = F.filter(F.transform("spans", scored), lambda s: s["base"] | (s["score"] >= threshold))
    # the model is one row of some hundred weights
    return candidates.crossJoin(F.broadcast(model)).select(F.col("key").alias(key), F.array_sort(found).alias("found"))
