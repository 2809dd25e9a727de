"""Secret scan: patterns, and a battery of randomness tests with false-discovery control.

Patterns (kinds assign, access, hex) always count. Further tokens, runs of 16 or more letters,
digits and + / _ - with up to two = at the end, are tested. The token's encoding is inferred (hex,
base32, letters, alphanumeric, base64) and gives its alphabet; plain numbers are no secrets. The null hypothesis is that the
token is at least as far from random as ordinary names and words are, in three ways:

* chi-squared of the symbols against a uniform alphabet: noncentral with CHI_DISTANCE a symbol;
* runs above and below the alphabet's middle: their rate differs by RUNS_DISTANCE standard units (times sqrt n);
* serial correlation of neighbouring symbols: it differs by SERIAL_DISTANCE.

The p-values, small when a token is closer to random than that, are combined by Stouffer's weighted
sum. Longer tokens give the tests more power; so the corpus' p-values are put through the
Benjamini-Hochberg step within each encoding and length band, and those below the band's limit are
reported as kind random unless a pattern's span covers them.

Cases: null texts are empty; texts without tokens get no spans; ties in p-value are kept or dropped
together; repeated rows are reported each; empty tables give no rows; other columns are unread.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A match of [A-Z0-9]+ or [0-9a-f]+ is a whole run, so its least length can be part of the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
WORDS = ("passw", "secret", "token", "api")
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

#: The alphabets, the narrowest first.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Squared distance from uniform, times the alphabet's size. Words of a language lie at about 0.7 of 26 letters and over 2 of 62.
CHI_DISTANCE = {"hex": 0.5, "HEX": 0.5, "base32": 0.5, "letters": 0.5, "alphanumeric": 1.0, "base64": 1.0}
RUNS_DISTANCE, SERIAL_DISTANCE = 0.5, 0.35
#: Of the three z values in the sum, in the order chi-squared, runs, serial correlation.
WEIGHTS = (2.0, 1.0, 1.0)
#: Share of false discoveries within a band.
RATE = 0.01
#: Upper ends of the length bands.
BANDS = (20, 24, 32, 40, 64, 128)
#: p-values are counted by their logarithm (base 10) in steps of 1/STEP, down to 10^-LOWEST.
STEP, LOWEST = 100, 60
NORMAL = NormalDist()


def encoding_of(token: str) -> str | None:
    body = set(token.rstrip("="))
    return next((name for name, letters in ALPHABETS.items() if body <= set(letters)), None)


def _noncentral(x: float, k: int, far: float) -> float:
    """z of a noncentral chi-squared value (Sankaran's approximation)."""
    h = 1 - 2 * (k + far) * (k + 3 * far) / (3 * (k + 2 * far) ** 2)
    p = (k + 2 * far) / (k + far) ** 2
    m = (h - 1) * (1 - 3 * h)
    return ((x / (k + far)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * (2 * p) ** 0.5 * (1 + 0.5 * m * p))


def randomness(token: str, encoding: str) -> float:
    """The combined p-value: small if the token looks random. 1 for tokens of one symbol."""
    letters = ALPHABETS[encoding]
    values = np.array([letters.index(c) for c in token.rstrip("=")], float)
    n, k = len(values), len(letters)
    if n < 3 or np.ptp(values) == 0:
        return 1.0
    counts = np.bincount(values.astype(int), minlength=k)
    chi = float((counts**2).sum() * k / n - n)
    z_chi = _noncentral(chi, k - 1, CHI_DISTANCE[encoding] * n)
    high = values >= k / 2
    runs = 1 + int((high[1:] != high[:-1]).sum())
    z_runs = (runs - (n + 1) / 2) / ((n - 1) ** 0.5 / 2)
    c = values - (k - 1) / 2
    z_serial = float((c[1:] * c[:-1]).sum() / ((k * k - 1) / 12)) / (n - 1) ** 0.5
    # equivalence tests: how far inside the distance the observed deviation lies
    zs = (z_chi, abs(z_runs) - RUNS_DISTANCE * n**0.5, abs(z_serial) - SERIAL_DISTANCE * n**0.5)
    total = sum(w * z for w, z in zip(WEIGHTS, zs, strict=True)) / sum(w * w for w in WEIGHTS) ** 0.5
    return max(NORMAL.cdf(total), 10.0**-LOWEST)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind, end; leftmost non-overlapping for each kind, failing matches dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def tokens_to_test(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Start, end, encoding, length band and step of the p-value, of tokens that no known span covers."""
    out = []
    starts = [s for s, _, _ in known]  # ascending
    ends = list(accumulate((e for _, _, e in known), max))
    for m in TOKEN.finditer(text):
        a, b = m.span()
        earlier = bisect_right(starts, a)
        if earlier and b <= ends[earlier - 1]:
            continue
        encoding = encoding_of(m[0])
        if encoding in CHI_DISTANCE:
            band = sum(b - a > x for x in BANDS)
            out.append((a, b, encoding, band, int(np.floor(np.log10(randomness(m[0], encoding)) * STEP))))
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """key, n_assign, n_access, n_hex, base (spans as kind:start:end), spans (base and random ones, in the same form)."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    tested = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("band", pa.int32()), ("step", pa.int32())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, more = [], []
            for t in batch.column(1).to_pylist():
                own = base_spans(t)
                base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in own])
                more.append([dict(zip(("start", "end", "encoding", "band", "step"), s, strict=True)) for s in tokens_to_test(t, own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(more, tested)], ["key", "base", "tested"])

    schema = f"key {kind}, base array<struct<start: int, kind: int, end: int>>, tested array<struct<start: int, end: int, encoding: string, band: int, step: int>>"
    one = stored(rows.mapInArrow(found, schema), "secret-spans")

    # Benjamini-Hochberg by encoding and band, from counts by step: at most 6 x 7 x (LOWEST * STEP + 1) rows
    counts = one.select(F.explode("tested").alias("t")).groupBy("t.encoding", "t.band", "t.step").agg(F.count("*").alias("n"))
    band = Window.partitionBy("encoding", "band")
    ranked = counts.withColumns({"rank": F.sum("n").over(band.orderBy("step")), "m": F.sum("n").over(band)})
    limits = ranked.where(F.pow(F.lit(10.0), (F.col("step") + 1) / F.lit(float(STEP))) <= F.lit(rate) * F.col("rank") / F.col("m")).groupBy("encoding", "band").agg(F.max("step").alias("limit"))
    known = limits.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "encoding", "band").alias("band"), "limit"))).alias("limits"))
    judged = one.crossJoin(F.broadcast(known))  # one row: at most 42 limits
    random = F.expr("transform(filter(tested, t -> t.step <= coalesce(try_element_at(limits, concat_ws(':', t.encoding, t.band)), -1000000)), t -> named_struct('start', t.start, 'kind', 3, 'end', t.end))")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda column: F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s.kind == i)).cast("long").alias(f"n_{KINDS[i]}")
    return judged.select(F.col("key").alias(key), *[count(i) for i in range(3)], shown(F.col("base")).alias("base"), shown(F.concat("base", random)).alias("spans"))

