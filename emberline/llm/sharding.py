"""Sharding by a Feistel permutation of global row numbers (DataFrame and SQL functions only).

Rows get gapless numbers 0..N-1 (order: md5 of the key, key, size, crc). A Feistel network over
the mixed-radix domain a x b (a = ceil(sqrt(N)), b = ceil(N/a)) permutes the numbers; a value that
leaves 0..N-1 is permuted again (cycle walking). From the permuted position p, shard = p mod S and
slot = p div S, so the shard counts differ by one at most, slots have no gaps, and the place of a
row follows from its number, and the number from its place, without a look-up table.

Cases: null texts count as no text (size 1, crc of no bytes); null keys sort first; rows that are
equal in key, size and crc are interchangeable and take neighbouring numbers; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .numbering import number_rows

ROUNDS = 4
#: Most steps of a walk. A step stays outside with a chance under 1/sqrt(N), and the walk cannot be longer than the part outside.
MOST_STEPS = 64


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1) if n else 1
    return a, max(1, -(-n // a))


def _permuted(x: str, n: int, seed: int, rounds: int, backward: bool) -> str:
    a, b = domain(n)
    steps = min(a * b - n + 1, MOST_STEPS)
    prf = lambda half, m: f"conv(substring(md5(concat('{seed}:', i, ':', s.{half})), 1, 12), 16, 10) % {m}"
    sign = "-" if backward else "+"
    left = f"named_struct('l', CAST(pmod(s.l {sign} CAST({prf('r', a)} AS BIGINT), {a}) AS BIGINT), 'r', s.r)"
    right = f"named_struct('l', s.l, 'r', CAST(pmod(s.r {sign} CAST({prf('l', b)} AS BIGINT), {b}) AS BIGINT))"
    order = f"sequence({rounds - 1}, 0, -1)" if backward else f"sequence(0, {rounds - 1})"
    once = f"aggregate({order}, named_struct('l', CAST(y div {b} AS BIGINT), 'r', CAST(y % {b} AS BIGINT)), (s, i) -> IF(i % 2 = 0, {left}, {right}), s -> s.l * {b} + s.r)"
    return f"aggregate(sequence(1, {steps}), CAST({x} AS BIGINT), (y, k) -> IF(k > 1 AND y < {n}, y, {once}), y -> IF(y < {n}, y, CAST(raise_error('the walk did not end') AS BIGINT)))"


def permute(x: str, n: int, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """The position of row number ``x`` (a SQL expression) among ``n`` rows."""
    return F.expr(_permuted(x, n, seed, rounds, False))


def unpermute(position: str, n: int, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """The row number at ``position``: the inverse of :func:`permute`."""
    return F.expr(_permuted(position, n, seed, rounds, True))


def row_number_at(shard: str, slot: str, shards: int, n: int, seed: int = 0) -> Column:
    """The number of the row that lies in ``slot`` of ``shard``."""
    return unpermute(f"{slot} * {shards} + {shard}", n, seed)


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, size, text_crc32, row_no, position, shard, slot."""
    body = text_or_empty(text).cast("binary")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    n = docs.count()
    numbered = number_rows(rows, "key", [], ["size", "text_crc32"], "row_no")
    placed = numbered.withColumn("position", permute("row_no", n, seed))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "row_no", "position", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"))
