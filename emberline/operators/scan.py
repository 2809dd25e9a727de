"""Ranks and running values over tables that are sorted across tasks.

A window puts each of its groups into one task, and a window without groups the whole table. Here the
rows are first cut into parts by ranges of the full order (rows that tie are cut by their place), each
part is worked on by itself, and what a group has gathered in earlier parts is added. So a group, or a
tie, of any size is spread over as many tasks as it fills.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Bits of a row's place in its part, as Spark numbers rows within partitions.
PLACE_BITS = 33


@dataclass(frozen=True)
class Running:
    """A value that grows along a group: over rows, then over the parts' last values, then both together."""

    rows: Column
    parts: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


def count() -> Running:
    return Running(F.count(F.lit(1)), F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here)


def xor(value: Column) -> Running:
    return Running(F.bit_xor(value), F.bit_xor, lambda before, here: F.coalesce(before, F.lit(0)).bitwiseXOR(here))


def last(value: Column) -> Running:
    """The last value that is not null, the row's own included."""
    return Running(F.last(value, ignorenulls=True), lambda x: F.last(x, ignorenulls=True), lambda before, here: F.coalesce(here, before))


def spread(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """The rows with ``part`` and ``place``, written out: sorting by them gives the order, and ties are settled."""
    tied = df.withColumn("scan_tie", F.monotonically_increasing_id())
    full = [*order, F.col("scan_tie").asc()]
    at = tied.repartitionByRange(*full).sortWithinPartitions(*full).drop("scan_tie").withColumn("scan_at", F.monotonically_increasing_id())
    part, place = F.shiftrightunsigned("scan_at", PLACE_BITS), F.col("scan_at").bitwiseAND((1 << PLACE_BITS) - 1)
    return written(at.withColumns({"part": part, "place": place}).drop("scan_at"), label)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place in the full order, from 0."""
    rows = spread(df, order, "ranked")
    sizes = rows.groupBy("part").count()
    # a row for each part: no more than there are shuffle partitions
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("scan_before"))
    return rows.join(F.broadcast(before), "part").withColumn(name, F.col("scan_before") + F.col("place")).drop("part", "place", "scan_before")


def running(rows: DataFrame, keys: list[str], values: dict[str, Running]) -> DataFrame:
    """Rows that have ``part`` and ``place`` (as from :func:`spread`), with running values along each group of equal keys."""
    along = Window.partitionBy(*keys, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumns({f"scan_{n}": v.rows.over(along) for n, v in values.items()})
    ends = here.groupBy(*keys, "part").agg(F.max_by(F.struct(*[f"scan_{n}" for n in values]), "place").alias("scan_end"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    gathered = {f"scan_past_{n}": v.parts(F.col(f"scan_end.scan_{n}")).over(earlier) for n, v in values.items()}
    past = ends.withColumns(gathered | {"scan_first": F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy("part")).isNull()})
    past = past.where("NOT scan_first").drop("scan_end", "scan_first").withColumnsRenamed({c: f"scan_key_{c}" for c in [*keys, "part"]})
    same = F.lit(True)
    for c in [*keys, "part"]:
        same = same & F.col(c).eqNullSafe(F.col(f"scan_key_{c}"))
    joined = here.join(past, same, "left")
    out = joined.withColumns({n: v.both(F.col(f"scan_past_{n}"), F.col(f"scan_{n}")) for n, v in values.items()})
    return out.drop(*[c for c in out.columns if c.startswith("scan_")])
