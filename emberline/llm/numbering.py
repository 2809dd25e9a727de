"""Gapless row numbers without a global sort: buckets of a hash order, bucket counts, offsets.

The order inside a group is that of the md5 of key and further columns, then the columns themselves.
Leading hex digits of the md5 are the bucket, so the order does not depend on how many buckets there
are, and rows with one key but different further columns spread over all buckets.

Cases: null keys and columns count as empty in the md5 and sort first; equal rows are interchangeable
and take neighbouring numbers, as one row of the sort; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

#: Rows that one bucket holds on average at most.
BUCKET_ROWS = 20_000


def hex_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    digits = 1
    while rows > bucket_rows * 16**digits:
        digits += 1
    return digits


def number_rows(rows: DataFrame, key: str, group: list[str], rest: list[str], out: str) -> DataFrame:
    """``group + [key] + rest`` and ``out``: 0, 1, 2, ... within the group, every input row once.

    Rows equal in all of these columns are counted before they are shuffled and unfolded after
    they are numbered, so a row that repeats millions of times is one row in the sort.
    """
    cols = [*group, key, *rest]
    digits = hex_digits(rows.count())
    hashed = rows.select(*cols).withColumn("_md5", F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *rest]])))
    hashed = hashed.withColumn("_bucket", F.substring("_md5", 1, digits)).withColumn("_part", F.substring("_md5", 1, digits // 2))
    # offsets in two levels: a window goes over the parts of a group, or the buckets of a part, some 16^(digits/2) rows each
    sizes = hashed.groupBy(*group, "_part", "_bucket").agg(F.count("*").alias("_n"))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))
    parts = parts.select(*[F.col(g).alias(f"_p_{g}") for g in group], F.col("_part").alias("_p_part"), F.coalesce(F.sum("_n").over(earlier(group, "_part")), F.lit(0)).alias("_base"))
    inside = sizes.withColumn("_inner", F.coalesce(F.sum("_n").over(earlier([*group, "_part"], "_bucket")), F.lit(0)))
    equal = lambda left, right, names: [F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}")) for c in names]
    offsets = inside.join(parts, [*equal("", "_p_", group), F.col("_part") == F.col("_p_part")])
    offsets = offsets.select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_bucket").alias("_o_bucket"), (F.col("_base") + F.col("_inner")).alias("_offset"))
    order = ["_md5", F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in rest]]
    before = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    folded = hashed.groupBy(*cols, "_md5", "_bucket").agg(F.count("*").alias("_copies"))
    placed = folded.withColumn("_before", F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    first = placed.join(offsets, [*equal("", "_o_", group), F.col("_bucket") == F.col("_o_bucket")])
    first = first.withColumn("_first", F.col("_offset") + F.col("_before"))
    return unfold(first, F.col("_copies"), "_copy").select(*cols, (F.col("_first") + F.col("_copy")).alias(out))


def unfold(df: DataFrame, times: Column, out: str, step: int = 4096) -> DataFrame:
    """Each row ``times`` times with ``out`` = 0, 1, ...; arrays hold ``step`` numbers at most times two levels."""
    n, start = free_name(df, "unfold_times"), free_name(df, "unfold_from")
    outer = df.withColumn(n, times.cast("long")).where(F.col(n) > 0).withColumn(start, F.explode(F.expr(f"sequence(0L, {n} - 1, {step}L)")))
    return outer.withColumn(out, F.explode(F.expr(f"sequence({start}, least({start} + {step - 1}, {n} - 1))"))).drop(start, n)
