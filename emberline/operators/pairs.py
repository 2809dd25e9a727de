"""Pairs of rows that share a key: made where they are joined, never shuffled or written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that a task holds while the others of that key go by.
BLOCK = 16_384


def pairs_within(rows: DataFrame, keys: list[str], by: list[str], where: str) -> DataFrame:
    """keys, x, y: the pairs of rows (structs of their other columns) with equal keys that ``where`` lets through.

    Rows of a key are dealt into blocks by a hash of ``by``; each block meets all rows of the key. So what is
    shuffled is linear in the rows, but for keys of more than BLOCK rows, which are sent once for each block;
    a task holds one block, and the blocks of a key lie in several tasks.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    body = [c for c in rows.columns if c not in keys]
    sized = rows.join(sizes, keys)
    all_ = sized.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.struct(*body).alias("x"))
    dealt = sized.select(*keys, F.pmod(F.xxhash64(*by), F.col("_blocks")).cast("int").alias("_block"), F.struct(*body).alias("y"))
    # as many tasks as a shuffle has: the rows are few, but not the pairs
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = [*keys, "_block"]
    return all_.repartition(parts, *cells).join(dealt.repartition(parts, *cells), cells).where(where).drop("_block")
