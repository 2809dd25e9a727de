"""The first few of each group, found in two phases, so that no group's rows come together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_distinct(rows: DataFrame, keys: list[str], value: Column, order: Column, most: int, name: str) -> DataFrame:
    """keys, ``name``: the first ``most`` different values (null is none) of each key, in the order of their first occurrence.

    Equal values are folded first; then each task keeps ``most`` of a key before they are shuffled.
    """
    folded = rows.withColumns({"_value": value, "_at": order}).where(F.col("_value").isNotNull()).groupBy(*keys, "_value").agg(F.min("_at").alias("_at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    head = folded.withColumn("_place", place).where(F.col("_place") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_value"))), lambda x: x["_value"])
    return head.groupBy(*keys).agg(listed.alias(name))


def joined_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys of which null is one as well."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"_on_{k}" for k in keys])
