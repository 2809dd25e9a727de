"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text: first by the first HEAD bytes, then
each group that is left by the next GROWTH times as many, and so on. A document alone in its group is
done, and a group whose texts have ended is a class of equal texts. Bytes are compared as they are, so
equality rests on no digest. Digits get longer on the way, so a text of a megabyte takes six levels.

The heads of all documents are counted first. Only documents whose head may be shared (a bitmap of fixed
size tells, with false positives and no misses) take their text along; the others are singletons. A level
counts its groups with partial sums and joins them back to the rows, where adaptive execution splits the
rows of a large group over tasks.

Cases: null texts count as empty; texts are equal when they are so after each run of ASCII white space
became one space; of equal texts the row with the smallest id stays (rows without id last; of rows with
equal ids too, any one); texts of any length are read whole; an empty table gives no rows; further columns are
not read by :func:`classes` and kept by :func:`keep_first`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, possibly_in, stored, text_or_empty

#: Fixed value: the runs that become one space.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of the first digit, and how many times longer each next one is.
HEAD, GROWTH = 32, 8


def normalised(text: str | Column) -> Column:
    """The text's bytes after each run of white space became one space."""
    return F.regexp_replace(text_or_empty(text), BLANKS, " ").cast("binary")


def _split(active: DataFrame, width: int) -> DataFrame:
    """One level: the rows that are not alone, with their new group, what is left of their text, and whether it has ended."""
    cut = active.select("row", "key", "grp", F.substring("body", 1, width).alias("digit"), F.expr(f"substring(body, {width + 1})").alias("rest"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    groups = cut.groupBy("grp", "digit").agg(F.min("row").alias("to"), F.count("*").alias("n"), first.alias("first")).where("n > 1")
    shared = cut.join(groups, ["grp", "digit"])
    return shared.select("row", "key", F.col("to").alias("grp"), F.col("rest").alias("body"), "n", "first", (F.octet_length("digit") < width).alias("ended"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD, growth: int = GROWTH) -> DataFrame:
    """key, keep (id of the row that stays), size, kept, sha256 of the normalised text: one row for each document."""
    bodies = docs.select(F.col(key).alias("key"), normalised(text).alias("body"))
    heads = bodies.select(F.substring("body", 1, head).alias("head"))
    shared = heads.groupBy("head").count().where("count > 1").select(F.xxhash64("head").alias("head_hash"))
    rows = bodies.withColumns({"row": F.monotonically_increasing_id(), "head_hash": F.xxhash64(F.substring("body", 1, head))})
    marked = possibly_in(rows, "head_hash", shared, "head_hash", "contested")
    whole = marked.select("row", "key", F.sha2("body", 256).alias("sha256"), "contested", F.when(F.col("contested"), F.col("body")).alias("body"))
    documents = stored(whole, "radix-documents")

    active, width, ended = documents.where("contested").withColumn("grp", F.lit(0).cast("long")), head, []
    while True:
        level = stored(_split(active, width), "radix-level")
        ended.append(level.where("ended").select("row", "n", "first"))
        active, width = level.where("NOT ended"), width * growth
        if active.isEmpty():
            break

    alone = documents.where("NOT contested").select("key", F.col("key").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha256")
    found = documents.where("contested").select("row", "key", "sha256").join(reduce(DataFrame.union, ended), "row", "left")
    size = F.coalesce("n", F.lit(1).cast("long"))
    keep = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("first.key"))
    stays = F.col("n").isNull() | (F.col("first.row") == F.col("row"))
    return alone.unionByName(found.select("key", keep.alias("keep"), size.alias("size"), stays.alias("kept"), "sha256"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that equal one with a smaller id; of equal rows one stays."""
    mark = free_name(docs, "radix_key")
    none, at = F.col(key).isNull().alias("none"), F.monotonically_increasing_id().alias("at")
    rows = stored(docs.withColumn(mark, F.struct(none, F.col(key).alias("id"), at)), "radix-input")
    kept = classes(rows.select(F.col(mark).alias("key"), F.col(text).alias("text")), "key", "text").where("kept")
    return rows.join(kept.select(F.col("key.at").alias("radix_at")), F.col(mark)["at"] == F.col("radix_at"), "left_semi").drop(mark)
