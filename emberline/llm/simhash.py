"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 16 segments; the vector of the segments' bit counts lies on an
integer grid. The Manhattan distance of two vectors is at most the Hamming distance of their
fingerprints, so all pairs within 2 bits lie within Manhattan distance 2. Two grid points are that
near exactly if they share a point at distance 1 or less, so each distinct fingerprint is put into
its own cell and its neighbours' cells (33 at most), fingerprints that share a cell are candidates,
and their Hamming distance decides.

Cells with more than MOST_IN_CELL fingerprints are not paired. All their fingerprints are linked
exactly through flipped bits instead: two fingerprints are within 2 bits exactly if both are within
1 bit of some value, and each names its 65 values, so a value has 65 fingerprints at most.

Cases: null and empty texts have no words and the fingerprint zero, linked like any other; equal
fingerprints are linked; rows without an id take part, and a component's id is its smallest id that
is not null; repeated rows come out repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.graph import components

from .common import free_name, slices, stored, text_or_empty

SEGMENTS, SEGMENT_BITS = 16, 4
MOST_IN_CELL = 64
SEED = 42
#: Words of a shingle.
WIDTH = 3
#: Hashes whose bits are counted at one time.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, ASCII letters in lower case; fewer words: of all of them; none: nothing."""
    words = (text or "").encode().lower().split()  # bytes: splits at ASCII white space only
    if not words:
        return np.empty(0, "<u8")
    digest = xxhash.xxh64_intdigest
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((digest(x, SEED) for x in runs), "<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is 1 in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[i : i + BLOCK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, fp: the fingerprint as a signed long, one row for each document."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint_of(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    return rows.mapInArrow(hashed, f"key {rows.schema['key'].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def cells(fp: str = "fp") -> Column:
    """The grid cells of a fingerprint: its own and those one step away in one segment, each packed into a long (base 8)."""
    packed = " + ".join(f"CAST(bit_count(shiftrightunsigned({fp}, {SEGMENT_BITS * s}) & {2**SEGMENT_BITS - 1}) AS BIGINT) * {1 << 3 * s}L" for s in range(SEGMENTS))
    # coordinates are -1 to 5: seven values, so sums in base 8 are never the same for two cells
    steps = ", ".join(f"{sign}{1 << 3 * s}L" for s in range(SEGMENTS) for sign in ("", "-"))
    return F.expr(f"transform(array(0L, {steps}), d -> d + {packed})")


def flips(fp: str = "fp") -> Column:
    return F.expr(f"concat(array({fp}), transform(sequence(0, 63), i -> {fp} ^ shiftleft(1L, i)))")


def near_pairs(distinct: DataFrame, max_bits: int = 2, most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (column fp) within ``max_bits`` (2 or fewer) of each other."""
    if max_bits > 2:
        raise ValueError("cells one step apart find 2 bits at most")
    placed = distinct.select("fp", F.explode(cells()).alias("cell"))
    crowd = stored(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    small = placed.join(crowd.where(F.col("n") <= most_in_cell).select("cell"), "cell")
    few = stored(small, "placed")
    other = few.select(F.col("fp").alias("b"), "cell")
    pairs = few.select(F.col("fp").alias("a"), "cell").join(other, "cell").where(f"a < b AND bit_count(a ^ b) <= {max_bits}").select("a", "b").distinct()
    crowded = placed.join(crowd.where(F.col("n") > most_in_cell).select("cell"), "cell", "left_semi").select("fp").distinct()
    if max_bits == 2:
        hubs = crowded.select("fp", F.explode(flips()).alias("hub")).groupBy("hub").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        exact = hubs.select(F.expr("array_min(fps)").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    elif max_bits == 1:
        flipped = crowded.select(F.col("fp").alias("a"), F.explode(flips()).alias("b"))
        exact = flipped.join(crowded.select(F.col("fp").alias("b")), "b").where("a < b").select("a", "b")
    else:
        exact = crowded.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    return pairs.union(exact)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, max_bits: int = 2, most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """key, fp, component (the smallest key of all documents that links reach), one row for each document."""
    prints = stored(fingerprints(docs, key, text, width).withColumnRenamed(key, "key"), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("key").alias("first_key")), "classes")
    links = stored(near_pairs(classes.select("fp"), max_bits, most_in_cell), "pairs")
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = stored(classes.join(roots, "fp").select("fp", "root", "first_key"), "roots")
    smallest = rooted.groupBy("root").agg(F.min("first_key").alias("component"))
    linked = rooted.join(smallest, "root").select("fp", "component")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first_key").alias("component"))
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, max_bits: int = 2) -> DataFrame:
    """The documents with one row of each group left: the one with the smallest key (rows without one come last), then text hash."""
    mark, name = free_name(docs, "chosen_key"), free_name(docs, "chosen_text")
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("name"))
    found = near_duplicates(docs.select(row.alias("row"), F.col(text).alias("text")), "row", "text", width, max_bits)
    chosen = found.select(F.col("component.id").alias(mark), F.col("component.name").alias(name)).distinct()
    kept = docs.join(chosen, F.col(key).eqNullSafe(F.col(mark)) & (F.xxhash64(text_or_empty(text)) == F.col(name)), "left_semi")
    return kept.dropDuplicates([key, text])
