"""Benchmark decontamination by spaced-seed hashing.

A mask such as 11011 reads the words of a window at its ones and ignores those at its zeros, so a hit
survives a substitution at an ignored place. The seeds of the benchmark items are joined with the
seeds of the documents on their hash; a hit fixes an alignment (diagonal) of item and document; along
it, words are compared one by one and the longest stretch in which at least ``similarity`` of the
words agree is reported if it has ``least_words`` words, or that share of the item's words.

Long items are read by MASKS, items of up to SHORT_ITEM words by SHORT_MASKS, and items of fewer than
four words as a whole. A test goes through all patterns of equal and unequal words: at the default
similarity each pattern that is to be reported has a hit, for items of any length.

Seeds that repeat at places one after the other (a word said over and over) are joined as one stretch
with its range of diagonals, and windows of a document that read alike are compared with an item once.

Two bitmaps of fixed size keep the shuffles small, with no false negatives: one of the benchmark's
seed hashes, so that only document seeds that may hit are shuffled; one of the documents with hits,
so that only their texts are read and moved again. If they fill up, more rows move, nothing is lost.

Cases: words are runs of letters and digits in lower case; null texts and texts without words have no
seeds and are never reported, nor found; texts of any length are read whole, in blocks; equal rows are
reported once for each (key, text); items with equal texts are reported each; each
alignment has one stretch (its first longest); of those of a document and item, the one with most
equal words, then most words, then the first is given; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, free_name, slices, stored, text_or_empty
from .words import BASE, hashed_words, letters_and_digits, mixed

#: The places that a seed reads, in long and in short items.
MASKS = ("11111", "111101", "1101011", "110010011")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
SHORT_ITEM = 12
SIMILARITY = 0.8
#: Words that a reported stretch has at least; shorter items must be covered by ``similarity`` of their words.
LEAST_WORDS = 16
BITS = 24
#: Diagonals of a document in one row: those that begin in a stretch of 2^16 words. The text is there once for each such row.
LINE_BITS = 16
#: Diagonals that are looked at together.
DIAGONALS = 1 << 18


def masks_for(n_words: int) -> tuple[str, ...]:
    """The masks that read an item of so many words."""
    if n_words > SHORT_ITEM:
        return MASKS
    return SHORT_MASKS if n_words > 3 else ("1" * n_words,) * (n_words > 0)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of the words that the mask reads, by its first word."""
    n = max(len(words) - len(mask) + 1, 0)
    h = np.full(n, int(mask, 2), np.uint64)
    for at in (i for i, c in enumerate(mask) if c == "1"):
        h = mixed(h ^ words[at : at + n])
    return h


def stretches(group: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The numbers of rows that begin a stretch of equal hashes at places that follow each other, in one group; and one past the last."""
    new = (np.diff(group) != 0) | (np.diff(at) != 1) | (hashes[1:] != hashes[:-1])
    return np.concatenate([[0], np.nonzero(new)[0] + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)


def best_stretch(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """Start and end of the (first) longest stretch with True at both ends and a share of at least ``similarity`` True; (0, 0) if none."""
    at = np.nonzero(same)[0]
    if not len(at):
        return 0, 0
    prefix = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - similarity, -similarity))])
    low = np.minimum.accumulate(prefix[at])
    # for each end, the first start whose prefix is not above its own
    starts = at[np.searchsorted(-low, -(prefix[at + 1] + 1e-9))]
    longest = int(np.argmax(at - starts))
    return int(starts[longest]), int(at[longest]) + 1


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """2^BITS bits, set at the hashes' leading bits; 2 MB at any size of the input."""
    place = F.shiftrightunsigned(column, 64 - BITS)
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - BITS}) & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(2 ** (BITS - 6), np.int64)
    found = words.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def may_have(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def _item_seeds(items: DataFrame) -> DataFrame:
    """item, first, last, hash, n_words, mask: all seeds of the items, places with equal seeds that follow each other as one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            index, first, last, hashes, size, masks = [], [], [], [], [], []
            words, counts = hashed_words(batch.column(1).to_pylist(), letters_and_digits())
            for i, (own, n) in enumerate(zip(np.split(words, np.cumsum(counts)[:-1]), counts.tolist(), strict=True)):
                for mask in masks_for(n):
                    h = seeds(own, mask)
                    at = stretches(np.zeros(len(h)), np.arange(len(h)), h)
                    index.append(np.full(len(at) - 1, i))
                    first.append(at[:-1])
                    last.append(at[1:] - 1)
                    hashes.append(h[at[:-1]])
                    size.append(np.full(len(at) - 1, n))
                    masks += [mask] * (len(at) - 1)
            if masks:
                taken = batch.column(0).take(pa.array(np.concatenate(index)))
                hashed = pa.array(np.concatenate(hashes).view(np.int64))
                places = [pa.array(np.concatenate(x)) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([taken, *places, hashed, pa.array(np.concatenate(size)), pa.array(masks)], ["item", "first", "last", "hash", "n_words", "mask"])

    kind = items.schema["item"].dataType.simpleString()
    return items.select("item", "text").mapInArrow(cut, f"item {kind}, first long, last long, hash long, n_words long, mask string")


def _text_seeds(texts: DataFrame, masks: list[str], bits: np.ndarray) -> DataFrame:
    """key, text_hash, doc_first, doc_last, hash: the seeds of the texts that may be seeds of an item, in stretches as those of items."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)  # 2 MB, as BITS is fixed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, counts = hashed_words(batch.column(2).to_pylist(), letters_and_digits())
            ends = np.cumsum(counts)
            for mask in masks:
                hashes = seeds(words, mask)
                at = np.nonzero(may_have(sent.value, hashes))[0]
                text = np.searchsorted(ends, at, "right")
                inside = at + len(mask) <= ends[text]
                at, text = at[inside], text[inside]
                if len(at):
                    pos, found = at - (ends - counts)[text], hashes[at]
                    begin = stretches(text, pos, found)
                    first, last = begin[:-1], begin[1:] - 1
                    taken = batch.select([0, 1]).take(pa.array(text[first]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(pos[first]), pa.array(pos[last]), pa.array(found[first].view(np.int64))], ["key", "text_hash", "doc_first", "doc_last", "hash"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text_hash", "text").mapInArrow(cut, f"key {kind}, text_hash long, doc_first long, doc_last long, hash long")


def distinct_windows(words: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> Iterator[int]:
    """Of the diagonals in the ranges low to high, the first one of each window of ``size`` words that reads alike.

    Windows over the text's start or end are alike only if they are over it by as much. Diagonals are
    taken DIAGONALS at a time, so a window may come once for each such piece.
    """
    spread = np.full(len(words) + 1, BASE, np.uint64)
    spread[0] = 1
    forth = np.cumprod(spread)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * forth[:-1])])
    order = np.argsort(low, kind="stable")
    done = -(1 << 62)
    for a, b in zip(low[order].tolist(), high[order].tolist(), strict=True):
        for begin in range(max(a, done + 1), b + 1, DIAGONALS):
            line = np.arange(begin, min(begin + DIAGONALS, b + 1))
            start, end = np.clip(line, 0, len(words)), np.clip(line + size, 0, len(words))
            # both sides times the same power, so that equal words have equal sums wherever they stand
            value = (total[end] - total[start]) * forth[len(words) - start]
            at = np.unique(np.stack([value, (start - line).astype(np.uint64), (end - start).astype(np.uint64)]), axis=1, return_index=True)[1]
            yield from line[np.sort(at)].tolist()
        done = max(done, b)


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, text_hash, item, start_word, n_words, n_same, item_words: the longest overlap of each document and item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item"), text_or_empty(item_text).alias("text"))
    texts = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    item_seeds = stored(_item_seeds(items), "item-seeds")
    masks = sorted(r["mask"] for r in item_seeds.select("mask").distinct().collect())  # of the eleven that there are
    hits = _text_seeds(texts, masks, bitmap(item_seeds, "hash")).join(item_seeds.drop("mask"), "hash")
    ranges = [(F.col("doc_first") - F.col("last")).alias("low"), (F.col("doc_last") - F.col("first")).alias("high")]
    lines = stored(hits.groupBy("key", "text_hash", "item", *ranges).agg(F.max("n_words").alias("item_words")), "diagonals")

    named = spark.sparkContext.broadcast(bitmap(lines.select(F.xxhash64("text_hash").alias("name")), "name"))
    again = texts.withColumn("name", F.xxhash64("text_hash"))

    def with_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = may_have(named.value, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.select([0, 1, 2]).filter(pa.array(on))

    kind = texts.schema["key"].dataType.simpleString()
    bodies = again.select("key", "text", "text_hash", "name").mapInArrow(with_hits, f"key {kind}, text string, text_hash long").dropDuplicates(["key", "text_hash"])
    by_doc = lines.groupBy("key", "text_hash", F.shiftright("low", LINE_BITS)).agg(F.collect_list(F.struct("item", "low", "high", "item_words")).alias("lines"))
    matched = by_doc.withColumnsRenamed({"key": "k", "text_hash": "h"}).join(bodies, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("text_hash")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, counts = hashed_words(batch.column(1).to_pylist(), letters_and_digits())
            named = batch.select([0, 2])
            for i, own in enumerate(np.split(words, np.cumsum(counts)[:-1])):
                found = batch.column(3)[i].values
                of = {name: found.field(name) for name in ("item", "low", "high", "item_words")}
                places: dict = {}
                for at, name in enumerate(of["item"].to_pylist()):
                    places.setdefault(name, []).append(at)
                low, high, sizes = (of[c].to_numpy() for c in ("low", "high", "item_words"))
                held, cut, size = [], [], 0
                for name, at in places.items():
                    n = int(sizes[at].max())
                    for a in distinct_windows(own, low[at], high[at], n):
                        held.append((name, a))
                        cut.append(np.concatenate([np.zeros(max(0, -a), np.uint64), own[max(0, a) : a + n]]).tobytes())
                        size += len(cut[-1])
                        if size >= SLICE_BYTES:
                            yield given(named, i, held, cut)
                            held, cut, size = [], [], 0
                if held:
                    yield given(named, i, held, cut)

    def given(named: pa.RecordBatch, i: int, held: list[tuple], cut: list[bytes]) -> pa.RecordBatch:
        own = named.take(pa.array([i] * len(held)))
        item_of, diagonals = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(item_of, item_type), pa.array(diagonals, pa.int64()), pa.array(cut, pa.binary())], ["key", "text_hash", "item", "diagonal", "words"])

    item_kind = items.schema["item"].dataType.simpleString()
    item_type = pa.schema(spark.createDataFrame([], f"item {item_kind}").toArrow().schema).field("item").type
    pieces = matched.select("key", "text", "text_hash", "lines").mapInArrow(windows, f"key {kind}, text_hash long, item {item_kind}, diagonal long, words binary")
    pairs = pieces.join(items.withColumnsRenamed({"item": "i", "text": "item_text"}), F.col("item").eqNullSafe(F.col("i"))).select("key", "text_hash", "item", "diagonal", "words", "item_text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "item_text"):
            bodies = batch.column(5).to_pylist()
            known = {body: i for i, body in enumerate(dict.fromkeys(bodies))}
            words, counts = hashed_words(list(known), letters_and_digits())
            of_item = np.split(words, np.cumsum(counts)[:-1])
            index, start, size, same_n, of = [], [], [], [], []
            for i, (diagonal, own, body) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), bodies, strict=True)):
                theirs, ours = of_item[known[body]], np.frombuffer(own, np.uint64)
                same = np.zeros(len(theirs), bool)
                n = min(len(ours), len(theirs))
                same[:n] = ours[:n] == theirs[:n]
                a, b = best_stretch(same, similarity)
                if b - a >= min(least_words, len(theirs) * similarity) and b > a:
                    index.append(i)
                    start.append(diagonal + a)
                    size.append(b - a)
                    same_n.append(int(same[a:b].sum()))
                    of.append(len(theirs))
            if index:
                taken = batch.select([0, 1, 2]).take(pa.array(index))
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x, pa.int64()) for x in (start, size, same_n, of))], ["key", "text_hash", "item", "start_word", "n_words", "n_same", "item_words"])

    checked = pairs.mapInArrow(compared, f"key {kind}, text_hash long, item {item_kind}, start_word long, n_words long, n_same long, item_words long")
    best = checked.groupBy("key", "text_hash", "item").agg(F.max(F.struct("n_same", F.col("n_words"), (-F.col("start_word")).alias("back"), "item_words")).alias("best"))
    return best.select(F.col("key").alias(key), "text_hash", F.col("item").alias(item), (-F.col("best.back")).alias("start_word"), "best.n_words", "best.n_same", "best.item_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those that overlap an item."""
    mark, name = free_name(docs, "found_key"), free_name(docs, "found_hash")
    found = find_contamination(docs, benchmark, key, text, **options).select(F.col(key).alias(mark), F.col("text_hash").alias(name)).distinct()
    same = F.col(key).eqNullSafe(F.col(mark)) & (F.xxhash64(text_or_empty(text)) == F.col(name))
    return docs.join(stored(found, "contaminated"), same, "left_anti")
