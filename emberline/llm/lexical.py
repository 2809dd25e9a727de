"""Ranked lexical search through bit-sliced Bloom signatures.

The index holds documents in blocks. A document's signature is a Bloom filter of its terms, entered once
for each step of LEVELS that the term's number of occurrences reaches. A block keeps its signatures by
bit: one row of bits over its documents for each place of the filter. To look up a term, the rows of its
places are combined with "and": what is set overestimates which documents hold it, and how often.

A search first gives each document of each item an upper bound of its score: the sum over the item's
terms of the weight times the most that so many occurrences can bring. The documents with the highest
bounds are scored exactly; the score of the last one that would be in the result is the item's
threshold, and all documents whose bound reaches it are scored exactly on their texts. No other document
can be in the result.

Items are searched in groups of about GROUP_TERMS terms, which the driver holds and sends to the tasks;
each group reads the index, not the texts, and then the texts of the documents it has to score.

Cases: null texts and texts without terms are not documents of the collection; items without terms find
nothing; each row of the items is searched for itself; equal scores are ordered by id (rows without id
last), rows with equal ids and texts take a rank each; texts of any length are read whole, piece by
piece; a long text has a block of few documents; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import may_be_in, slices, stored, text_or_empty
from .decontaminate import bitmap, may_have
from .words import mixed

#: Bytes of terms as they are, A to Z in lower case, all others as blanks. Bytes from 128 on belong to letters of other alphabets.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed values of the score: most documents of an item; what a document's length weighs against a plain one's, in hundredths.
TOP, LENGTH_SHARE = 50, 50
SCALE, PER_OCCURRENCE, PER_LENGTH = 1_000_000_000, 1000, 20
#: Occurrences that are told apart in a signature: powers of two and the middles between them.
LEVELS = np.array(sorted([1 << i for i in range(31)] + [3 << i for i in range(29)]), np.int64)
#: Places of a signature for each entry, and places that an entry sets.
PLACES, PROBES = 12, 3
#: Documents of a block, and bits that a block holds at most, but for one document.
BLOCK_DOCS, BLOCK_BITS = 256, 1 << 25
#: Documents of an item that are scored to find its threshold.
FIRST = 100
#: Distinct terms of the items that are searched at one time, on average.
GROUP_TERMS = 1 << 18
PIECE = 1 << 20


def counted(text: str | None) -> Counter:
    """How often each term occurs in the whole text; terms are bytes of UTF-8."""
    body = (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    found, at = Counter(), 0
    while at < len(body):
        end = body.find(b" ", at + PIECE)
        end = len(body) if end < 0 else end
        found.update(body[at:end].split())
        at = end
    return found


def hashed(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def entries(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """What a term at a level is entered as."""
    return mixed(hashes + np.uint64(0x9E3779B97F4A7C15) * np.atleast_1d(np.asarray(level, np.uint64)))


def places(entry: np.ndarray, width: int) -> np.ndarray:
    """PROBES rows: the places of entries in filters of ``width`` bits."""
    low, high = entry & np.uint64(0xFFFFFFFF), (entry >> np.uint64(32)) | np.uint64(1)
    return np.stack([((low + np.uint64(i) * high) % np.uint64(width)).astype(np.int64) for i in range(PROBES)])


def sliced(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The filters' width and their bits, place by place, of documents given as (term hashes, occurrences)."""
    reached = [np.searchsorted(LEVELS, tf, "right") for _, tf in docs]
    sizes = [int(r.sum()) for r in reached]
    width = -(-max(sizes) * PLACES // 64) * 64
    bits = np.zeros((width, len(docs)), bool)
    for i, ((hashes, _), r, n) in enumerate(zip(docs, reached, sizes, strict=True)):
        level = np.arange(n) - np.repeat(np.cumsum(r) - r, r)
        bits[places(entries(np.repeat(hashes, r), level), width), i] = True
    return width, np.packbits(bits, axis=1)


def blocks_of(sizes: list[int]) -> Iterator[list[int]]:
    """Documents of like size together, so that one width fits all: those of a block differ by less than twice."""
    block: list[int] = []
    for i in sorted((i for i, n in enumerate(sizes) if n), key=sizes.__getitem__):
        full = block and (len(block) == BLOCK_DOCS or sizes[i].bit_length() != sizes[block[0]].bit_length() or (len(block) + 1) * sizes[i] * PLACES > BLOCK_BITS)
        if full:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def build_index(docs: DataFrame, asked: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each block (a stored table): keys, text_hashes, n, most, width, bits; and in how many of its documents the asked terms are.

    ``asked`` is a bitmap of the hashes of terms whose frequencies are wanted; other terms' may be there too.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sent = docs.sparkSession.sparkContext.broadcast(asked)  # 2 MB

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20, 2048):
            signed, sizes, held = [], [], []
            for text in batch.column(2):
                found = counted(text.as_py())
                hashes, tf = hashed(list(found)), np.fromiter(found.values(), np.int64, len(found))
                signed.append((hashes, tf))
                sizes.append(int(np.searchsorted(LEVELS, tf, "right").sum()))
                wanted = may_have(sent.value, hashes)
                held.append([t for t, on in zip(found, wanted, strict=True) if on] if wanted.any() else [])
            for block in blocks_of(sizes):
                width, bits = sliced([signed[i] for i in block])
                own = batch.take(pa.array(block))
                n, most = ([int(f(signed[i][1])) for i in block] for f in (np.sum, np.max))
                frequency = Counter(t for i in block for t in held[i])
                columns = [[own.column(0).to_pylist()], [own.column(1).to_pylist()], [n], [most], [width], [bits.tobytes()], [list(frequency)], [list(frequency.values())]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    kind = rows.schema["key"].dataType
    names = ["keys", "text_hashes", "n", "most", "width", "bits", "terms", "frequencies"]
    longs = pa.list_(pa.int64())
    key_type = docs.sparkSession.createDataFrame([], f"k {kind.simpleString()}").toArrow().schema.field(0).type
    types = [pa.list_(key_type), longs, longs, longs, pa.int64(), pa.binary(), pa.list_(pa.binary()), longs]
    schema = f"keys array<{kind.simpleString()}>, text_hashes array<long>, n array<long>, most array<long>, width long, bits binary, terms array<binary>, frequencies array<long>"
    return stored(rows.select("key", "text_hash", "text").mapInArrow(built, schema), "signatures")


@dataclass
class Items:
    """A group of items as the tasks use it: distinct terms with weights; the items' terms, item after item."""

    terms: list[bytes]
    hashes: np.ndarray
    weights: np.ndarray
    numbers: np.ndarray
    starts: np.ndarray
    term_of: np.ndarray
    docs: int
    words: int

    def length(self, n: np.ndarray) -> np.ndarray:
        return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * self.docs) // self.words


def gain(tf: np.ndarray | int, m: np.ndarray | int):
    """What a weight of one brings with so many occurrences."""
    return (SCALE * tf) // (PER_OCCURRENCE * tf + PER_LENGTH * m)


def bounds(items: Items, n: np.ndarray, most: np.ndarray, width: int, bits: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores: a row for each item, a column for each document of a block."""
    docs = len(n)
    m = items.length(n)
    reached = np.zeros((len(items.terms), docs), np.uint8)
    alive, before = np.arange(len(items.terms)), None
    for level in range(len(LEVELS)):
        at = places(entries(items.hashes[alive], level), width)
        on = bits[at[0]] & bits[at[1]] & bits[at[2]]
        on = on if before is None else on & before
        some = on.any(axis=1)
        alive, before = alive[some], on[some]
        if not len(alive):
            break
        reached[alive] += np.unpackbits(before, axis=1, count=docs)
    # with c levels reached there are fewer occurrences than the next level has
    steps = int(reached.max(initial=0)) + 1
    table = np.zeros((steps, docs), np.int64)
    for c in range(1, steps):
        table[c] = gain(np.minimum(LEVELS[c] - 1, most), m)
    there = np.nonzero(reached.any(axis=1))[0]
    value = np.take_along_axis(table, reached[there].astype(np.int64), 0) * items.weights[there][:, None]
    row = np.full(len(items.terms), -1)
    row[there] = np.arange(len(there))
    pairs = row[items.term_of]
    item = np.repeat(np.arange(len(items.numbers)), np.diff(items.starts))[pairs >= 0]
    pairs = pairs[pairs >= 0]
    out = np.zeros((len(items.numbers), docs), np.int64)
    if len(pairs):
        first = np.nonzero(np.diff(item, prepend=-1))[0]
        out[item[first]] = np.add.reduceat(value[pairs], first, axis=0)
    return out


def _bounded(index: DataFrame, items: Items, floor: np.ndarray | None) -> DataFrame:
    """item, key, text_hash, bound: all documents whose bound reaches the item's floor; without floors, in each task those that may be among its FIRST highest."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((items, floor))  # GROUP_TERMS bounds it
    kind = index.schema["keys"].dataType.elementType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = sent.value
        best = np.zeros((len(items.numbers), FIRST), np.int64)
        for batch in slices(batches, "bits", 8 << 20):
            for i in range(len(batch)):
                keys, hashes, n, most = (batch.column(c)[i].values for c in range(4))
                width, bits = batch.column(4)[i].as_py(), np.frombuffer(batch.column(5)[i].as_buffer(), np.uint8)
                bound = bounds(items, n.to_numpy(), most.to_numpy(), width, bits.reshape(width, -1))
                if floor is None:
                    on = (bound > 0) & (bound >= best[:, :1])
                    best = np.partition(np.concatenate([best, bound], axis=1), bound.shape[1], axis=1)[:, -FIRST:]
                    best.sort(axis=1)
                else:
                    on = bound >= floor[:, None]
                item, doc = np.nonzero(on)
                if len(item):
                    taken = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(items.numbers[item]), keys.take(taken), hashes.take(taken), pa.array(bound[item, doc])], ["item", "key", "text_hash", "bound"])

    return index.select("keys", "text_hashes", "n", "most", "width", "bits").mapInArrow(found, f"item long, key {kind}, text_hash long, bound long")


def _scored(pairs: DataFrame, docs: DataFrame, items: Items) -> DataFrame:
    """item, key, copies, score: the exact scores of pairs (item, key, text_hash), read from the whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    named = pairs.groupBy("item", "key", "text_hash").agg(F.count("*").alias("copies"))
    # at most as many entries as the group has items
    by_text = stored(named.groupBy("key", "text_hash").agg(F.collect_list(F.struct("item", "copies")).alias("asked")), "asked")
    texts = may_be_in(docs, "text_hash", by_text, "text_hash").dropDuplicates(["key", "text_hash"])
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h"))
    joined = texts.join(by_text.withColumnsRenamed({"key": "k", "text_hash": "h"}), same).select("key", "text", "asked")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        place = {int(x): i for i, x in enumerate(items.numbers)}
        for batch in slices(batches, "text"):
            at, item, copies, score = [], [], [], []
            for i, (text, asked) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                found = counted(text.as_py())
                tf = np.fromiter((found[t] for t in items.terms), np.int64, len(items.terms)) if len(asked) > 64 else None
                m = int(items.length(np.int64(found.total())))
                for one in asked.as_py():
                    j = place[one["item"]]
                    own = items.term_of[items.starts[j] : items.starts[j + 1]]
                    occurrences = tf[own] if tf is not None else np.fromiter((found[items.terms[t]] for t in own), np.int64, len(own))
                    at.append(i)
                    item.append(one["item"])
                    copies.append(one["copies"])
                    score.append(int((items.weights[own] * gain(occurrences, m)).sum()))
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), batch.column(0).take(pa.array(at)), pa.array(copies, pa.int64()), pa.array(score, pa.int64())], ["item", "key", "copies", "score"])

    kind = docs.schema["key"].dataType.simpleString()
    return joined.mapInArrow(scores, f"item long, key {kind}, copies long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """The items with their number (item) and distinct terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            terms = pa.array([list(counted(t.as_py())) for t in batch.column(2)], pa.list_(pa.binary()))
            hashes = pa.array([hashed(t).view(np.int64) for t in terms.to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, hashes], ["item", "id", "terms", "hashes"])

    kind = items.schema["id"].dataType.simpleString()
    return items.select("item", "id", "text").mapInArrow(cut, f"item long, id {kind}, terms array<binary>, hashes array<long>")


def _group(rows: list, docs: int, words: int) -> Items:
    """From rows of (item, [(term, frequency)])."""
    frequency = {bytes(t): f for r in rows for t, f in r["held"]}
    place = {t: i for i, t in enumerate(frequency)}
    weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * f + 1))) for f in frequency.values()]
    sizes = [len(r["held"]) for r in rows]
    term_of = np.array([place[bytes(t)] for r in rows for t, _ in r["held"]], np.int64)
    return Items(list(frequency), hashed(list(frequency)), np.array(weights, np.int64), np.array([r["item"] for r in rows], np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), term_of, docs, words)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item, rank, key, score: the ``top`` highest-scoring documents of each item."""
    texts = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item).alias("id"), text_or_empty(item_text).alias("text"))
    asked = stored(_item_terms(numbered), "item-terms").where(F.size("terms") > 0)
    terms = asked.select("item", F.explode(F.arrays_zip("terms", "hashes")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.hashes").alias("hash"))
    index = build_index(docs, bitmap(terms, "hash"), key, text)
    total = index.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    per_term = index.select(F.explode(F.arrays_zip("terms", "frequencies")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.frequencies").alias("df"))
    # terms in no document bring nothing; items without other terms find nothing
    held = terms.join(per_term, "term").groupBy("item").agg(F.collect_list(F.struct("term", "df")).alias("held"))
    groups = max(1, -(-terms.count() // group_terms))
    grouped = stored(held.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups))), "item-groups")

    order = [F.col("score").desc(), F.col("key").isNull(), F.col("key").asc()]
    ranked = []
    for g in range(groups):
        rows = grouped.where(F.col("group") == g).orderBy("item").collect()
        if not rows:
            continue
        group = _group(rows, total[0], total[1])
        highest = Window.partitionBy("item").orderBy(F.col("bound").desc())
        first = _bounded(index, group, None).withColumn("place", F.row_number().over(highest)).where(f"place <= {max(FIRST, top)}")
        exact = _scored(first.drop("place", "bound"), texts, group)
        last = exact.where("score > 0").select("item", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top)))).alias("copy"))
        nth = last.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))).where(f"place = {top}")
        known = {r["item"]: r["score"] for r in nth.collect()}
        floor = np.array([known.get(int(x), 1) for x in group.numbers], np.int64)
        scored = _scored(_bounded(index, group, floor).drop("bound"), texts, group).where("score > 0")
        each = scored.select("item", "key", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top)))).alias("copy"))
        place = F.row_number().over(Window.partitionBy("item").orderBy(*order, "copy"))
        ranked.append(stored(each.withColumn("rank", place).where(f"rank <= {top}").select("item", "rank", "key", "score"), "ranked"))

    ids = asked.select("item", F.col("id").alias(item))
    if not ranked:
        kinds = f"{item} {items.schema[item].dataType.simpleString()}, rank int, {key} {docs.schema[key].dataType.simpleString()}, score long"
        return docs.sparkSession.createDataFrame([], kinds)
    found = ranked[0]
    for more in ranked[1:]:
        found = found.union(more)
    return found.join(ids, "item").select(item, "rank", F.col("key").alias(key), "score")
