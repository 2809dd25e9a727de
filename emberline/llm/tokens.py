"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to places.

Layout of a store (a folder):
  shard-NNNNN.bin   the ids of the shard's documents, one after the other, little-endian uint16
                    (uint32 where the vocabulary needs it), in ascending key order
  shard-NNNNN.off   uint64: where each document begins, in ids, and the shard's total at the end
  index-NNNNN.mph   for the keys whose hash falls to index part N: a minimal perfect hash and, in its
                    order, a 32-bit fingerprint, the shard, the place of the first document in it (its
                    ordinal, where its ids begin and how many they are) and the documents of the key

A key costs a probe of one index part and a seek in one shard; only keys with several documents need
the offsets file. The hash is a cascade of bit arrays: a key takes the first level at which no other
key of that level falls on its bit; its slot is the number of bits set before. Tasks write under a
name of their own and rename, so a repeated task does no harm.

Cases: null texts are empty; every document gets the end id, so an empty one has one id; null keys
sort first and can be looked up; rows with equal keys lie side by side (by text hash) and one entry
covers them all, across shards if need be; an absent key is reported as such (a wrong answer has a
chance of 2^-32); texts of any length are encoded whole; an empty table writes nothing and gives no
rows; further columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty

END_ID = 2
#: Text bytes of a shard on average. Small tables have more shards, down to LEAST_SHARD_BYTES, so that there are tasks for all cores.
SHARD_BYTES, LEAST_SHARD_BYTES = 256 << 20, 1 << 20
#: Keys in an index part on average, and parts at least.
PART_KEYS, LEAST_PARTS = 1 << 17, 64
#: Pieces that a worker remembers with their ids, in each of its two generations: 60 MB at 200 bytes each.
MEMORY_PIECES = 300_000
#: Pieces longer than this are encoded, but not remembered.
LONG_PIECE = 64
LEVELS, GAMMA = 32, 2.0
MAGIC = b"EMBMPH02"


# --- encoding

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: How a byte-level BPE of this kind cuts texts, written for texts of ASCII, Latin letters and common marks.
PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
OTHER = re.compile(rf"[^\t-\r -~¡-©«-±´¶-¸»¿-ɏ‐-‧]")
#: No piece reaches over such a place, whatever the text on its sides is.
PLAIN_CUT = re.compile(r"(?<=[!-~])(?= [!-~])")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """Ids by piece. A piece that is not held is encoded, and held if it is short.

    There are two generations: when the young one is full it becomes the old one, and pieces that are
    met again move to the young one. So frequent pieces stay, and the size is bounded.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = MEMORY_PIECES):
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or self.encode(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.most:
                self.old = self.copy()
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, which meets a frequent piece of text once.

    The library first cuts a text by a fixed pattern and then encodes the pieces by themselves. Here
    the cut is made with PIECE, and the library's model encodes the pieces that are not remembered.
    Stretches with characters of which PIECE doesn't know the class, texts with an added token, and
    all texts of a tokenizer that is not of this kind, are given to the library as they are.
    """

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        cut, model = told["pre_tokenizer"] or {}, told["model"]
        self.cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and model["type"] == "BPE"
        self.cuts = self.cuts and not (told["normalizer"] or told["truncation"] or told["padding"] or model.get("dropout"))
        self.added = [t["content"] for t in told["added_tokens"]]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        unit = [i.tobytes() for i in np.arange(size, dtype=self.dtype)]
        tokenize, letters = self.tokenizer.model.tokenize, _byte_letters()
        self.memory = Memory(lambda piece: b"".join([unit[t.id] for t in tokenize(piece.encode().decode("latin-1").translate(letters))]))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, PIECE.findall(text)))

    def _ids(self, text: str) -> bytes:
        if not self.cuts or any(token in text for token in self.added):
            return self._by_library(text)
        if not OTHER.search(text):
            return self._by_pieces(text)
        return b"".join(self._by_library(part) if OTHER.search(part) else self._by_pieces(part) for part in PLAIN_CUT.split(text))

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        last = np.array([end], self.dtype).tobytes()
        return [self._ids(text) + last for text in texts]


# --- files


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _put(uri: str, name: str, data: bytes) -> None:
    """Writes a file under a name of its own, then renames it."""
    files, root = _place(uri)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, f"{root}/{name}")


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("\0null"))


def shards_for(rows: DataFrame) -> int:
    """How many shards the texts (column text) make: by their bytes."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = min(-(-size // LEAST_SHARD_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(-(-size // SHARD_BYTES), few, 1)


def write_shards(docs: DataFrame, uri: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encodes and writes the documents; gives key, shard, ordinal, start (in the shard, in ids), n_tokens (a stored table)."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    # equal keys with equal texts may still go to several shards: the row's place in its file settles that
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(shards or shards_for(rows), *order, F.col("tie").asc()).sortWithinPartitions(*order, F.col("tie").asc())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), Encoder.of(tokenizer)
        name, mark = f"shard-{shard:05d}", uuid.uuid4().hex
        files, root = _place(uri)
        out, done, at = None, 0, 0
        for batch in slices(batches, "text"):
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/.{name}.bin-{mark}")
                offsets = files.open_output_stream(f"{root}/.{name}.off-{mark}")
            ids = encoder.encode(batch.column(1).to_pylist(), end)
            out.write(b"".join(ids))
            n = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            offsets.write(start.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(np.arange(done, done + len(n))), pa.array(start), pa.array(n)], ["key", "shard", "ordinal", "start", "n_tokens"])
            done, at = done + len(n), at + int(n.sum())
        if out is not None:
            offsets.write(np.array([at], "<u8").tobytes())
            for stream, kind in ((out, "bin"), (offsets, "off")):
                stream.close()
                files.move(f"{root}/.{name}.{kind}-{mark}", f"{root}/{name}.{kind}")

    kind = rows.schema["key"].dataType.simpleString()
    return stored(dealt.select("key", "text").mapInArrow(written, f"key {kind}, shard int, ordinal long, start long, n_tokens long"), "token-entries")


# --- minimal perfect hash


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64(2 * level + 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def build_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bit arrays by level; each key's slot; the keys (their numbers) that no level took, in slot order."""
    levels, taken_at, bit_of = [], np.full(len(h1), -1), np.zeros(len(h1), np.int64)
    left = np.arange(len(h1))
    while len(left) and len(levels) < LEVELS:
        size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
        bit = (_mixed(h1[left], h2[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(bit, minlength=size)
        levels.append(alone == 1)
        free = alone[bit] == 1
        taken_at[left[free]], bit_of[left[free]] = len(levels) - 1, bit[free]
        left = left[~free]
    slot, before = np.empty(len(h1), np.int64), 0
    for k, bits in enumerate(levels):
        mine = taken_at == k
        slot[mine] = before + np.cumsum(bits)[bit_of[mine]] - 1
        before += int(bits.sum())
    left = left[np.lexsort((h2[left], h1[left]))]
    slot[left] = before + np.arange(len(left))
    return levels, slot, left


#: What an index holds of a key, in this order, after the fingerprints.
FIELDS = {"shard": "<u4", "ordinal": "<u8", "start": "<u8", "n_tokens": "<u8", "rows": "<u8"}


def pack_index(h1: np.ndarray, h2: np.ndarray, fields: dict[str, np.ndarray]) -> bytes:
    levels, slot, left = build_hash(h1, h2)
    order = np.argsort(slot)
    head = struct.pack("<8sQQQ", MAGIC, len(h1), len(levels), len(left)) + np.array([len(b) for b in levels], "<u8").tobytes()
    bits = b"".join(np.packbits(b, bitorder="little").tobytes() for b in levels)
    rest = h1[left].astype("<u8").tobytes() + h2[left].astype("<u8").tobytes()
    held = [fields[name][order].astype(kind).tobytes() for name, kind in FIELDS.items()]
    return b"".join([head, bits, rest, (h2[order] >> np.uint64(32)).astype("<u4").tobytes(), *held])


class Index:
    """One index part, read back."""

    def __init__(self, data: bytes):
        magic, n, n_levels, n_left = struct.unpack_from("<8sQQQ", data)
        if magic != MAGIC:
            raise ValueError("not an index file")
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        sizes = take("<u8", n_levels)
        self.levels = [np.unpackbits(take("u1", int(s) // 8), bitorder="little") for s in sizes]
        self.ranks = [np.cumsum(b) for b in self.levels]
        self.before = np.concatenate([[0], np.cumsum([int(r[-1]) for r in self.ranks])]).astype(np.int64)
        self.left = dict(zip(zip(take("<u8", n_left).tolist(), take("<u8", n_left).tolist(), strict=True), range(n_left), strict=True))
        self.fingerprint = take("<u4", n)
        self.fields = {name: take(kind, n) for name, kind in FIELDS.items()}

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slots, -1 for keys that are not there."""
        slot = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for k, bits in enumerate(self.levels):
            bit = (_mixed(h1[open_], h2[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[bit] == 1
            slot[open_[hit]] = self.before[k] + self.ranks[k][bit[hit]] - 1
            open_ = open_[~hit]
        for i in open_:
            slot[i] = self.before[-1] + self.left.get((int(h1[i]), int(h2[i])), -1 - self.before[-1])
        right = slot >= 0
        right[right] = self.fingerprint[slot[right]] == (h2[right] >> np.uint64(32)).astype(np.uint32)
        return np.where(right, slot, -1)


def _parted(keys: DataFrame, parts: int) -> DataFrame:
    h1, h2 = F.xxhash64(key_text(F.col("key"))), F.xxhash64(key_text(F.col("key")), F.lit("second"))
    return keys.withColumns({"h1": h1, "h2": h2, "part": F.pmod(h1, F.lit(parts)).cast("int")})


def _u8(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def write_index(entries: DataFrame, uri: str, rows: int) -> int:
    """Writes the index parts for a table of :func:`write_shards` with so many rows; gives the number of parts."""
    place = ["shard", "ordinal", "start", "n_tokens"]
    first = entries.groupBy("key").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("rows"))
    parts = max(LEAST_PARTS, -(-rows // PART_KEYS))

    def built(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        data = pack_index(_u8(group["h1"]), _u8(group["h2"]), {name: group[name].to_numpy() for name in FIELDS})
        _put(uri, f"index-{part:05d}.mph", data)
        return pa.table({"part": pa.array([part], pa.int32()), "bytes": pa.array([len(data)], pa.int64())})

    # a part holds PART_KEYS distinct keys or fewer, but for chance, at any size of the store
    keys = _parted(first.select("key", "first.*", "rows"), parts).drop("key")
    keys.groupBy("part").applyInArrow(built, "part int, bytes long").agg(F.sum("bytes")).collect()
    return parts


def manifest(entries: DataFrame) -> np.ndarray:
    """By shard: its number, rows, ids. One line for each file of the store."""
    found = entries.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("ids")).orderBy("shard").collect()
    return np.array([tuple(r) for r in found], np.int64).reshape(-1, 3)


def locate(keys: DataFrame, uri: str, parts: int, files: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, shard, ordinal, rows, start, n_tokens: where the documents of each key lie, through the index; absent keys have shard null.

    A key whose documents reach over several shards has a line for each. ``start`` and ``n_tokens`` are those of a key's only document.
    """
    kind = keys.schema[key].dataType.simpleString()
    held = _parted(keys.select(F.col(key).alias("key")).distinct(), parts)
    place = {int(s): i for i, s in enumerate(files[:, 0])}
    names, types = ["shard", "ordinal", "rows", "start", "n_tokens"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def looked_up(group: pa.Table) -> pa.Table:
        fs, root = _place(uri)
        name = f"{root}/index-{group['part'][0].as_py():05d}.mph"
        if fs.get_file_info(name).type != pa.fs.FileType.File:  # no key is in this part
            return pa.table([group["key"], *(pa.nulls(len(group), t) for t in types)], ["key", *names])
        with fs.open_input_stream(name) as data:
            index = Index(data.read())
        slots = index.find(_u8(group["h1"]), _u8(group["h2"]))
        there = slots >= 0
        found = {n: np.where(there, index.fields[n][np.maximum(slots, 0)].astype(np.int64), -1) for n in FIELDS}
        takes, rows = [], []
        for i, (shard, ordinal, left) in enumerate(zip(found["shard"].tolist(), found["ordinal"].tolist(), found["rows"].tolist(), strict=True)):
            at, alone = place.get(shard, -1), left == 1
            while left > 0:
                here = min(left, int(files[at, 1]) - ordinal)
                takes.append(i)
                rows.append((int(files[at, 0]), ordinal, here, int(found["start"][i]) if alone else None, int(found["n_tokens"][i]) if alone else None))
                at, ordinal, left = at + 1, 0, left - here
            if left < 0:
                takes.append(i)
                rows.append((None,) * 5)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.table([group["key"].take(pa.array(takes)), *columns], ["key", *names])

    schema = f"key {kind}, shard int, ordinal long, rows long, start long, n_tokens long"
    return held.groupBy("part").applyInArrow(looked_up, schema).withColumnRenamed("key", key)


def read_ids(places: DataFrame, uri: str, files: np.ndarray, tokenizer: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """key, start, n_tokens, ids_crc32, shard, ordinal and, if asked for, ids: read from the files, one row for each document."""
    kind = places.schema[key].dataType.simpleString()
    base = dict(zip(files[:, 0].tolist(), np.concatenate([[0], np.cumsum(files[:, 2])[:-1]]).tolist() if len(files) else [], strict=True))
    names = ["key", "start", "n_tokens", "ids_crc32", "shard", "ordinal", *["ids"] * ids]
    step = 4096  # documents given out at a time

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = Encoder.of(tokenizer).dtype
        fs, root = _place(uri)
        shard, payload = None, None
        rows: list[tuple] = []

        def given(kept: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types, strict=False)], names)

        def spans(s: int, first: int, n: int, start: int | None, length: int | None) -> Iterator[tuple[int, int, int]]:
            """Ordinal, begin and end of a key's documents in a shard; of several, through the offsets file."""
            if n == 1 and start is not None:
                yield first, start, start + length
                return
            with fs.open_input_file(f"{root}/shard-{s:05d}.off") as f:
                for o in range(first, first + n, step):
                    count = min(step, first + n - o)
                    f.seek(8 * o)
                    at = np.frombuffer(f.read(8 * (count + 1)), "<u8").tolist()
                    yield from zip(range(o, o + count), at, at[1:], strict=False)

        for batch in batches:
            key_type = batch.column(0).type
            for k, s, *place in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if s != shard:
                    if payload:
                        payload.close()
                    shard, payload = s, fs.open_input_file(f"{root}/shard-{s:05d}.bin")
                for o, a, b in spans(s, *place):
                    payload.seek(a * dtype.itemsize)
                    found = np.frombuffer(payload.read((b - a) * dtype.itemsize), dtype)
                    row = (k, base[s] + a, b - a, zlib.crc32(found.astype("<u4").tobytes()), s, o)
                    rows.append((*row, found.astype(np.int32)) if ids else row)
                    if len(rows) >= step:
                        yield given(rows, key_type)
                        rows = []
            if rows:
                yield given(rows, key_type)
                rows = []
        if payload:
            payload.close()

    asked = places.where("shard IS NOT NULL").select(F.col(key).alias("key"), "shard", "ordinal", "rows", "start", "n_tokens")
    dealt = asked.repartition("shard").sortWithinPartitions("shard", "ordinal")
    schema = f"key {kind}, start long, n_tokens long, ids_crc32 long, shard int, ordinal long" + ", ids array<int>" * ids
    return dealt.mapInArrow(read, schema).withColumnRenamed("key", key)


def write_store(docs: DataFrame, uri: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID, shards: int | None = None) -> tuple[np.ndarray, int]:
    """Writes shards and index; gives the manifest and the number of index parts."""
    entries = write_shards(docs, uri, tokenizer, key, text, end, shards)
    files = manifest(entries)
    return files, write_index(entries, uri, int(files[:, 1].sum()))
