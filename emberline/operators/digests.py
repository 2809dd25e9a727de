"""Digests of whole groups of values, taken in order and piece by piece."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Bytes of values that one row holds while they are hashed.
CHUNK_BYTES = 1 << 20


def streamed_sha256(rows: DataFrame, keys: list[str], value: str, name: str, separator: str = ",") -> DataFrame:
    """For each key the SHA-256 of its values, in ascending order with a separator between them.

    The rows are sorted by ranges, so that a key of any size lies over several tasks; each joins its values
    into rows of some CHUNK_BYTES. The rows of a key then go by one after the other through the task that
    hashes them, which holds no more than one of them: a digest can't be taken in parallel, but the
    values are read, sorted and joined so. Null values are left out; a key without others has no row.
    """
    plain = rows.where(F.col(value).isNotNull()).select(*keys, value)
    order = [F.col(c).asc() for c in (*keys, value)]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{k} {plain.schema[k].dataType.simpleString()}" for k in keys)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            types = [*batch.schema.types[:-1], pa.int32(), pa.int64(), pa.string()]
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            texts = [str(v) for v in batch.columns[-1].to_pylist()]
            out, start, size = [], 0, 0
            for i in range(1, len(texts) + 1):
                size += len(texts[i - 1])
                if i == len(texts) or any(c[i] != c[start] for c in columns) or size >= CHUNK_BYTES:
                    out.append((*(c[start] for c in columns), part, at, separator.join(texts[start:i])))
                    start, size, at = i, 0, at + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [*keys, "part", "at", "chunk"])

    # the parts' numbers stay what they are once they are written
    chunks = written(dealt.mapInArrow(joined, f"{kinds}, part int, at long, chunk string"), "chunks")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, types = None, None, None
        for batch in batches:
            types, out = [*batch.schema.types[:-1], pa.string()], []
            for *key, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or key != now:
                    if state is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(chunk.encode())
                else:
                    state.update((separator + chunk).encode())
            if out:
                yield given(out, types)
        if state is not None:
            yield given([(*now, state.hexdigest())], types)

    def given(out: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [*keys, name])

    grouped = chunks.repartition(*keys).sortWithinPartitions(*keys, "part", "at").select(*keys, "chunk")
    return grouped.mapInArrow(hashed, f"{kinds}, {name} string")
