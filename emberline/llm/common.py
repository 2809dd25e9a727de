"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.store import shared_path as shared_dir
from emberline.operators.store import written as stored

__all__ = ["FILTER_BITS", "SLICE_BYTES", "free_name", "held_out", "may_be_in", "possibly_in", "shared_dir", "slices", "stored", "table", "text_or_empty"]

#: Bytes of text that a task holds as Python or numpy objects at one time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str | list[str], limit: int = SLICE_BYTES, most_rows: int = 1024, memory: dict | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column`` (one or several) and ``most_rows`` rows; one long text is a batch of its own.

    ``memory`` is a dictionary that the operator fills on the way: it is emptied when the task ends,
    as workers serve all stages in turn.
    """
    try:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ([column] if isinstance(column, str) else column)]
            sizes = [pa.compute.fill_null(pa.compute.binary_length(c), 0).to_pylist() for c in columns]
            lengths = [sum(row) for row in zip(*sizes, strict=True)]
            start = held = 0
            for i, n in enumerate(lengths):
                if i > start and (held + n > limit or i - start >= most_rows):
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += n
            if start < len(lengths):
                yield batch.slice(start)
    finally:
        if memory is not None:
            memory.clear()


#: Bits of a filter by hash: 2^24, or 262,144 words of 64 (4 MB as rows), at any size of the input.
FILTER_BITS = 24


def _filter(wanted: DataFrame, hashes: str, word: str, bits: str) -> DataFrame:
    return wanted.groupBy(F.shiftright(F.shiftrightunsigned(hashes, 64 - FILTER_BITS), 6).alias(word)).agg(F.bit_or(_bit(hashes)).alias(bits))


def _bit(hashes: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({hashes}, {64 - FILTER_BITS}) & 63 AS INT))")


def possibly_in(rows: DataFrame, hashes: str, wanted: DataFrame, wanted_hashes: str, mark: str) -> DataFrame:
    """All rows, with ``mark``: whether the hash may be among ``wanted``. True for all that are, and by chance for some that aren't."""
    word, bits = free_name(rows, "filter_word"), free_name(rows, "filter_bits")
    held = F.broadcast(_filter(wanted, wanted_hashes, word, bits))  # FILTER_BITS bounds it
    joined = rows.join(held, F.shiftright(F.shiftrightunsigned(hashes, 64 - FILTER_BITS), 6) == F.col(word), "left")
    return joined.withColumn(mark, F.coalesce(F.col(bits).bitwiseAND(_bit(hashes)) != 0, F.lit(False))).drop(word, bits)


def may_be_in(rows: DataFrame, hashes: str, wanted: DataFrame, wanted_hashes: str) -> DataFrame:
    """The rows whose hash may be among ``wanted``: all that are, and by chance some that aren't.

    It saves a shuffle of rows that have no partner. With many wanted hashes more rows come through.
    """
    word, bits = free_name(rows, "filter_word"), free_name(rows, "filter_bits")
    held = F.broadcast(_filter(wanted, wanted_hashes, word, bits))  # FILTER_BITS bounds it
    marked = rows.join(held, F.shiftright(F.shiftrightunsigned(hashes, 64 - FILTER_BITS), 6) == F.col(word))
    return marked.where(F.col(bits).bitwiseAND(_bit(hashes)) != 0).drop(word, bits)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the id's text leaves ``fold``; rows without an id count as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0)) == fold
