"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis segments.

A payload of 8-bit samples is kept as a WAV file (44-byte header, mono, unsigned 8 bit, 8,000 samples a
second) in a binary column. Read back, it is resampled by 3/4 with a polyphase low-pass filter, cut
into half-overlapped Hann frames, and turned into log-mel energies. A frame louder than the upper
threshold opens a segment, one below the lower threshold closes it. Features are stored as Arrow IPC
streams with one row for each TENSOR_FRAMES frames: a fixed-shape tensor (TENSOR_FRAMES x MELS floats,
silence beyond the end) and its time span.

Cases: null texts are empty; an empty text is one unit of padding; a long payload is worked on in
blocks; repeated rows come out repeated; equal payloads have equal features; bytes that are not such
a WAV file raise ValueError; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, MELS, TENSOR_FRAMES = 512, 256, 16, 16
UNIT, FILL = 576, 255
FLOOR = 1e-6
#: A segment opens above, and closes below, the mean frame energy by these shares of its deviation.
OPEN, CLOSE = 0.5, -0.5
#: Frames or output samples worked on at one time.
BLOCK = 4096


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes([FILL]) * ((-len(data)) % UNIT or UNIT * (not data))


def to_wav(payload: bytes) -> bytes:
    odd = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * odd


def from_wav(data: bytes) -> bytes:
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:16] != b"WAVEfmt " or data[36:40] != b"data" or struct.unpack_from("<HHIIHH", data, 20) != (1, 1, RATE, RATE, 1, 8):
        raise ValueError("not a mono 8-bit WAV file of this rate")
    return data[44 : 44 + struct.unpack_from("<I", data, 40)[0]]


def _filter() -> np.ndarray:
    """Windowed sinc, cut off at the lower of the two half rates, UP * TAPS long."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    return (UP * cut * np.sinc(cut * n) * np.hamming(UP * TAPS)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Samples at UP/DOWN times the rate, each output by the filter phase that it needs."""
    h, n_out = _filter(), -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(TAPS + DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n_out, np.float32)
    for phase in range(UP):
        taps = h[phase * DOWN % UP :: UP][::-1]
        mine = windows[phase * DOWN // UP :: DOWN][: len(out[phase::UP])]
        target = out[phase::UP]
        for a in range(0, len(mine), BLOCK):
            target[a : a + BLOCK] = mine[a : a + BLOCK] @ taps
    return out


def _mel_bank() -> np.ndarray:
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * 2 * top / FRAME
    rise = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[None, :-1]
    fall = (edges[None, 2:] - bins[:, None]) / np.diff(edges)[None, 1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_BANK, _HANN = _mel_bank(), np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames x MELS; the end is filled with silence."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = [np.log(FLOOR + (np.abs(np.fft.rfft(frames[a : a + BLOCK] * _HANN)) ** 2 @ _BANK) / FRAME) for a in range(0, n, BLOCK)]
    return np.concatenate(out).astype(np.float32)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """First and last-but-one frames of the loud stretches."""
    energy = mel.mean(1)
    mean, spread = float(energy.mean()), float(energy.std())
    mark = np.where(energy > mean + OPEN * spread, 1, np.where(energy < mean + CLOSE * spread, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[np.maximum(last, 0)] == 1), [False]])
    edges = np.nonzero(on[1:] != on[:-1])[0]
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


SHAPE = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])
ROWS = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("log_mel", SHAPE)])


def _ms(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (RATE * UP)


def pack(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream of ROWS."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), np.log(FLOOR), np.float32)
    full[: len(mel)] = mel
    tensors = pa.ExtensionArray.from_storage(SHAPE, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR_FRAMES * MELS))
    starts = [_ms(i * TENSOR_FRAMES) for i in range(n)]
    ends = [_ms(min((i + 1) * TENSOR_FRAMES, len(mel))) for i in range(n)]
    out = io.BytesIO()
    with pa.ipc.new_stream(out, ROWS) as stream:
        stream.write_batch(pa.record_batch([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), tensors], schema=ROWS))
    return out.getvalue()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each text's bytes, padded, as a WAV file."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([to_wav(payload_of(t)) for t in texts], pa.binary())], ["key", "n_bytes", "media"])

    return rows.mapInArrow(made, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("key", key)


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, sizes and checksums of payload and file, segments (start and end in ms) and tensors (an IPC stream)."""
    rows = media.select(F.col(key).alias("key"), "n_bytes", "media")
    spans = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            out = []
            for data in batch.column(2).to_pylist():
                payload = from_wav(data)
                mel = log_mel(resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
                loud = [{"start_ms": _ms(a), "end_ms": _ms(b)} for a, b in segments(mel)]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), loud, pack(mel)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), spans, pa.binary()]
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "tensors"]
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<struct<start_ms: long, end_ms: long>>, tensors binary"
    return rows.mapInArrow(heard, schema).withColumnRenamed("key", key)


def digest(tensors: bytes, loud: list) -> str:
    """Tensors, last time, mean of each mel band to two places, and the segments."""
    found = unpack(tensors)
    values = found["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, MELS)
    bands = " ".join(f"{x:.2f}" for x in values.mean(0, dtype=np.float64))
    return f"{len(found)}x{TENSOR_FRAMES}x{MELS} {found['end_ms'][-1].as_py()}ms [{bands}] " + ",".join(f"{s['start_ms']}-{s['end_ms']}" for s in loud)


def describe(stored_features: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stored features with a readable ``feature`` string in place of the tensors and segments."""
    rows = stored_features.select(F.col(key).alias("key"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "tensors")

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tensors"):
            text = pa.array([digest(t, s) for s, t in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], text], [*batch.schema.names[:7], "feature"])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(said, schema).withColumnRenamed("key", key)
