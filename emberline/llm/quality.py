"""Quality by nearest-neighbour voting in a latent semantic space.

A document becomes a vector of hashed terms: its words, trigrams of its character classes (letters in
upper and lower case, digits, blanks, and the marks themselves), and steps of a few shares (repeated
words, repeated neighbours, upper case, marks, word length). Log counts are weighted by inverse
document frequency and projected on the leading singular vectors of a bounded labelled sample. The
sample's latent vectors, scaled to length one, go to every task; each document's exact cosines with
all of them are computed in blocks, and its NEIGHBOURS nearest vote with their similarity.

Cases: null and empty texts have no terms; they, and any document without a positive cosine, get the
sample's share of label 1 (0.5 without a sample); cosines are rounded to 2^-20, and ties among
neighbours go to the earlier in the sample's order (hash of the key, key, hash of the text); repeated
rows are scored each, but equal rows count once in the sample; an empty table gives no rows; other
columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, stored, text_or_empty

WORDS, CLASSES, SHARES = 2048, 1536, 160
FEATURES = WORDS + CLASSES + SHARES
LATENT = 48
#: The labelled sample: documents (the first by hash of the id). 4,096 vectors of 48 floats are 0.8 MB.
MOST_LABELLED = 4_096
NEIGHBOURS = 15
#: The vote of a neighbour is its cosine to this power.
SHARPNESS = 8
BLOCK = 512
#: Steps of a cosine.
ONE = 1 << 20
THRESHOLD = 0.3
#: Text bytes and rows that are vectors at one time: 256 rows are 8 MB.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 256

UPPER, LOWER, DIGIT, BLANK = 1, 2, 3, 4


def _class_table() -> np.ndarray:
    table = np.arange(256) % 91 + 5  # marks stand for themselves
    table[[9, 10, 11, 12, 13, 32]] = BLANK
    table[ord("0") : ord("9") + 1] = DIGIT
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("a") : ord("z") + 1] = LOWER
    table[128:] = LOWER
    return table.astype(np.uint8)


CLASS_OF = _class_table()
POWER = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(64, dtype=np.uint64)) | np.uint64(1)


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def _step(share: np.ndarray, steps: int) -> np.ndarray:
    return np.minimum((share * steps).astype(np.int64), steps - 1)


def terms(texts: list[str]) -> np.ndarray:
    """Log counts of the hashed terms: one row for each text."""
    raw = [t.encode() for t in texts]
    n = len(raw)
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out
    kind = CLASS_OF[data]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # words: runs without blanks, hashed by their bytes in lower case
    solid = kind != BLANK
    first = solid & (new_doc | np.concatenate([[True], ~solid[:-1]]))
    starts = np.nonzero(first)[0]
    count = np.zeros((n, FEATURES), np.int32)
    if len(starts):
        word = np.cumsum(first) - 1
        at = np.arange(len(data)) - starts[np.maximum(word, 0)]
        low = np.where(kind == UPPER, data + 32, data).astype(np.uint64)
        value = np.where(solid, (low + np.uint64(1)) * POWER[np.minimum(at, 63)], np.uint64(0))
        hashes = np.add.reduceat(value, starts)
        length = np.add.reduceat(solid.astype(np.int64), starts)
        of = doc[starts]
        np.add.at(count, (of, _spread(hashes, WORDS)), 1)
        words = np.bincount(of, minlength=n)
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])])
        pair = np.concatenate([[np.uint64(0)], hashes[1:] * np.uint64(31) + hashes[:-1]]) ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(pair, kind="stable")
        again = np.zeros(len(pair), bool)
        again[order[1:]] = pair[order[1:]] == pair[order[:-1]]
        upper_words = np.bitwise_and(kind[starts] == UPPER, length > 1) & (kind[np.minimum(starts + 1, len(kind) - 1)] == UPPER)
        held = np.maximum(words, 1)
        shares = [np.bincount(of, same, n) / held, np.bincount(of, again, n) / held, np.bincount(of, upper_words, n) / held, np.minimum(np.bincount(of, length, n) / held / 20, 0.999)]
    else:
        words, shares = np.zeros(n, np.int64), [np.zeros(n)] * 4
    total = np.maximum(sizes, 1)
    shares += [np.bincount(doc, kind == UPPER, n) / total, np.bincount(doc, kind > BLANK, n) / total, np.bincount(doc, kind == DIGIT, n) / total, np.minimum(np.log1p(words) / 10, 0.999)]
    # character classes: runs of letters, digits or blanks count once
    run = new_doc | np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind > BLANK)
    k, d = kind[run].astype(np.uint64), doc[run]
    if len(k) > 2:
        gram = (k[:-2] * np.uint64(10007) + k[1:-1]) * np.uint64(10007) + k[2:]
        inside = d[:-2] == d[2:]
        np.add.at(count, (d[:-2][inside], WORDS + _spread(gram[inside], CLASSES)), 1)
    np.log1p(count, out=out, casting="unsafe")
    width = SHARES // len(shares)
    for i, share in enumerate(shares):
        out[np.arange(n), WORDS + CLASSES + i * width + _step(share, width)] = 3 * (words > 0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Space:
    """Weights, projection, and the sample's latent vectors with their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        n = len(labels)
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if n else 0.5
        self.weights = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
        x = _unit(counts * self.weights)
        rng = np.random.default_rng(5)
        basis = rng.standard_normal((FEATURES, LATENT + 12)).astype(np.float32)
        for _ in range(5):  # subspace iteration for the leading right singular vectors
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
        self.projection = np.ascontiguousarray((basis @ vt.T)[:, :LATENT].astype(np.float32))
        self.vectors = _unit(x @ self.projection).astype(np.float32)

    def embed(self, texts: list[str]) -> np.ndarray:
        return _unit((terms(texts) * self.weights) @ self.projection)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Scores by exact cosines with all labelled vectors, block by block."""
        out = np.full(len(vectors), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(vectors) if k else 0, BLOCK):
            steps = np.rint((vectors[a : a + BLOCK] @ self.vectors.T) * np.float32(ONE))
            near = np.argpartition(-steps, k - 1, axis=1)[:, :k] if k < steps.shape[1] else np.tile(np.arange(k), (len(steps), 1))
            least = np.take_along_axis(steps, near, 1).min(1)
            for i in np.nonzero((steps >= least[:, None]).sum(1) > k)[0]:  # ties: the earlier come first
                near[i] = np.argsort(-steps[i], kind="stable")[:k]
            weight = np.maximum(np.take_along_axis(steps, near, 1) / ONE, 0.0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            some = total > 0
            out[a : a + BLOCK][some] = (weight * self.labels[near]).sum(1)[some] / total[some]
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most_labelled: int = MOST_LABELLED) -> Space:
    """Fits the space to at most ``most_labelled`` labelled documents, in one task, as the sample is bounded."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    chosen = stored(marked.orderBy(F.xxhash64("key"), "key", "label").limit(most_labelled), "quality-sample")
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    sample = rows.join(F.broadcast(chosen), "key").select("key", F.xxhash64("text").alias("name"), "label", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            counts = [r.tobytes() for r in terms(batch.column(3).to_pylist()).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.binary())], ["key", "name", "label", "counts"])

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        space = Space(np.stack([np.frombuffer(c, np.float16) for c in rows["counts"]]).astype(np.float32), rows["label"].to_numpy())
        return pd.DataFrame({name: [value.tobytes()] for name, value in vars(space).items() if name != "prior"})

    kind = rows.schema["key"].dataType.simpleString()
    made = sample.mapInArrow(counted, f"key {kind}, name long, label int, counts binary")
    # a key may have many documents, so the bound holds for rows as well
    bounded = made.dropDuplicates(["key", "name", "label"]).orderBy(F.xxhash64("key"), "key", "name", "label").limit(most_labelled)
    bounded = bounded.select(F.lit(0).alias("one"), F.monotonically_increasing_id().alias("n"), "label", "counts")
    found = bounded.groupBy("one").applyInPandas(fitted, "labels binary, weights binary, projection binary, vectors binary").collect()
    space = Space.__new__(Space)
    part = lambda name: np.frombuffer(found[0][name], np.float32) if found else np.empty(0, np.float32)
    space.labels, space.weights = part("labels"), part("weights") if found else np.ones(FEATURES, np.float32)
    space.projection = part("projection").reshape(FEATURES, -1) if found else np.zeros((FEATURES, LATENT), np.float32)
    space.vectors = part("vectors").reshape(-1, space.projection.shape[1])
    space.prior = float(space.labels.mean()) if len(space.labels) else 0.5
    return space


def score(docs: DataFrame, space: Space, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, one row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(space)  # under 2 MB: all its sizes are fixed above
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            values = sent.value.vote(sent.value.embed(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["key", "score"])

    return rows.mapInArrow(scored, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, space: Space, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, whose score is the threshold or more."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    names, own = docs.columns, free_name(docs, "text_to_score")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, own, SLICE_BYTES, SLICE_ROWS):
            good = sent.value.vote(sent.value.embed(batch.column(len(names)).to_pylist())) >= threshold
            yield batch.select(list(range(len(names)))).filter(pa.array(good))

    return docs.withColumn(own, text_or_empty(text)).mapInArrow(kept, docs.schema)
