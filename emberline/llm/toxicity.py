"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words in it
(hashed, present or not); a document is toxic unless all its sentences are not (noisy-or):
P = 1 - prod(1 - p_s). While fitting, a leak (a toxic label that no sentence explains) takes up wrong
labels, so that they don't raise every sentence's score. The weights are fitted to document labels
alone, by gradient ascent on a bounded number of labelled documents, and then tell which sentences offend.

Texts are read whole, in fitting as in scoring. Words become features by their evidence, which Spark
counts over the sample's documents first, so the task that fits holds few words of each text.

Cases: null and empty texts have no sentence and get the score of a bag with none, 0; text without
sentence ends is cut every SENTENCE_WORDS words, and one huge word is one word; without labels of both
kinds the model scores every document with 0; repeated rows are scored each, but equal rows count once
in the sample; among the sample's rows of one key the first by hash of the text come first; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty
from .words import letters_and_digits, only, words_and_stops

FEATURES = 1 << 18
#: Bound of the sample that the model is fitted on: labelled documents (the first by hash of the id).
MOST_LABELLED = 6_000
SENTENCE_WORDS = 64
STEPS, RATE, DECAY = 250, 0.1, 1e-5
#: Evidence (likelihood-ratio chi-squared) of a word's link with the label that makes it a feature: about one in 10,000 by chance.
LEAST_EVIDENCE = 15.0
THRESHOLD = 0.3
ENDS = ".!?\n"
PARTS = re.compile(rf"[^\W_]+|[{ENDS}]")


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words, the sentence that each is in (numbered through all texts), and the text of each sentence."""
    words, counts, before = words_and_stops(texts, letters_and_digits(), only(ENDS))
    at = np.arange(len(words))
    first = np.maximum.accumulate(np.where(np.diff(before, prepend=-1) != 0, at, 0))  # line ends stand between texts
    opens = (at - first) % SENTENCE_WORDS == 0  # long ones are cut
    return (words % np.uint64(FEATURES)).astype(np.int64), np.cumsum(opens) - 1, np.repeat(np.arange(len(texts)), counts)[opens]


def evidence(toxic_with: np.ndarray, with_word: np.ndarray, toxic: int, n: int) -> np.ndarray:
    """Likelihood-ratio chi-squared of each word's two-by-two table (documents with the word, toxic documents)."""
    cells = (
        (toxic_with, with_word, toxic),
        (with_word - toxic_with, with_word, n - toxic),
        (toxic - toxic_with, n - with_word, toxic),
        (n - with_word - toxic + toxic_with, n - with_word, n - toxic),
    )
    total = np.zeros(len(with_word))
    for seen, row, column in cells:
        expected = row * (column / n)
        total += 2 * seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9))
    return total


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def likelihood(w: np.ndarray, word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log likelihood of a leaky noisy-or, and its gradient.

    ``w``: the words' weights, the bias of sentences, the leak. ``word`` and ``sentence``: which words
    are in which sentences, each pair once; ``doc``: the document of each sentence.
    """
    p, leak = _logistic(np.bincount(sentence, w[word], len(doc)) + w[-2]), _logistic(w[-1])
    clear = (1 - leak) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(toxic)))
    dirty = np.maximum(1 - clear, 1e-9)
    pull = np.where(toxic, clear / dirty, -1.0) / len(toxic)
    by_sentence = pull[doc] * p
    gradient = np.concatenate([np.bincount(word, by_sentence[sentence], len(w) - 2), [by_sentence.sum(), pull.sum() * leak]])
    return float(np.log(np.where(toxic, dirty, np.maximum(clear, 1e-300))).mean()), gradient


def fit(slots: list[np.ndarray], sentences: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by word slot and the bias, by Adam with all documents in each step.

    For each document: pairs of slot and sentence (from 0), and the number of sentences.
    """
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(labels)), sizes)
    vocabulary, word = np.unique(np.concatenate(slots).astype(np.int64), return_inverse=True)
    sentence = np.concatenate([s + a for s, a in zip(sentences, starts, strict=True)]).astype(np.int64)
    w = np.zeros(len(vocabulary) + 2)
    w[-2:] = -8.0, -4.0
    decay = np.full_like(w, DECAY)
    decay[-2:] = 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        g = likelihood(w, word, sentence, doc, labels.astype(bool))[1] - decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    weights = np.zeros(FEATURES, np.float32)
    weights[vocabulary] = w[:-2]
    return weights, float(w[-2])


def sampled_bags(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """label, sentences (their number), slots and inside (pairs of word slot and sentence) of at most ``most`` labelled documents (a stored table)."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    chosen = stored(marked.orderBy(F.xxhash64("key"), "key", "label").limit(most), "toxic-sample")
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    sample = rows.join(F.broadcast(chosen), "key").select("key", F.xxhash64("text").alias("name"), "label", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            slots, sentence, of = bags(batch.column(3).to_pylist())
            sizes = np.bincount(of, minlength=len(batch))
            first = np.cumsum(sizes) - sizes
            pair = np.unique(sentence * FEATURES + slots)
            slots, sentence = pair % FEATURES, pair // FEATURES
            ends = np.searchsorted(sentence, first[1:])
            inside = np.split(sentence - first[of[sentence]] if len(of) else sentence, ends)
            columns = [pa.array(sizes), pa.array(np.split(slots, ends), pa.list_(pa.int64())), pa.array(inside, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["key", "name", "label", "sentences", "slots", "inside"])

    kind = rows.schema["key"].dataType.simpleString()
    made = sample.mapInArrow(cut, f"key {kind}, name long, label int, sentences long, slots array<long>, inside array<long>")
    # a key may have many documents, so the bound holds for rows as well
    bounded = made.dropDuplicates(["key", "name", "label"]).orderBy(F.xxhash64("key"), "key", "name", "label").limit(most)
    return stored(bounded.select(F.monotonically_increasing_id().alias("n"), "label", "sentences", "slots", "inside"), "toxic-bags")


def features(sample: DataFrame) -> np.ndarray:
    """Marks the slots whose words have enough evidence; empty if the labels are not of both kinds."""
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return np.empty(0, bool)
    by_slot = sample.select("label", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot")
    seen = by_slot.agg(F.count("*").alias("with_word"), F.sum("label").alias("toxic_with")).toPandas()  # FEATURES rows at most
    known = np.zeros(FEATURES, bool)
    known[seen["slot"].to_numpy()] = evidence(seen["toxic_with"].to_numpy(), seen["with_word"].to_numpy(), toxic, n) >= LEAST_EVIDENCE
    return known


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, float]:
    """Fits the model to at most ``most_labelled`` labelled documents, in one task, as the sample is bounded."""
    sample = sampled_bags(docs, labels, label, key, text, most_labelled)
    known = features(sample)
    if not len(known):
        return np.zeros(FEATURES, np.float32), -30.0

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, inside = ([np.asarray(x, np.int64) for x in batch.column(i).to_pylist()] for i in (3, 4))
            on = [known[s] for s in slots]
            kept = [pa.array([x[o] for x, o in zip(column, on, strict=True)], pa.list_(pa.int64())) for column in (slots, inside)]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(batch), pa.int32()), *batch.columns[:3], *kept], ["one", "n", "label", "sentences", "slots", "inside"])

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        weights, bias = fit(list(rows["slots"]), list(rows["inside"]), rows["sentences"].to_numpy(), rows["label"].to_numpy())
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    few = sample.mapInArrow(screened, "one int, n long, label int, sentences long, slots array<long>, inside array<long>")
    model = few.groupBy("one").applyInPandas(fitted, "weights binary, bias double").first()
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def sentence_scores(texts: list[str], weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The score of each sentence, and the text that it is in."""
    slots, sentence, of = bags(texts)
    on = weights[slots] != 0
    pair = np.unique(sentence[on] * FEATURES + slots[on])  # present or not
    return _logistic(np.bincount(pair // FEATURES, weights[pair % FEATURES], len(of)) + bias), of


def noisy_or(p: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The scores of ``n`` documents from those of their sentences."""
    return -np.expm1(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences that have words, in the order of :func:`sentence_scores` (code points)."""
    spans: list[tuple[int, int]] = []
    start = stop = count = -1
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; then the places are those of the lower-case text
        text = low
    for m in PARTS.finditer(low):
        if m[0] in ENDS or count == SENTENCE_WORDS:
            if start >= 0:
                spans.append((start, stop))
            start, count = -1, 0
            if m[0] in ENDS:
                continue
        start, stop, count = m.start() if start < 0 else start, m.end(), max(count, 0) + 1
    return [*spans, (start, stop)] if start >= 0 else spans


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", locate: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """key, score, worst (the highest sentence score) and, if asked for, offending.

    offending: start, end and score of the sentences at or above the threshold, of documents at or above it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB: FEATURES is fixed
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            p, of = sentence_scores(texts, weights, bias)
            totals, worst = noisy_or(p, of, len(texts)), np.zeros(len(texts))
            np.maximum.at(worst, of, p)
            places: list[list[dict]] = [[] for _ in texts]
            for i in np.nonzero(totals >= threshold)[0].tolist() if locate else ():
                a, b = np.searchsorted(of, [i, i + 1])
                places[i] = [{"start": x, "end": y, "score": float(q)} for (x, y), q in zip(sentence_spans(texts[i]), p[a:b], strict=True) if q >= threshold]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals), pa.array(worst), pa.array(places, span)], ["key", "score", "worst", "offending"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"key {kind}, score double, worst double, offending array<struct<start: int, end: int, score: double>>")
    return (out if locate else out.drop("offending")).withColumnRenamed("key", key)
