import math
import random
import re
import zlib

import numpy as np
import pytest
from emberline.llm import quality, toxicity
from emberline.llm.common import held_out
from emberline.llm.words import hashed_words, letters_and_digits
from pyspark.sql import functions as F


def test_held_out_rule(spark):
    df = spark.range(200).withColumn("h", held_out(F.col("id"), 4, 2))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in df.collect())


def accuracy(rows, label):
    good = [(r.score >= 0.3) == (r[label] == 1) for r in rows]
    return sum(good) / len(good)


def test_toxicity_on_held_out_rows(spark):
    """Some of the labels are wrong by design of the tables, so the bar is what a word list can reach."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs, labels.where(~out))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(out).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.score >= 0.3 for r in clean) <= 0.03 * len(clean)
    assert accuracy(rows, "toxic") > 0.9
    for r in rows:
        assert 0 <= r.score <= 1
        for s in r.offending:
            assert 0 <= s.start < s.end <= len(texts[r.doc_id])
    same = toxicity.train(docs.repartition(5), labels.where(~out).repartition(3))
    assert np.allclose(same[0], model[0]) and same[1] == pytest.approx(model[1])


def test_spans_match_scores():
    weights = np.zeros(toxicity.FEATURES, np.float32)
    text = "One two. Bad word here! " + "long " * 150 + "\n\nlast? "
    p, of = toxicity.sentence_scores([text, "...", "x" * 100_000], weights, -3.0)
    spans = toxicity.sentence_spans(text)
    assert of.tolist() == [0] * 6 + [2] and len(spans) == 6
    assert [text[a:b] for a, b in spans[:2]] == ["One two", "Bad word here"]
    assert toxicity.noisy_or(np.array([0.5, 0.5]), np.array([1, 1]), 3) == pytest.approx([0, 0.75, 0])
    assert toxicity.sentence_spans("...") == []


def test_toxic_scores_equal_a_plain_loop():
    rng = random.Random(3)
    texts = ["".join(rng.choices(["Ab ", "cd", " ", ".", "?\n", "é_f ", "99 ", "!"], k=rng.choice((0, 3, 40, 900)))) for _ in range(60)]
    slot = lambda w: int(hashed_words([w], letters_and_digits())[0][0]) % toxicity.FEATURES
    weights = np.zeros(toxicity.FEATURES, np.float32)
    for w in ("ab", "cd", "cd99"):
        weights[slot(w)] = rng.uniform(-2, 3)
    p, of = toxicity.sentence_scores(texts, weights, -2.0)
    want = []
    for text in texts:
        clear = 1.0
        for part in re.split(r"[.!?\n]", text.lower()):
            found = re.findall(r"[^\W_]+", part)
            for i in range(0, len(found), toxicity.SENTENCE_WORDS):
                z = -2.0 + sum(float(weights[slot(w)]) for w in set(found[i : i + toxicity.SENTENCE_WORDS]))
                clear *= 1 - 1 / (1 + math.exp(-z))
        want.append(1 - clear)
    assert toxicity.noisy_or(p, of, len(texts)) == pytest.approx(want, abs=1e-9)


def test_toxic_gradient_equals_differences():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 12, 40))
    pairs = np.unique(rng.integers(0, 40, 90) * 7 + rng.integers(0, 7, 90))
    toxic, w = rng.random(12) < 0.5, rng.normal(size=9)
    at = lambda x: toxicity.likelihood(x, pairs % 7, pairs // 7, doc, toxic)
    steps = [(at(w + e)[0] - at(w - e)[0]) / 2e-6 for e in np.eye(9) * 1e-6]
    assert at(w)[1] == pytest.approx(steps, abs=1e-6)


def test_words_after_a_long_start_are_learnt(spark):
    """Whole texts are read: the offending sentence comes after 30,000 words."""
    rows = [(i, "plain words. " * (15_000 if i < 3 else 5) + ("an offending sentence." if i % 2 else "all is well."), i % 2) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.drop("text"))
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((found[i].score >= 0.3) == bool(t) for i, _, t in rows)
    assert rows[1][1][found[1].offending[0].start :] == "an offending sentence."


def test_toxicity_on_odd_rows(odd, none, labels):
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 9 and {r.doc_id: r.score for r in rows}[1] == 0
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels)[1] == -30 and toxicity.train(odd, labels.where("false"))[1] == -30


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out(F.col("doc_id"), 5, 0)
    space = quality.train(docs, labels.where(~out))
    rows = quality.score(docs, space).join(labels, "doc_id").where(out).collect()
    good = [r for r in rows if r.quality == 1]
    assert accuracy(rows, "quality") > 0.95 and sum(r.score >= 0.3 for r in good) >= 0.98 * len(good)
    kept = quality.keep_good(docs, space)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, space).collect() if r.score >= 0.3}


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA!!", "delta", "%%"], 12)) for _ in range(200)]
    labels = rng.integers(0, 2, 150)
    space = quality.Space(quality.terms(texts[:150]), labels)
    vectors = space.embed(texts[150:])
    cosines = np.rint((vectors @ space.vectors.T) * np.float32(1 << 20)) / 2**20
    for row, score in zip(cosines, space.vote(vectors), strict=True):
        near = sorted(range(150), key=lambda i: (-row[i], i))[: quality.NEIGHBOURS]
        w = [max(float(row[i]), 0.0) ** quality.SHARPNESS for i in near]
        assert score == pytest.approx(sum(x * labels[i] for x, i in zip(w, near, strict=True)) / sum(w), abs=1e-6)


def test_ties_of_votes_go_to_the_earlier():
    space = quality.Space.__new__(quality.Space)
    space.vectors = np.tile(np.eye(1, 48, dtype=np.float32), (100, 1))
    space.labels, space.prior = (np.arange(100) < 15).astype(np.float32), 0.15
    assert space.vote(space.vectors[:3]) == pytest.approx([1.0] * 3)


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text number {i % 40}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.train(docs, labels).labels) == 40 and toxicity.sampled_bags(docs, labels, "toxic", "doc_id", "text", 30).count() == 30
    assert len(quality.train(docs, labels, most_labelled=1).labels) == 1


def test_terms_do_not_depend_on_the_batch():
    texts = ["", "Some words, some MORE words!!", "  ", "ünïcödé 123 ✓", "a", "x y z " * 50]
    together = quality.terms(texts)
    for t, row in zip(texts, together, strict=True):
        assert np.array_equal(quality.terms([t])[0], row)
    assert not together[0].any()


def test_quality_on_odd_rows(odd, none, labels):
    space = quality.train(odd, labels)
    rows = quality.score(odd, space).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.score for r in rows}[1] == pytest.approx(space.prior)
    assert quality.score(none, space).count() == 0
    empty = quality.train(none, labels)
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}
    assert quality.keep_good(odd, empty).columns == odd.columns
