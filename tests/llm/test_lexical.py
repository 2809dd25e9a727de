import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from emberline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def by_hand(docs, items, top=50):
    counts = [Counter(terms(t)) for _, t in docs]
    there = [c for c in counts if c]
    n_docs, n_terms = len(there), sum(c.total() for c in there)
    df = Counter(t for c in there for t in c)
    out = []
    for name, text in items:
        scores = []
        for (key, _), c in zip(docs, counts, strict=True):
            m = 100 - 50 + (50 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            scores.append((-score, key is None, key, score))
        best = sorted((s for s in scores if s[3] > 0), key=lambda s: (s[0], s[1], s[2] or 0))[:top]
        out += [(name, i + 1, s[2], s[3]) for i, s in enumerate(best)]
    return sorted(out, key=str)


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "THE", "ünï", "日本", "a-b", "x_y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((1, 5, 40, 200, 900))))) for i in range(n)]
    docs += [(i, docs[7][1]) for i in range(n, n + 90)]  # more equal texts than the result has ranks
    items = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate((1, 3, 10, 30, 60, 200))] + [(9, docs[7][1]), (10, "unknown words only"), (11, None), (12, "?!")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"group_terms": 40}])
def test_ranks_are_those_of_a_plain_scan(spark, options):
    docs, items = corpus(500)
    docs += [(None, "w1 w2 w3"), (3, "w399 the"), (3, "w399 the"), (600, ""), (601, None), (602, "-- ..")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(docs, items, options.get("top", 50))


def test_bounds_are_never_below_scores_and_mostly_equal_to_what_levels_allow():
    docs, _ = corpus(120)
    counts = [lexical.counted(t) for _, t in docs]
    signed = [(lexical.hashed(list(c)), np.array(list(c.values()))) for c in counts]
    asked = sorted({t for c in counts for t in c})[::3]
    n_docs, n_words = len(docs), sum(c.total() for c in counts)
    items = lexical.Items(asked, lexical.hashed(asked), np.arange(1, len(asked) + 1), np.arange(2), np.array([0, 5, len(asked)]), np.arange(len(asked)), n_docs, n_words)
    seen = []
    sizes = [int(np.searchsorted(lexical.LEVELS, tf, "right").sum()) for _, tf in signed]
    for block in lexical.blocks_of(sizes):
        seen += block
        width, bits = lexical.sliced([signed[i] for i in block])
        n, most = np.array([counts[i].total() for i in block]), np.array([max(counts[i].values()) for i in block])
        bound = lexical.bounds(items, n, most, width, bits)
        for at, i in enumerate(block):
            m = int(items.length(n[at]))
            for j, (a, b) in enumerate(((0, 5), (5, len(asked)))):
                exact = sum(int(items.weights[t]) * int(lexical.gain(counts[i][asked[t]], m)) for t in range(a, b))
                step = sum(int(items.weights[t]) * int(lexical.gain(min(int(lexical.LEVELS[np.searchsorted(lexical.LEVELS, counts[i][asked[t]], "right")]) - 1, int(most[at])), m)) for t in range(a, b) if counts[i][asked[t]])
                assert bound[j, at] >= step >= exact
    assert sorted(seen) == list(range(len(docs)))


def test_pieces_of_a_long_text_lose_no_term(monkeypatch):
    text = "one Two thréé " * 5000
    whole = lexical.counted(text)
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.counted(text) == whole == Counter({b"one": 5000, b"two": 5000, "thréé".encode(): 5000})


def test_odd_rows_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "plain text"), (None, "WORD other"), (1, "plain text")], "item_id long, text string")
    got = lexical.search(odd, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(docs, [(1, "plain text"), (None, "WORD other"), (1, "plain text")])
    assert lexical.search(none, items).count() == 0
    assert lexical.search(odd, items.where("false")).count() == 0
