import random
import re

import pytest
import xxhash
from emberline.llm import simhash
from pyspark.sql import functions as F


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, bits=2):
    root = {i: i for i in range(len(pairs))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(pairs):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return [low.get(find(i)) for i in range(len(pairs))]


def test_fingerprints(odd):
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in simhash.fingerprints(odd).collect():
        assert r.fp % 2**64 == brute_fingerprint(texts[r.doc_id])


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9 and simhash.near_duplicates(none).count() == 0
    by = {r.doc_id: r.component for r in rows}
    assert by[1] == by[2] == by[5] == 1 and by[4] == 4 and by[None] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "None"]


@pytest.mark.parametrize("most", [64, 3, 1])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_equal_brute_force(spark, most, bits):
    rng = random.Random(5)
    fps = []
    for _ in range(12):  # families of near fingerprints, dense ones too
        base = rng.getrandbits(64)
        fps += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(14)]
    fps += [0, 1, 2**63, 2**64 - 1, 2**64 - 2]
    distinct = sorted(set(fps))
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in distinct], "fp long")
    links = {(r.a, r.b) for r in simhash.near_pairs(df, bits, most).collect()}
    signed = [f - 2**64 if f >= 2**63 else f for f in distinct]
    want = brute_components(list(zip(range(len(distinct)), distinct, strict=True)), bits)
    place = {f: i for i, f in enumerate(signed)}
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert (distinct[place[a]] ^ distinct[place[b]]).bit_count() <= max(bits, 0)
        root[max(find(place[a]), find(place[b]))] = min(find(place[a]), find(place[b]))
    assert [find(i) for i in range(len(distinct))] == want


def test_table_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    got = {r.doc_id: r.component for r in simhash.near_duplicates(docs).collect()}
    assert [got[r.doc_id] for r in rows] == want


def test_cells_are_33_and_distinct(spark):
    df = spark.createDataFrame([(0,), (-1,), (123456789,)], "fp long").withColumn("c", simhash.cells())
    assert [(r.n, r.m) for r in df.select(F.size("c").alias("n"), F.size(F.array_distinct("c")).alias("m")).collect()] == [(33, 33)] * 3


def test_rows_without_id_leave_one(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, a), (None, a), (7, a), (None, b), (None, b.upper()), (7, "else")], "doc_id long, text string")
    kept = simhash.keep_one(docs).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [("7", "else"), ("7", a), ("None", b)]
