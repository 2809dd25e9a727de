import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from emberline.llm import audio, decontaminate, queries


def test_media_round_trip(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op6_audio(spark, small).collect():
        payload = audio.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes == len(payload) + 44 and len(payload) % 576 == 0


def test_resampling_equals_the_plain_sum():
    x, h = np.random.default_rng(0).standard_normal(999).astype(np.float32), audio._filter()
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    want = np.convolve(up, h)[:: audio.DOWN][: -(-len(x) * audio.UP // audio.DOWN)]
    assert np.allclose(audio.resample(x), want, atol=1e-5)


def test_blocks_do_not_matter(monkeypatch):
    x = np.random.default_rng(1).standard_normal(30_000).astype(np.float32)
    whole = audio.log_mel(audio.resample(x))
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert np.allclose(audio.log_mel(audio.resample(x)), whole, atol=1e-4)


def test_segments_have_hysteresis():
    mel = np.repeat(np.array([0, 0, 9, 5, 9, 0, 0, 0, 9, 0], np.float32)[:, None], audio.MELS, 1)
    assert audio.segments(mel) == [(2, 5), (8, 9)]
    assert audio.segments(np.zeros((4, audio.MELS), np.float32)) == []


def test_tensors_are_of_fixed_shape():
    mel = np.arange(40 * audio.MELS, dtype=np.float32).reshape(40, audio.MELS)
    table = audio.unpack(audio.pack(mel))
    assert table.schema.field("log_mel").type == audio.SHAPE and len(table) == 3
    back = table["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert np.array_equal(back[:40], mel) and (back[40:] == np.float32(np.log(audio.FLOOR))).all()
    assert table["start_ms"][1].as_py() == table["end_ms"][0].as_py()


def test_audio_on_odd_rows(odd, none):
    rows = audio.describe(audio.features(audio.store_media(odd))).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[1].payload_bytes == by[2].payload_bytes == 576 and by[1].feature == by[2].feature
    assert len({r.feature for r in rows if r.doc_id == 4}) == 1
    assert audio.describe(audio.features(audio.store_media(none))).count() == 0
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFF not a wav")


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def brute_overlap(doc, item, similarity=0.8, least=16):
    """n_same, n_words and start of the first longest stretch of the best alignment."""
    best = None
    for d in range(-len(item), len(doc)):
        same = [0 <= d + i < len(doc) and doc[d + i] == w for i, w in enumerate(item)]
        fit = [(b - a, -b, a) for a in range(len(item)) for b in range(a + 1, len(item) + 1) if same[a] and same[b - 1] and sum(same[a:b]) >= similarity * (b - a) - 1e-9]
        if fit:
            n, _, a = max(fit)
            if n >= min(least, len(item) * similarity):
                found = (sum(same[a : a + n]), n, -(d + a))
                best = found if best is None else max(best, found)
    return best


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    items = [words(rng, n) for n in (20, 30, 45, 25, 16, 12, 8, 7, 6, 5, 4, 3, 2, 1)]
    docs = []
    for i in range(240):
        body, item = words(rng, rng.randint(0, 60)), list(items[i % len(items)])
        for _ in range(rng.randint(0, len(item) // 4)):  # any words are substituted
            item[rng.randrange(len(item))] = "zzzzz"
        if rng.random() < 0.3:
            item = item[: rng.randint(1, len(item))]
        at = rng.randint(0, len(body))
        docs.append(body[:at] + item * (rng.random() < 0.9) + body[at:])
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_same, r.n_words, -r.start_word) for r in decontaminate.find_contamination(frame, bench).collect()}
    assert got == {(i, j): n for i, d in enumerate(docs) for j, w in enumerate(items) if (n := brute_overlap(d, w))}


def hit(equal, masks):
    return any(all(equal[s + i] for i, c in enumerate(mask) if c == "1") for mask in masks for s in range(len(equal) - len(mask) + 1))


def test_every_pattern_to_be_reported_has_a_seed():
    """Items of up to 16 words: all patterns of equal words. Longer ones: the most equal words that a stretch without a hit has."""
    for n in range(1, 16):
        for code in range(1, 1 << n):
            equal = np.array([code >> i & 1 for i in range(n)], bool)
            a, b = decontaminate.best_stretch(equal, 0.8)
            if b - a >= min(16, n * 0.8):
                assert hit(equal, decontaminate.masks_for(n)), (n, code)
    # a longer stretch with four fifths of its words equal has a part of 16 to 31 words with that share
    span = max(map(len, decontaminate.MASKS))
    free = [c for c in range(1 << span) if not hit([c >> (span - 1 - i) & 1 for i in range(span)], decontaminate.MASKS)]
    most = {c: c.bit_count() for c in free}
    for n in range(span + 1, 32):
        longer = {}
        for c, ones in most.items():
            for bit in (0, 1):
                after = (c << 1 | bit) & ((1 << span) - 1)
                if not hit([after >> (span - 1 - i) & 1 for i in range(span)], decontaminate.MASKS):
                    longer[after] = max(longer.get(after, 0), ones + bit)
        most = longer
        assert n < 16 or max(most.values()) < 0.8 * n, n


def test_planted_passages(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: f" {' '.join(re.findall(r"[^\W_]+", t.lower()))} "
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert want and want <= got
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})


def test_decontamination_on_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "plain one two three four"), (2, None), (None, "lost text here with five words"), (3, "")], "item_id long, text string")
    rows = decontaminate.find_contamination(odd, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in rows) == [("4", "1"), ("None", "None")]
    left = decontaminate.drop_contaminated(odd.selectExpr("*", "1 AS found_key", "2 AS found_hash", "3 AS item", "4 AS diagonal"), bench)
    assert left.count() == 5 and {"found_key", "found_hash", "item", "diagonal"} <= set(left.columns)
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(odd, bench.where("false")).count() == 0


def test_windows_that_read_alike_are_given_once():
    rng = np.random.default_rng(2)
    for words_of, size in ((3, 4), (1, 5), (2, 1), (50, 6)):
        own = rng.integers(1, words_of + 1, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        low = rng.integers(-size + 1, 55, 12)
        high = low + rng.integers(0, 9, 12)
        line = sorted({d for a, b in zip(low, high, strict=True) for d in range(a, b + 1)})
        reads = {d: (max(0, -d), tuple(own[max(0, d) : max(0, d + size)])) for d in line}
        want = {min(d for d in line if reads[d] == r): r for r in reads.values()}
        got = list(decontaminate.distinct_windows(own, low, high, size))
        assert {reads[d] for d in got} == set(want.values())
        assert set(want) <= set(got)


def test_one_word_said_over_and_over(spark):
    docs = [(1, "the " * 20_000), (2, "so " + "the " * 300 + "end"), (3, "the cat"), (4, "a b " * 400)]
    items = [(i, "the " * 40) for i in range(100)] + [(100, "a b " * 20)]
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.n_same, r.item_words) for r in found.collect()}
    want = {(d, i): (start, 40, 40, 40) for i in range(100) for d, start in ((1, 0), (2, 1))} | {(4, 100): (0, 40, 40, 40)}
    assert rows == want
