import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from emberline.llm import tokens
from emberline.llm.common import shared_dir
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def equal_to_library(ours, plain, texts):
    wanted = plain.encode_batch(texts, add_special_tokens=False)
    for text, got, want in zip(texts, ours.encode(texts, 2), wanted, strict=True):
        assert np.frombuffer(got, "<u2").tolist() == [*want.ids, 2], repr(text)


def test_encoder_equals_the_library():
    plain, ours = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    assert ours.cuts
    texts = ["", " ", "a", "a b", "a  b", "a   b", " a", "a ", "a\n b", "a \n b\n\n c", "\n", "x\ty z", "don't we'll 12 3.4", "é ü 日本 ✓", "<|endoftext|> x", "a\0 b", "a b 　c", "a\n\n\n b", "tail \n", " 中 \xa0 \xa0", "a" * 100_000, "中" * 5000]
    equal_to_library(ours, plain, texts)
    parts = ["the", " of", "don't", "a", "b", "Zz", "é", "ß", "ɏ", "ɐ", "ª", "º", "²", "½", "µ", "×", "÷", "0", "12", "'", "'s", "'ll", "'S", "’", "“", "—", "€", "…", ".", "!?", "_", "$", "|", "<|endoftext|>", "中", "日本", "я", "\U0001f600", "\u0301"]
    parts += [" ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2009", "\u3000", "\u200b", "\0", "\x7f", "\xad"]
    rng = random.Random(1)
    ours.memory.most = 50  # pieces grow old and come back
    for _ in range(100):
        equal_to_library(ours, plain, ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1000)])
    assert len(ours.memory) <= 50 and len(ours.memory.old) <= 50


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    h1[: n // 10] = h1[:1] if n else h1[:0]  # equal first halves are told apart by the second
    at = np.arange(n)
    index = tokens.Index(tokens.pack_index(h1, h2, dict.fromkeys(tokens.FIELDS, at)))
    slots = index.find(h1, h2)
    assert sorted(slots.tolist()) == list(range(n))
    assert (index.fields["shard"][slots] == at).all()
    missing = index.find(*(rng.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(2)))
    assert (missing == -1).mean() > 0.99


def stored_rows(spark, docs):
    store = shared_dir(spark, "tokens")
    files, parts = tokens.write_store(docs, store, PATH)
    places = tokens.locate(docs, store, parts, files)
    return tokens.read_ids(places, store, files, PATH).collect(), (store, files, parts)


def test_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows, (store, files, parts) = stored_rows(spark, docs)
    by, start = {r.doc_id: r for r in rows}, 0
    plain = Tokenizer.from_file(PATH)
    for d in sorted(docs.select("doc_id", "text").collect()):
        ids = [*plain.encode(d.text, add_special_tokens=False).ids, 2]
        r = by[d.doc_id]
        assert r.ids == ids and r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    absent = spark.createDataFrame([(-5,), (10**12,)], "doc_id long")
    assert [r.shard for r in tokens.locate(absent, store, parts, files).collect()] == [None, None]


def test_odd_rows(spark, odd, none):
    rows, _ = stored_rows(spark, odd)
    assert len(rows) == 9
    assert sum(r.doc_id == 4 for r in rows) == 3
    order = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, 1, 2, 3, 4, 4, 4, 5, 6]
    assert [b.start - a.start for a, b in zip(order, order[1:], strict=False)] == [r.n_tokens for r in order[:-1]]
    assert {r.doc_id: r.ids for r in rows}[1] == {r.doc_id: r.ids for r in rows}[2] == [2]
    assert stored_rows(spark, none)[0] == []


def test_key_over_several_shards(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(400)] + [(8, "x")], "doc_id long, text string")
    store = shared_dir(spark, "tokens")
    files, parts = tokens.write_store(docs, store, PATH, shards=4)
    rows = tokens.read_ids(tokens.locate(docs, store, parts, files), store, files, PATH).collect()
    assert len(files) > 1 and len(rows) == 401
    order = sorted(rows, key=lambda r: r.start)
    assert order[0].start == 0 and [b.start - a.start for a, b in zip(order, order[1:], strict=False)] == [r.n_tokens for r in order[:-1]]
    assert order[-1].doc_id == 8 and sorted(tuple(r.ids) for r in order[:-1]) == sorted((*Tokenizer.from_file(PATH).encode(f"text {i}").ids, 2) for i in range(400))
    assert tokens.shards_for(docs) == 1
