"""The queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontaminate, lexical, mixing, oracles, pii, prefix_trie, quality, radix, secret_scan, sharding, simhash, tokens, toxicity
from .common import held_out, shared_dir, stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _judged(scores: DataFrame, threshold: float, folds: int, fold: int) -> DataFrame:
    return scores.withColumns({"held_out": held_out(F.col("doc_id"), folds, fold), "predicted": (F.col("score") >= threshold).cast("int")})


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2))
    scores = toxicity.score(docs, toxicity.train(docs, known))
    return _judged(scores, toxicity.THRESHOLD, 4, 2).select("doc_id", "held_out", "score", "predicted", F.col("worst").alias("worst_sentence"), F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s.start, s.end)), ",").alias("offending"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16, seed=20)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no", "position")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    scores = quality.score(docs, quality.train(docs, known))
    return _judged(scores, quality.THRESHOLD, 5, 0).select("doc_id", "held_out", "score", "predicted")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = shared_dir(spark, "token-store")
    files, parts = tokens.write_store(docs, store, TOKENIZER)
    places = tokens.locate(docs.select("doc_id"), store, parts, files)
    return tokens.read_ids(places, store, files, TOKENIZER, ids=False)


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(audio.store_media(table(spark, sf_dir, "documents")), "media")
    return audio.describe(stored(audio.features(media), "audio-features"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["base"])
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "n_same", "item_words")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "epoch", "block", "slot", "position")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = radix.classes(table(spark, sf_dir, "documents"))
    names = {"keep": "keep_id", "size": "group_size", "sha256": "text_sha256"}
    return found.withColumnsRenamed({"key": "doc_id", **names}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sharding": op2_sharding,
        "op3_secrets": op3_secrets,
        "op4_quality": op4_quality,
        "op5_token_ids": op5_token_ids,
        "op6_audio": op6_audio,
        "op7_simhash": op7_simhash,
        "op8_pii": op8_pii,
        "op9_decontamination": op9_decontamination,
        "op10_mixing": op10_mixing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_lexical_search": op12_lexical_search,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": oracles.sharding_sql(16, 20),
        "op10_mixing": oracles.mixing_sql(),
        "op11_prefix_trie": oracles.PREFIX_TRIE,
        "op12_lexical_search": oracles.LEXICAL_SEARCH,
        "op13_exact_dedup": oracles.EXACT_DEDUP,
    }
