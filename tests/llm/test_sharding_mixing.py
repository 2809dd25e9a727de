import zlib
from collections import Counter

import pytest
from emberline.llm import mixing, sharding
from emberline.llm.numbering import number_rows
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 1000])
def test_permutation_is_a_bijection_with_an_inverse(spark, n):
    df = spark.range(n).withColumn("p", sharding.permute("id", n, 9)).withColumn("back", sharding.unpermute("p", n, 9))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


def test_shards_on_odd_rows(odd, none):
    rows = sharding.assign_shards(odd, shards=4).collect()
    assert len(rows) == 9 and none.count() == 0 and sharding.assign_shards(none).count() == 0
    for r in rows:
        assert r.shard == r.position % 4 and r.slot == r.position // 4
    assert sorted(r.row_no for r in rows) == list(range(9))
    by = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    assert by[2] == (1, 0) and by[1] == (1, 0) and by[6] == (len("ünïcödé ✓ 日本語 text".encode()) + 1, zlib.crc32("ünïcödé ✓ 日本語 text".encode()))


def test_shards_of_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first, again = (sorted(map(tuple, sharding.assign_shards(d, 16, 1).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert first == again  # the partitioning doesn't matter
    counts = Counter(r[5] for r in first)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r[6] for r in first if r[5] == shard) == list(range(counts[shard]))


def test_numbering_counts_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1, 0)] * 5 + [("a", 2, 0), ("b", 1, 0), ("b", None, 0)], "g string, k long, r int")
    rows = number_rows(df, "k", ["g"], ["r"], "no").collect()
    assert sorted((r.g, r.no) for r in rows) == [("a", i) for i in range(6)] + [("b", 0), ("b", 1)]


def plain_schedule(shares):
    """Earliest deadline first among the released blocks."""
    total, done, out = sum(shares), [0] * len(shares), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // s), i) for i, s in enumerate(shares) if done[i] * total // s <= t and done[i] < s]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("shares", [[1], [1, 1], [5, 3, 2], [33, 1, 1, 1, 4], [7, 7, 1]])
def test_schedule_stays_within_one_block(spark, shares):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(shares)], "source string, share long")
    got = [int(r.source[1:]) for r in mixing.period_schedule(df).orderBy("slot_in_period").collect()]
    assert got == plain_schedule(shares)
    for t in range(1, len(got) + 1):
        for i, s in enumerate(shares):
            assert abs(got[:t].count(i) - t * s / sum(shares)) < 1


def test_mix_places_every_row(spark, odd, none):
    rows = mixing.mix(odd, block_rows=2, period=10).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    placed = Counter((r.doc_id, r.epoch) for r in rows)
    assert placed[(4, 0)] == 3 and all(placed[(i, 0)] == 1 for i in (1, 2, 3, 5, 6, None))
    assert mixing.mix(none).count() == 0
    again = mixing.mix(odd.repartition(5), block_rows=2, period=10).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_to_given_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "doc_id long, source string")
    shares = spark.createDataFrame([("a", 1), ("b", 1)], "source string, share long")
    rows = mixing.mix(df, shares, block_rows=3).orderBy("position").collect()
    assert {r.doc_id for r in rows} == set(range(100))
    count = Counter(r.source for r in rows)
    assert abs(count["a"] - count["b"]) <= 3 and count["a"] == 90
    with pytest.raises(ValueError):
        mixing.mix(df, shares.where("source = 'a'"))


def test_a_rare_source_does_not_inflate_the_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source")
    rare = spark.createDataFrame([(-1, "one row")] + [(-i, "five rows") for i in range(2, 7)] + [(-7, None), (-8, "")], "doc_id long, source string")
    everything = docs.union(rare)
    rows = mixing.mix(everything).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    assert {r.doc_id for r in rows} == {r.doc_id for r in everything.collect()}
    assert len(rows) <= 1.25 * everything.count()
    assert max(rows, key=lambda r: r.position).epoch == 0  # it ends with a row that is placed for the first time


@pytest.mark.parametrize("shares", [[4] * 9, [20, 1, 1, 1, 1, 1, 1, 1, 5], [9, 8, 7, 6, 5, 4, 3, 2, 1], [1] * 30])
def test_schedule_is_the_same_in_small_chunks(spark, monkeypatch, shares):
    monkeypatch.setattr(mixing, "CHUNK", 4)
    df = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(shares)], "source string, share long")
    got = mixing.period_schedule(df).orderBy("slot_in_period").collect()
    assert [int(r.source[1:]) for r in got] == plain_schedule(shares)
    seen = Counter()
    for r in got:
        assert r.nth == seen[r.source]
        seen[r.source] += 1


def test_many_sources_stay_within_one_block(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', least(id % 4000, 1500)) AS source")
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    plan = {r.source: r for r in mixing.default_shares(counts).collect()}
    assert len(plan) == 1501 and sum(r.share for r in plan.values()) == 8 * 1501
    got = mixing.period_schedule(spark.createDataFrame(list(plan.values()))).orderBy("slot_in_period").collect()
    assert [r.slot_in_period for r in got] == list(range(8 * 1501))
    for r in got:  # a block lies between its release and its deadline, so the source is less than one block away
        share, d = plan[r.source].share, plan[r.source].d
        assert r.nth * d // share <= r.slot_in_period < -(-(r.nth + 1) * d // share)


def test_over_ten_thousand_sources(spark):
    df = spark.range(12_600).selectExpr("id AS doc_id", "CAST(id AS STRING) AS source")
    rows = mixing.mix(df)
    assert rows.agg(F.countDistinct("doc_id")).first()[0] == 12_600 and rows.count() < 16_000


def test_mixed_documents_keep_columns(odd):
    names = ("_times", "_from", "unfold_times", "placed_key", "placed_row", "copy", "grp", "share", "d", "most", "q", "block", "nth", "epoch", "_md5", "_bucket")
    odd = odd.selectExpr("*", *[f"1 AS {c}" for c in names], "map('k', doc_id) AS more", "array(map(1, named_struct('a', 'b'))) AS `a.b`")
    out = mixing.mixed_documents(odd, block_rows=2, period=10)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, None}
