import hashlib
import re

import pytest

from emberline.llm import radix


def by_hand(rows):
    """For each row its class: (id that stays, size, sha256)."""
    bodies = [re.sub("[\x20\x09-\x0d]+", " ", t or "").encode() for _, t in rows]
    out = []
    for (key, _), body in zip(rows, bodies, strict=True):
        same = [k for (k, _), b in zip(rows, bodies, strict=True) if b == body]
        out.append((key, min((k for k in same if k is not None), default=None), len(same), hashlib.sha256(body).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return radix.classes(df, **options).collect()


def texts():
    """Texts that share prefixes of every length, ends at and beside the borders of digits, blanks of all kinds."""
    base = "abcdefgh" * 400
    cut = [base[:n] for n in (0, 1, 3, 4, 5, 7, 8, 9, 31, 32, 33, 287, 288, 289, 2335, 2336, 2337)]
    other = [t + x for t in cut for x in ("", "x", "ü")]
    blank = ["a b", "a\t\n b", "a  b", "a b ", " a b", "a b", "", None, " ", "\r\n"]
    return cut + other + blank + [base, base, base[:-1] + "é"]


@pytest.mark.parametrize(("head", "growth"), [(1, 2), (4, 2), (radix.HEAD, radix.GROWTH)])
def test_classes_are_those_of_a_plain_comparison(spark, head, growth):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts())] + [(None, "a b"), (None, "only without id"), (None, "only without id")]
    got = found(spark, rows, head=head, growth=growth)
    assert sorted(((r["key"], r["keep"], r["size"], r["sha256"]) for r in got), key=str) == by_hand(rows)
    kept = [r["sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({x[3] for x in by_hand(rows)})
    assert all(r["key"] == r["keep"] for r in got if r["kept"])


def test_a_group_of_a_third_of_all_rows_and_equal_rows(spark):
    rows = [(i, "the same text " * 50) for i in range(3000)] + [(i, f"text {i % 4000}") for i in range(3000, 9000)] + [(1, "twice"), (1, "twice")]
    got = found(spark, rows)
    assert len(got) == len(rows)
    hot = [r for r in got if r["size"] == 3000]
    assert len(hot) == 3000
    assert {r["keep"] for r in hot} == {0}
    assert [r["key"] for r in hot if r["kept"]] == [0]
    twice = [r for r in got if r["size"] == 2 and r["key"] == 1]
    assert sorted(r["kept"] for r in twice) == [False, True]


def test_very_long_texts(spark):
    long = "0123456789abcde " * 2_000_000
    got = found(spark, [(1, long), (2, long + "x"), (3, long.replace(" ", "\t\n")), (4, long[:-1])])
    assert {r["key"]: (r["keep"], r["size"]) for r in got} == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_odd_rows_and_clashing_names(odd, none):
    assert radix.classes(none).count() == 0
    assert radix.keep_first(none).count() == 0
    got = radix.keep_first(odd.withColumn("radix_key", odd.doc_id))
    assert got.columns == [*odd.columns, "radix_key"]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.select("doc_id").collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, None)]
