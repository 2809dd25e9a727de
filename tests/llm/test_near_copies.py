import random
from itertools import combinations
from pathlib import Path

import corpus_pipeline
import pytest
from emberline.llm import near_copies, simhash
from emberline.llm.common import stored
from emberline.operators.graph import components
from pyspark.sql import functions as F


def brute_roots(texts):
    """Components of all pairs with five-word Jaccard similarity >= 0.8, by comparing every pair."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def families(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(60)]
    texts = ["", None, "one two", "One  two", "one two three"]
    for size in (12, 40, 90):
        for _ in range(4):
            base = [word() for _ in range(size)] + shared * rng.randint(0, 1)
            for _ in range(9):
                near = list(base)
                for _ in range(rng.randint(0, 4)):
                    near[rng.randrange(len(near))] = word()
                texts.append(" ".join(near[: len(near) - rng.randint(0, 5)]))
    texts += [" ".join([*shared, word(), *shared[: rng.randint(0, 30)]]) for _ in range(60)]
    return texts


def partition(pairs):
    groups = {}
    for key, name in pairs:
        groups.setdefault(name, set()).add(key)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("orders", [6, 0])
def test_components_equal_brute_force(spark, orders):
    texts = families()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = partition((r.doc_id, r.component) for r in near_copies.near_copies(docs, orders=orders).collect())
    assert got == partition(enumerate(brute_roots(texts)))


def test_stage_leaves_no_near_copies(spark, small):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(families(4))], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stored(corpus_pipeline.keep_one_of_each_group(spark, docs, small), "kept").collect()
    want = {r for r in brute_roots(families(4))}  # a root is the smallest id of its group
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_odd_rows(odd, none):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and near_copies.keep_one(none).count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "None"]


def test_rows_without_id_leave_one(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, a), (None, a), (7, a), (None, b), (None, b.upper()), (7, "else")], "doc_id long, text string")
    kept = near_copies.keep_one(docs).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [("7", "else"), ("7", a), ("None", b)]


def test_runs_of_the_same_sets_count_once(spark):
    rows = [(s, 90, pos, run) for s, runs in {1: "acdfg", 2: "bcdeg", 3: "cdgh"}.items() for pos, run in enumerate(map(ord, runs))]
    shared = near_copies._shared(spark.createDataFrame(rows, "set long, size long, pos int, run long"))
    assert {chr(r.run) for r in shared.collect()} == set("cdg")
    assert sorted((r.set, r.pos, chr(r.run)) for r in near_copies._one_run_of_each_group(shared).collect()) == [(1, 1, "c"), (2, 1, "c"), (3, 0, "c")]


def test_fingerprints_name_candidates(spark):
    """All sets within two bits are connected by pairs of candidates, whether or not they share a run."""
    rng = random.Random(9)
    fps = [base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for base in (rng.getrandbits(62) for _ in range(8)) for _ in range(6)] + [7, 7, 7]
    pairs = near_copies.by_fingerprints(spark.createDataFrame(list(enumerate(fps)), "set long, fp long")).collect()
    root = list(range(len(fps)))

    def joined(edges):
        group = list(root)
        for a, b in edges:
            group = [group[a] if g == group[b] else g for g in group]
        return partition(enumerate(group))

    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in pairs)
    assert joined(pairs) == joined((a, b) for a, b in combinations(root, 2) if (fps[a] ^ fps[b]).bit_count() <= 2)


def test_stage_takes_candidates_from_the_simhash_operator(spark, small, monkeypatch):
    """The stage asks simhash.py for its links, of the fingerprints that op7 gives, and drops those that aren't near copies."""
    seen, pairs = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda distinct: seen.append({r.fp for r in distinct.collect()}) or pairs(distinct))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(families(4))], "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.keep_one_of_each_group(spark, docs, small)
    assert seen and seen[0] <= {r.fp for r in simhash.fingerprints(docs).collect()}


def test_equal_fingerprints_of_other_texts_do_not_link(spark):
    bodies = families(6)
    texts = stored(spark.createDataFrame(list(enumerate(bodies)), "key long, text string").selectExpr("key", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS text_hash"), "texts")
    sets = stored(near_copies.run_sets(texts, 5, near_copies.frequent_runs(texts, 5)).withColumn("fp", F.lit(0).cast("long")), "sets")
    roots = components(near_copies.links(sets, sets.drop("first").dropDuplicates(["set"]), texts)).withColumnRenamed("node", "set")
    got = sets.join(roots, "set", "left").select("key", F.coalesce("root", "set")).collect()
    assert partition(got) == partition(enumerate(brute_roots(bodies)))


def test_tables_go_when_nothing_needs_them(spark):
    """What is on disk after the stage doesn't hold texts, runs or candidates; the last step shuffles texts once."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    docs = spark.createDataFrame(list(enumerate(families(3))), "doc_id long, text string")
    kept = near_copies.keep_one(docs)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert not left & {"run-sets", "run-counts", "shared-runs", "shared-places", "members", "candidates", "candidate-names", "candidate-texts"}
    assert kept.count() == len(set(brute_roots(families(3))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = near_copies.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") <= 2  # the documents, and the rows that are chosen
