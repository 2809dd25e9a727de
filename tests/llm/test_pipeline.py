import corpus_pipeline
from emberline.llm import queries
from emberline.llm.common import stored


def test_stages(spark, small):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), "stage")
        kept.append((name, docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = [x[2] for x in kept]
    assert ids[0] > ids[1] > ids[2] == ids[3] == ids[4]
    assert kept[3][1] >= kept[2][1] and kept[4][1] == kept[3][1]


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
