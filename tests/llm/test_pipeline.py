"""The pipeline's stages: columns, and what each of them may do to documents."""

import corpus_pipeline as C


def test_stages(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    seen = docs.collect()
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = docs.collect()
        if name == "language ID":
            assert not any(r.doc_id in (400, 401, 402, 405) for r in now) and len(now) == len(seen) - 4
        if name == "near-dedup":
            ids = [r.doc_id for r in now]
            assert len(set(ids) & {100, 101, 102, 103, 104, 200, 201, 202, 203}) == 1 and 100 in ids
        if name == "substring dedup":
            assert sum(len(r.text.split()) for r in now) < sum(len(r.text.split()) for r in seen)
        seen = now
    assert C.STAGES[-1][1](spark, docs, "").count() == len(seen)


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0
