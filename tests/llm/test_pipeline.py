import corpus_pipeline
from quillstone.session import written


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[5] > 0


def test_empty(spark, empty, sf):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_awkward_rows_through_all_stages(spark, awkward, sf):
    docs, counts = awkward, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == awkward.columns and docs.where("id <> 'clash'").isEmpty()
        if name == "near_duplicates":
            once = before.where("doc_id IN (1, 2)").count() and 1
            assert docs.where("doc_id IN (1, 2)").count() == once
        if name == "mixing":
            assert docs.where("text IS NULL OR text NOT RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").isEmpty()
    assert counts[0] >= counts[1] >= counts[2]
