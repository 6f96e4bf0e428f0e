"""The stages one after the other, each on what its predecessor kept."""

import corpus_pipeline
from resaleworth.session import materialise

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = [before]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), name)
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    languages, lines, groups = sizes[1:4]
    assert 0.9 * before <= languages <= before and lines == languages and groups < lines
    assert "sequence_id" in docs.columns and docs.select("sequence_id").distinct().count() == docs.count()


def test_run_is_the_stages_together(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
