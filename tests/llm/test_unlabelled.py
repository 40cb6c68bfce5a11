"""The pipeline's first stage over documents from which no language can be learned."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakescope.llm import langid

KIND = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["some words", "слово", "12 34", "", None, "x"]


@pytest.mark.parametrize("labelled", [False, True])
def test_no_prototypes(spark, labelled):
    """Null languages in every row, or languages in held-out rows alone."""
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in enumerate(TEXTS * 5)], KIND)
    if labelled:
        docs = docs.withColumn("lang", F.when(langid.held_out(), "en"))
        assert docs.filter("lang is not null").count()
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.schema.names == docs.schema.names
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if any(c.isalpha() for c in r[1] or "")), key=str)


def test_run(spark, tmp_path):
    spark.createDataFrame([(k, t, None, "s", 1) for k, t in enumerate(TEXTS)], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {0, 1, 5}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
