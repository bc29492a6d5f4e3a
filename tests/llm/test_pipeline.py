"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from trailhead.llm.tables import stage

from ..conftest import DATA
from .test_brute import brute_classes

FOLDER = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, apply in corpus_pipeline.STAGES:
        results.append(stage(apply(spark, results[-1], FOLDER), "test-pipeline"))
    before, good, single, clean, mixed, shards = results
    assert all(x.columns == columns for x in results[:-1])
    texts = {x.doc_id: x.text for x in good.collect()}
    assert 0 < len(texts) < before.count()
    assert {x.doc_id for x in single.collect()} == {x for _, x in brute_classes(texts).values()}
    assert 0 < clean.count() <= single.count()
    copies = {x.doc_id: x.n for x in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(copies) <= {x.doc_id for x in clean.collect()} and max(copies.values()) <= 3
    assert shards.count() == mixed.count()
    assert corpus_pipeline.run(spark, FOLDER).exceptAll(shards).count() == 0
