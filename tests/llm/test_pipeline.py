"""The pipeline's stages: each keeps its predecessor's work and the columns of documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerlens.llm import near_dup, suffix_dedup


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns and docs.count() <= seen[-1].count(), name
        seen.append(docs)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert all(ids(b) <= ids(a) for a, b in zip(seen, seen[1:], strict=False))
    assert near_dup.near_duplicate_classes(seen[3]).filter("doc_id <> class_id").count() == 0
    digests = suffix_dedup.dedup_digests(seen[3])
    assert docs.count() == digests.filter("n_removed < n_bytes").count() and docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.packing(spark, docs, sf_dir)
    assert ids(packed) == ids(docs) and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
