"""The pipeline's first stage over documents without labels."""

from hard_rows import documents, empty, multiset
from pyspark.sql import functions as F

import corpus_pipeline


def test_unlabelled_documents_stay(spark):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert multiset(out.collect()) == multiset(r for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert stage(spark, empty(spark), "").count() == 0
