"""The sample that operator 7 learns from."""

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import langid


def test_rare_language_is_learned(spark):
    some = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the cat and the dog").alias("text"), F.when(F.col("id") % 2000 == 7, "rare").otherwise("en").alias("lang"))
    docs = some.withColumn("text", F.when(F.col("lang") == "rare", "zwölf boxkämpfer jagen").otherwise(F.col("text")))
    model = langid.train(docs, sample_rows=100)
    assert model.languages == ["en", "rare"]
    got = langid.predict(docs, model).groupBy("lang", "lang_pred").count().collect()
    assert sorted(map(tuple, got)) == [("en", "en", 3998), ("rare", "rare", 2)]


@pytest.mark.parametrize("counts,most,share", [([5, 5], 10, 5), ([2, 100], 10, 8), ([1, 2, 50, 50], 23, 10), ([9], 3, 3), ([4] * 10, 5, 1)])
def test_shares(counts, most, share):
    assert langid._share(counts, most) == share
