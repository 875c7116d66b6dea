"""Figures over all turns of a conversation."""

from pyspark.sql import functions as F

from scriptorium.catalog.visuals import figure_text_buckets

SF = "/root/testdata/sf0.001"


def test_figures_hold_all_turns(spark, tmp_path):
    turns = [(1, i, "user", "x" * 50) for i in range(4)] + [(1, 4, "assistant", "I cannot help.")]
    turns += [(12, 0, "user", "y" * 90), (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "user", "c"), (2, 3, "user", "cut off")]
    turns += [(15, i, "user", "I cannot help.") for i in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["buckets"].split(","), r["chars"]) for r in figure_text_buckets(spark, str(tmp_path)).collect()}
    assert "contains_refusal_text_rich_context" in got[1][0] and got[1][1] == 4 * 51 + 14
    assert "possible_truncated_text" in got[2][0]
    # More than three items are no short refusal; an opening turn is whole.
    assert "refusal_like_only_or_too_short" not in got[15][0] and "contains_refusal_text_rich_context" in got[15][0]
    assert got[12][1] == len("I'm sorry, I cannot help. ") + 90


def test_figures_hold_all_characters(spark):
    got = figure_text_buckets(spark, SF).agg(F.sum("chars")).first()[0]
    n = F.col("conv_id")
    rows = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id is not null and text is not null and conv_id % 13 <> 0 and conv_id % 11 <> 3")
    added = F.when((F.col("turn") == 0) & (n % 6 == 0), 26).otherwise(0) + F.when(n % 7 == 0, 3).otherwise(0)
    rows = rows.select("conv_id", (F.length("text") + added).alias("size")).where("size > 0")
    assert got == rows.groupBy("conv_id").agg((F.sum("size") + F.count("*") - 1).alias("size")).agg(F.sum("size")).first()[0]
