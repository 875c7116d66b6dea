"""Citation counts and their bibliography entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mentions(marked: DataFrame) -> DataFrame:
    # Outer, as for an inner explode the optimizer filters by the array's size below, and so computes it twice.
    return marked.select("paper_id", "section_id", "order", F.explode_outer("cites").alias("key")).where("key is not null")


def citations(marked: DataFrame) -> DataFrame:
    """(paper_id, key, count, cited_in, first_context): sections in document order, each once."""
    each = mentions(marked).groupBy("paper_id", "key", "section_id", "order").agg(F.count("*").alias("n"))
    spots = F.array_sort(F.collect_list(F.struct("order", "section_id")))
    return each.groupBy("paper_id", "key").agg(F.sum("n").alias("count"), F.transform(spots, lambda s: s["section_id"]).alias("cited_in"), F.min_by("section_id", "order").alias("first_context"))


def _keys(entries: DataFrame) -> list[str]:
    return [c for c in ("paper_id", "key") if c in entries.columns]


def largest_file_entries(entries: DataFrame) -> DataFrame:
    """One entry for each key (of each paper): the largest file wins, within a file the last entry."""
    place = F.row_number().over(Window.partitionBy(*_keys(entries)).orderBy(F.desc("size"), "file", F.desc("ordinal")))
    return entries.withColumn("place", place).where("place = 1").drop("place")


def resolve(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """``cited`` with title, authors, year, venue and bib_raw; unresolved keys have nulls and no authors."""
    keys = _keys(entries)
    needed = entries.join(cited.select(*keys).distinct(), keys, "left_semi")
    best = largest_file_entries(needed).select(*keys, "title", "authors", "year", "venue", F.col("raw").alias("bib_raw"))
    return cited.join(best, keys, "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
