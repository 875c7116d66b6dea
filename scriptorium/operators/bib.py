"""Bibliography files as entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.udfs import bib_entries

# Fields that name the venue, by priority.
VENUE = ["booktitle", "journal", "conference", "proceedings", "publisher", "school", "institution", "howpublished"]


def entries(files: DataFrame) -> DataFrame:
    """(file, size, ordinal, key, type, title, authors, year, venue, raw) of (file, size, content); a paper_id stays."""
    own = ["paper_id"] if "paper_id" in files.columns else []
    # Outer, as for an inner explode the optimizer filters by the array's size below, and so computes it twice.
    rows = files.select(*own, "file", "size", F.posexplode_outer(bib_entries("content", ["year", *VENUE])).alias("ordinal", "e")).where("ordinal is not null")

    def field(name: str):
        value = F.regexp_replace(F.regexp_replace(F.try_element_at("e.fields", F.lit(name)), r"\\[A-Za-z]+\s*|[{}]", ""), r"[.,\s]+$", "")
        return F.nullif(F.regexp_replace(value, r"\s+", " "), F.lit(""))

    return rows.select(*own, "file", "size", "ordinal", "e.key", "e.type", "e.title", "e.authors", field("year").alias("year"), F.coalesce(*map(field, VENUE)).alias("venue"), "e.raw")
