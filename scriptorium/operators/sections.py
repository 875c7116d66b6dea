"""Section tree, slices and appendix scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import inline_clean
from scriptorium.functions.udfs import headings

APPENDIX = r"(?m)^[ \t]*+\\(?:appendix|appendices)\b(?!\s*\{)|^[ \t]*+\\begin\{appendi(?:x|ces)\}"


def outlined(docs: DataFrame, find=headings) -> DataFrame:
    """``docs`` with tree, an array of sections, and appendix, where the appendix begins (null without one).

    The appendix begins at the first switch or at the first level-0 title that starts with
    Appendix.  All within the row: no text is shuffled.
    """
    found = docs.withColumn("_heads", find("tex"))
    out = found.withColumn("tree", F.transform("_heads", lambda h: h.withField("title", inline_clean(h["title"])))).drop("_heads")
    switch = F.when(F.col("tex").rlike(APPENDIX), F.length(F.split("tex", APPENDIX, 2)[0]))
    titled = F.get(F.filter("tree", lambda h: (h["level"] == 0) & h["title"].rlike("(?i)^appendi(x|ces)")), F.lit(0))["start"]
    return out.withColumn("appendix", F.least(switch, titled))


def section_tree(docs: DataFrame) -> DataFrame:
    """(paper_id, order, start, end_heading, level, title, ordinal, section_id, parent_id) of all headings."""
    # Outer, as for an inner explode the optimizer filters by the array's size below, and so computes it twice.
    nodes = outlined(docs).select("paper_id", F.posexplode_outer("tree").alias("order", "h")).where("order is not null")
    return nodes.select("paper_id", "order", "h.*").drop("stop", "raw")


def sections(docs: DataFrame, find=headings, of_slice: tuple[str, ...] = ("raw",)) -> DataFrame:
    """The tree with is_appendix, the place where the slice ends (next heading or text end) and the raw slice, or what ``find`` makes of it."""
    out = outlined(docs, find).select("paper_id", "appendix", F.posexplode_outer("tree").alias("order", "h")).where("order is not null")
    return out.select(
        "paper_id", "h.section_id", "h.parent_id", "h.title", "h.level", "h.ordinal", "order", "h.start", "h.stop",
        F.coalesce(F.col("h.start") >= F.col("appendix"), F.lit(False)).alias("is_appendix"), *(f"h.{c}" for c in of_slice),
    )


def cut_appendix(docs: DataFrame) -> DataFrame:
    """``docs`` with the text up to the appendix switch."""
    return docs.withColumn("tex", F.split("tex", APPENDIX, 2)[0])
