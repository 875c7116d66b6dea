"""Citations, references and footnotes as markers in text and as ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import udfs
from scriptorium.functions.rules import CITE, REF
from scriptorium.functions.text import strip
from scriptorium.operators import sections as S


def _names(arguments: Column) -> Column:
    """Trimmed names of comma-separated arguments, in order, repeats kept."""
    return F.filter(F.transform(F.flatten(F.transform(arguments, lambda a: F.split(a, ","))), strip), lambda n: n != "")


def cites(text: Column) -> Column:
    return _names(F.regexp_extract_all(text, F.lit(CITE), F.lit(1)))


def refs(text: Column) -> Column:
    return _names(F.regexp_extract_all(text, F.lit(REF), F.lit(1)))


mark_cites, mark_refs = udfs.mark_cites, udfs.mark_refs


def marked_sections(sections: DataFrame) -> DataFrame:
    """``sections`` with cites, refs, notes (number, text) and the slice with markers in ``marked``.

    Footnotes count through the paper in section order.  ``marked_documents`` does the same for whole documents, without a window.
    """
    out = sections.withColumn("cites", cites(F.col("raw"))).withColumn("refs", refs(F.col("raw"))).withColumn("_m", udfs.noted("raw"))
    out = out.withColumn("bodies", F.col("_m.bodies")).withColumn("rest", F.col("_m.rest"))
    upto = Window.partitionBy("paper_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("first", F.coalesce(F.sum(F.size("bodies")).over(upto), F.lit(0)).cast("int"))
    signs = F.transform("rest", lambda g, i: F.when(i < F.size("bodies"), F.concat(g, F.lit("[^fn:"), (F.col("first") + i + 1).cast("string"), F.lit("]"))).otherwise(g))
    notes = F.transform("bodies", lambda b, i: F.struct((F.col("first") + i + 1).alias("number"), strip(b).alias("text")))
    return out.withColumn("marked", F.array_join(signs, "")).withColumn("notes", notes).drop("_m", "bodies", "rest", "first")


def marked_documents(docs: DataFrame) -> DataFrame:
    """The same for the sections of each (paper_id, tex), without raw: all within the row, so no text is shuffled."""
    return S.sections(docs, udfs.marked_headings, ("cites", "refs", "notes", "marked"))


def footnotes(marked: DataFrame) -> DataFrame:
    return marked.select("paper_id", "section_id", F.explode("notes").alias("n")).select("paper_id", "section_id", F.concat(F.lit("fn:"), F.col("n.number")).alias("footnote_id"), F.col("n.text").alias("text"))
