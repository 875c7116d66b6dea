"""Section text to Markdown by the rules of ``functions.rules``, all in one kernel a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from scriptorium.functions import udfs
from scriptorium.functions.rules import MATH, RULES
from scriptorium.operators import sections as S

__all__ = ["MATH", "RULES", "apply_rules", "cleaned_sections", "denoise"]


def denoise(df: DataFrame, column: str, out: str = "text") -> DataFrame:
    """``df`` with ``out``: the column cleaned by all rules, math untouched."""
    return df.withColumn(out, udfs.denoised(column))


def cleaned_sections(docs: DataFrame) -> DataFrame:
    """Sections of each (paper_id, tex) with their clean text, markers in it: ``denoise`` of ``markers.marked_documents`` in one kernel."""
    return S.sections(docs, udfs.cleaned_headings, ("text",))


def apply_rules(c: Column, names: list[str]) -> Column:
    """Some rules by name, in the order of the list, on text without math."""
    return udfs.by_rules(c, names)
