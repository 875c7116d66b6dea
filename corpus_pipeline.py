"""A training-data pipeline of five stages over ``documents``.

Language ID drops documents without a language, MinHash keeps one document of each group
of near copies, substring dedup cuts repeated passages, the secret scan masks live-looking
secrets, and packing lays what is left out in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import langid, minhash, packing, recompress, secrets_scan
from scriptorium.plans.scratch import Scratch
from scriptorium.sources.tables import table

#: Words of a shingle and percent of similarity of near copies; words of a repeated passage.
SHINGLE, SIMILAR, WINDOW = 5, 80, 50


def _named(column: str):
    return F.col("`" + column.replace("`", "``") + "`")


def _sealed(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns and, as ``sealed``, all others: no name of theirs meets one of an operator's own."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*(_named(c).alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("none")).alias("sealed"))


def _opened(sealed: DataFrame, docs: DataFrame, *used: str, **changed) -> DataFrame:
    """The columns of ``docs`` again, with the texts of ``sealed`` and the changed columns."""
    others = [c for c in docs.columns if c not in used]
    place = {c: f"c{i}" for i, c in enumerate(others)}
    return sealed.select(*(changed[c].alias(c) if c in changed else F.col(f"sealed.{place[c]}").alias(c) if c in place else F.col(c) for c in docs.columns))


def _length(docs: DataFrame) -> dict:
    """The length of a new text, where ``docs`` has a column for it."""
    return {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from this stage's own labelled documents.

    Where it learns no language, only texts that are null or have no letter go.
    """
    model = langid.train(docs.where(~langid.held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = langid.predict(_sealed(docs, "text"), model)
    return _opened(known.where(F.col("lang_pred") != langid.UNDETERMINED), docs, "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, and all others."""
    verdict = minhash.near_duplicates(docs, SHINGLE, SIMILAR)
    dropped = verdict.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*map(_named, docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller document has; documents of which nothing is left go."""
    cut = recompress.substring_dedup(_sealed(docs, "doc_id", "text"), WINDOW)
    out = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return _opened(out.withColumn("text", text), docs, "doc_id", "text", **_length(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked; rows without a source count as owned by their text."""
    length = _length(docs)
    return secrets_scan.redact(docs).select(*(length[c].alias(c) if c in length else _named(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return packing.pack_documents(docs, *map(public_tokenizers.path, names))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_dedup", near_copies),
    ("substring_dedup", passages),
    ("secret_scan", secrets),
    ("best_fit_packing", pack),
]
#: SQL can't express the first three stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each result written as Parquet and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
