"""Source trees as tables: scan, unpack, pick the main file, flatten, prepare."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import udfs
from scriptorium.plans.session import ship


def scan_trees(spark: SparkSession, root: str, glob: str = "*", paper_id: str | None = None) -> DataFrame:
    """(paper_id, path, size, content) of all files under ``root``; the first folder is the paper, unless it is given."""
    ship(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rest = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted("/" + root.split(":", 1)[-1].strip("/")) + "/", "")
    paper, path = (F.lit(paper_id), rest) if paper_id else (F.substring_index(rest, "/", 1), F.regexp_replace(rest, "^[^/]*/", ""))
    return raw.select(paper.alias("paper_id"), path.alias("path"), F.col("length").alias("size"), "content")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def unpack(archives: DataFrame) -> DataFrame:
    """(paper_id, path, size, content) of the regular files in tar archives.

    Members with absolute paths or ``..`` and links are left out, as they could reach outside
    the tree.  An unreadable archive gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paper, content in zip(batch.column("paper_id").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content or b"")) as tar:
                        for m in tar:
                            if m.isfile() and not m.name.startswith("/") and ".." not in m.name.split("/"):
                                rows.append((m.name.removeprefix("./"), tar.extractfile(m).read()))
                except (tarfile.TarError, EOFError, OSError):
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([paper] * len(rows)), pa.array([r[0] for r in rows]), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["paper_id", "path", "size", "content"])

    return archives.select("paper_id", "content").mapInArrow(run, "paper_id string, path string, size long, content binary")


def missing(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested papers without a cached tree: no marker file, or no .tex."""
    whole = files.groupBy("paper_id").agg(F.bool_or(F.col("path") == ".complete").alias("marked"), F.bool_or(F.col("path").endswith(".tex")).alias("tex")).where("marked and tex")
    return requested.join(whole, "paper_id", "left_anti")


def text_of(content: Column) -> Column:
    """UTF-8 text; what can't be decoded is empty."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit(""))


def main_files(trees: DataFrame) -> DataFrame:
    """(paper_id, main): by begin-document, top level, usual name, number of lines, then path."""
    tex = trees.where(F.col("path").endswith(".tex")).withColumn("text", text_of(F.col("content")))
    begins, lines = F.col("text").contains("\\begin{document}"), F.size(F.split("text", "\n"))
    able = tex.where(begins | F.col("text").contains("\\documentclass"))
    usual = F.substring_index("path", "/", -1).isin("main.tex", "paper.tex", "index.tex")
    place = Window.partitionBy("paper_id").orderBy(begins.desc(), F.col("path").contains("/"), usual.desc(), lines.desc(), "path")
    return able.withColumn("_place", F.row_number().over(place)).where("_place = 1").select("paper_id", F.col("path").alias("main"))


def flattened(trees: DataFrame) -> DataFrame:
    """(paper_id, tex): each paper's main file with its inputs in place."""
    tex = trees.where(F.col("path").endswith(".tex")).select("paper_id", F.struct("path", text_of(F.col("content")).alias("text")).alias("f"))
    whole = tex.groupBy("paper_id").agg(F.collect_list("f").alias("files")).join(main_files(trees), "paper_id")
    return whole.select("paper_id", udfs.flatten_files("files.path", "files.text", "main").alias("tex"))


def prepared(docs: DataFrame, macros: bool = True) -> DataFrame:
    """Comments out, own macros expanded; all later places refer to this text."""
    out = docs.withColumn("tex", udfs.strip_comments("tex"))
    return out.withColumn("tex", udfs.expand_macros("tex")) if macros else out


def bib_files(trees: DataFrame) -> DataFrame:
    """(paper_id, file, size, content, place): .bib files, the largest first."""
    order = Window.partitionBy("paper_id").orderBy(F.desc("size"), "path")
    return trees.where(F.col("path").endswith(".bib")).select("paper_id", F.col("path").alias("file"), "size", text_of(F.col("content")).alias("content"), F.row_number().over(order).alias("place"))


def source_folders(trees: DataFrame, preferred: str = "arxiv-to-prompt") -> DataFrame:
    """(paper_id, folder): the preferred folder below source/ if it holds .tex, else the first that does."""
    tex = trees.where(F.col("path").rlike(r"^(?:.*/)?source/.*\.tex$")).select("paper_id", F.regexp_extract("path", r"^((?:.*/)?source(?:/[^/]+)?)/.*$", 1).alias("folder"))
    return tex.groupBy("paper_id").agg(F.min_by("folder", F.struct(~F.col("folder").endswith("/" + preferred), "folder")).alias("folder"))


def resolve_assets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` (paper_id, ref) with path: exact, with a known extension, by name anywhere, by name and extension anywhere.

    Ties go to the smallest path; what is not found has a null path.
    """
    # Extensions by priority.
    known = [".pdf", ".png", ".jpg", ".jpeg", ".eps", ".svg"]
    ref = F.regexp_replace("ref", r"^\./", "")
    tails = F.array(F.lit(""), *map(F.lit, known))
    base = F.substring_index("ref", "/", -1)
    keys = F.flatten(F.array(
        F.transform(tails, lambda t, i: F.struct(i.alias("priority"), F.lit("path").alias("by"), F.concat(ref, t).alias("key"))),
        F.transform(tails, lambda t, i: F.struct((i + 100).alias("priority"), F.lit("name").alias("by"), F.concat(base, t).alias("key"))),
    ))
    asked = refs.select("paper_id", "ref").distinct().withColumn("k", F.explode(keys)).select("paper_id", "ref", "k.*")
    names = files.select("paper_id", "path", F.explode(F.array(F.struct(F.lit("path").alias("by"), F.col("path").alias("key")), F.struct(F.lit("name").alias("by"), F.substring_index("path", "/", -1).alias("key")))).alias("n")).select("paper_id", "path", "n.*")
    best = asked.join(names, ["paper_id", "by", "key"]).groupBy("paper_id", "ref").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return refs.join(best, ["paper_id", "ref"], "left")
