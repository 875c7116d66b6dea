"""Figure files against records and assets, texts recovered from LaTeX, and reports of an audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.udfs import strip_comments, visible_segments
from scriptorium.operators import entities as E
from scriptorium.operators.visuals import bucket_counts
from scriptorium.sources.records import VISUAL

# Fixed values of the audit.
ASSET_ENDINGS = [".pdf", ".png", ".jpg", ".jpeg", ".svg", ".eps"]
TOP_PAPERS, SHOWN = 40, 25
PRIORITY = [
    "missing_visual_extraction", "status_vlm_failed", "status_render_failed", "status_codex_prompt_failed", "ok_empty_visible_text", "refusal_like_only_or_too_short",
    "possible_truncated_text",
]


def _keys(*columns: str) -> Column:
    """(priority, key) of the columns that are neither null nor empty."""
    named = (F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(i).alias("priority"), F.col(c).alias("key"))) for i, c in enumerate(columns))
    return F.array_compact(F.array(*named))


def match_records(files: DataFrame, figures: DataFrame) -> DataFrame:
    """``files`` with place, that of the record's figure which they belong to; null without one.

    files: (paper_id, path, file, figure_id, latex_label), path below the paper's folder.  figures:
    (paper_id, place, file, figure_id, latex_label).  A file is looked up by its file name, path, id and
    label in turn, in one set of all names of figures; of figures with the same name the last one counts.
    Rows of ``files`` that agree in paper_id and path have one answer.
    """
    known = figures.select("paper_id", "place", F.explode(_keys("file", "figure_id", "latex_label")).alias("k")).groupBy("paper_id", F.col("k.key").alias("key")).agg(F.max("place").alias("place"))
    asked = files.select("paper_id", "path", F.explode(_keys("file", "path", "figure_id", "latex_label")).alias("k")).select("paper_id", "path", "k.*")
    best = asked.join(known, ["paper_id", "key"]).groupBy("paper_id", "path").agg(F.min_by("place", "priority").alias("place"))
    return files.join(best, ["paper_id", "path"], "left")


def present_assets(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``files`` (paper_id, path, src_ref) with asset_path: a file of the listing beside them, or null.

    The same name with each known ending in turn, then the name of the source reference.
    """
    stem, folder = F.regexp_replace("path", r"\.[^./]*$", ""), F.regexp_extract("path", r"^(?:.*/)?", 0)
    named = F.nullif(F.substring_index("src_ref", "/", -1), F.lit(""))
    wanted = F.array_compact(F.array(*(F.concat(stem, F.lit(e)) for e in ASSET_ENDINGS), F.concat(folder, named)))
    asked = files.select("paper_id", "path", F.posexplode(wanted).alias("priority", "asset_path"))
    best = asked.join(listing.select("paper_id", F.col("path").alias("asset_path")).distinct(), ["paper_id", "asset_path"]).groupBy("paper_id", "path").agg(F.min_by("asset_path", "priority").alias("asset_path"))
    return files.join(best, ["paper_id", "path"], "left")


def latex_fallback(tex: DataFrame, figures: DataFrame) -> DataFrame:
    """(paper_id, figure_id, visual_extraction) of figures whose environment shows a text.

    tex: (paper_id, tex) with comments, as marks of parts are comments.  figures: (paper_id, figure_id,
    latex_label).  The environment is the first with the label, else with the id as its label, else
    for ``fig:N`` the N-th that is not commented out.
    """
    whole = F.concat(F.lit("\\begin{figure}"), "body", F.lit("\\end{figure}"))
    labelled = E.blocks(tex, "figure").select("paper_id", "position", whole.alias("env"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(E.LABEL), F.lit(1)))).alias("name"))
    labelled = labelled.groupBy("paper_id", "name").agg(F.min_by("env", "position").alias("env"))
    plain = tex.select("paper_id", strip_comments("tex").alias("tex"))
    numbered = E.blocks(plain, "figure").select("paper_id", F.concat(F.lit("fig:"), F.col("ordinal") + 1).alias("figure_id"), whole.alias("by_number"))
    asked = figures.withColumn("by_id", F.regexp_replace("figure_id", "^fig:", "")).select("paper_id", "figure_id", F.explode(_keys("latex_label", "by_id")).alias("k"))
    hits = asked.select("paper_id", "figure_id", "k.priority", F.col("k.key").alias("name")).join(labelled, ["paper_id", "name"])
    hits = hits.groupBy("paper_id", "figure_id").agg(F.min_by("env", "priority").alias("by_label"))
    found = figures.select("paper_id", "figure_id").distinct().join(hits, ["paper_id", "figure_id"], "left").join(numbered, ["paper_id", "figure_id"], "left")
    out = found.select("paper_id", "figure_id", visible_segments(F.coalesce("by_label", "by_number")).alias("seen"))
    # By an outer explode of one element, as a filter by the size would go below and find the segments twice.
    out = out.select("paper_id", "figure_id", F.explode_outer(F.filter(F.array("seen"), lambda s: F.size(s) > 0)).alias("seen")).where("seen is not null")

    speakers = F.filter("seen", lambda s: s["role"].isin("prompt", "response"))
    kind = lambda s: F.when(s["role"] == "prompt", "target_query").otherwise("model_response")
    said = F.transform(speakers, lambda s: F.struct(kind(s).alias("kind"), s["text"].alias("text"), s["confidence"].alias("confidence"), F.lit("Recovered from the figure's LaTeX environment.").alias("notes"), F.lit(False).alias("truncated")))
    shown = F.transform("seen", lambda s: F.struct(s["text"].alias("text"), s["region"].alias("region"), s["role"].alias("role"), s["confidence"].alias("confidence"), F.lit(False).alias("truncated")))
    none = F.lit(None).cast("string")
    visual = F.struct(
        F.lit("figure_visual.v0.1").alias("schema_version"), F.lit("ok").alias("status"), none.alias("asset_path"), none.alias("asset_sha256"), none.alias("model"), none.alias("backend"), none.alias("extracted_at"),
        F.when(F.size(speakers) > 0, "jailbreak_prompt").otherwise("other").alias("figure_role"), shown.alias("visible_text"), said.alias("safety_relevant_content"),
        F.lit("Text recovered from the figure's LaTeX environment.").alias("summary"), F.array(F.lit("Recovered from LaTeX, as no image file was present.")).alias("uncertain"),
        F.array(F.lit("extracted_from_latex_figure_environment")).alias("warnings"),
    )
    return out.select("paper_id", "figure_id", visual.cast(VISUAL).alias("visual_extraction"))


def summary(classified: DataFrame) -> DataFrame:
    """(part, place, key, n, line): the rows of an audit's summary, in order within a part.

    classified: (paper_id, figure_file, status, buckets, strict, text_chars, asset_path).  Parts: total,
    status, bucket, paper (the 40 with most issues) and one for each urgent bucket with 25 figures.
    """
    issue = ~F.array_contains("buckets", "ok")

    def ranked(part: str, counted: DataFrame, most: int | None = None) -> DataFrame:
        # A status, a bucket or the top of the papers: the window has few rows.
        few = counted.orderBy(F.desc("n"), "key").limit(most) if most else counted
        place = F.row_number().over(Window.orderBy(F.desc("n"), "key"))
        return few.select(F.lit(part).alias("part"), place.alias("place"), "key", "n", F.format_string("- `%s`: %d", "key", "n").alias("line"))

    total = classified.agg(F.count("*").alias("figures"), F.count_if("strict").alias("strict"), F.count_if(issue).alias("issues"))
    total = total.select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in ("figures", "strict", "issues")))).alias("i", "x"))
    parts = [
        total.select(F.lit("total").alias("part"), (F.col("i") + 1).alias("place"), "x.key", "x.n", F.format_string("- %s: %d", "x.key", "x.n").alias("line")),
        ranked("status", classified.groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n"))),
        ranked("bucket", bucket_counts(classified, []).withColumnRenamed("bucket", "key")),
        ranked("paper", classified.where(issue).groupBy(F.col("paper_id").alias("key")).agg(F.sum(F.size("buckets")).alias("n")), TOP_PAPERS),
    ]
    urgent = classified.select("*", F.explode(F.array_intersect("buckets", F.array(*map(F.lit, PRIORITY)))).alias("bucket"))
    # A bucket may hold most figures: the first of each part of it are ranked before all of them are.
    split = urgent.withColumn("_part", F.pmod(F.xxhash64("paper_id", "figure_file"), F.lit(64)))
    order = ["paper_id", "figure_file"]
    few = split.withColumn("_r", F.row_number().over(Window.partitionBy("bucket", "_part").orderBy(*order))).where(F.col("_r") <= SHOWN)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("place") <= SHOWN)
    line = F.format_string("- `%s` `%s` status=`%s` chars=%d asset=`%s`", "paper_id", "figure_file", "status", "text_chars", F.coalesce("asset_path", F.lit("")))
    parts.append(few.select("bucket", "place", F.col("figure_file").alias("key"), F.col("text_chars").cast("long").alias("n"), line.alias("line")).withColumnRenamed("bucket", "part"))
    return reduce(DataFrame.unionByName, parts)


def write_reports(classified: DataFrame, folder: str) -> None:
    """The audit as JSON and CSV (all figures, strict issues, refusals and cut texts), and its summary; each a folder of parts.

    classified is read several times, so it should be a stored table.
    """
    shown = ["paper_id", "figure_file", "figure_id", "status", "buckets", "strict", "text_chars", "text_words", "refusal_markers", "maybe_truncated", "asset_path", "caption_chars"]
    rows = classified.select(*(c for c in shown if c in classified.columns))
    flat = rows.withColumns({c: F.array_join(c, ";") for c in ("buckets", "refusal_markers") if c in rows.columns})
    rows.write.mode("overwrite").json(f"{folder}/figure_text_audit.json", ignoreNullFields=False)
    for name, when in {
        "figure_text_audit": F.lit(True), "strict_issues": F.col("strict"), "truncated_review": F.col("buckets").contains("possible_truncated_text"), "refusal_context_review": F.col("buckets").contains("contains_refusal_text_rich_context"),
    }.items():
        flat.where(when).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True, escape='"')
    # The summary has a bounded number of lines, so one task writes them in order.
    head = F.when(F.col("place") == 1, F.concat(F.lit("\n## "), "part", F.lit("\n\n"))).otherwise("")
    first = F.when(F.col("part") == "total", 0).otherwise(1)
    ordered = summary(classified).withColumn("first", first).coalesce(1).sortWithinPartitions("first", "part", "place")
    ordered.select(F.concat(head, "line").alias("value")).write.mode("overwrite").text(f"{folder}/SUMMARY.md")
