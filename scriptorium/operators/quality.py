"""What cleaning left behind, findings about records, and their distributions over a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.operators.clean import MATH
from scriptorium.plans.scratch import Scratch

# Fixed values of the audit.
EXPECTED_SCHEMA = "0.5"
RESIDUE_HIGH, EMPTY_SHARE, LONG_LANGUAGE = 25, 0.30, 30
FAILED = ["asset_missing", "unsupported_asset", "render_failed", "codex_prompt_failed", "vlm_failed"]
#: Ranges into which the distinct values of a metric are cut.
RANGES = 256
SEVERITIES = ["HIGH", "MED", "LOW", "INFO"]


def _commands(sections: DataFrame) -> DataFrame:
    prose = F.regexp_replace("text", MATH, " ")
    return sections.select("paper_id", "section_id", "order", F.posexplode(F.regexp_extract_all(prose, F.lit(r"\\[a-zA-Z]+"), F.lit(0))).alias("at", "command"))


def residue(sections: DataFrame, k: int = 20) -> DataFrame:
    """(paper_id, command, n, place): the most frequent commands outside math, ties by first occurrence."""
    counted = _commands(sections).groupBy("paper_id", "command").agg(F.count("*").alias("n"), F.min(F.struct("order", "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).where(F.col("place") <= k).drop("first")


def residue_sections(sections: DataFrame) -> DataFrame:
    """(paper_id, residue_section_count) of papers that have any."""
    some = sections.where(F.regexp_replace("text", MATH, " ").rlike(r"\\[a-zA-Z]"))
    return some.groupBy("paper_id").agg(F.count("*").alias("residue_section_count"))


def joined(sections: DataFrame, gap: str = "\n\n") -> DataFrame:
    """(paper_id, text): texts of a paper's sections in order."""
    parts = F.array_sort(F.collect_list(F.struct("order", "text")))
    return sections.groupBy("paper_id").agg(F.array_join(F.transform(parts, lambda s: s["text"]), gap).alias("text"))


def distributions(values: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, papers, low, p50, p95, high, mean); p95 is the value at place floor(0.95 (n - 1)) of the sorted ones.

    Values are counted first.  The distinct ones are cut into ranges of about equal number, at
    bounds from a sketch; places follow from the ranges' totals and from running counts within
    a range, so no task sorts all values of a metric.
    """
    tall = values.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select("x.*").where("v is not null")
    # Stored, as bounds, ranges and places read it, and it may come from texts.
    counted = Scratch(values.sparkSession, "distributions").keep(tall.groupBy("metric", "v").agg(F.count("*").alias("n")))
    bounds = counted.groupBy("metric").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10000).alias("bounds"))
    ranged = counted.join(F.broadcast(bounds), "metric").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds")
    sums = ranged.groupBy("metric", "range").agg(F.sum("n").alias("inside"))
    w = Window.partitionBy("metric")
    before = sums.withColumn("before", F.sum("inside").over(w.orderBy("range")) - F.col("inside")).withColumn("total", F.sum("inside").over(w)).drop("inside")
    # One row a metric above, RANGES rows a metric here.
    inner = F.sum("n").over(Window.partitionBy("metric", "range").orderBy("v"))
    placed = ranged.withColumn("inner", inner).join(F.broadcast(before), ["metric", "range"]).withColumn("upto", F.col("before") + F.col("inner"))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("v")))

    n = F.col("total")
    return placed.groupBy("metric").agg(
        F.sum("n").alias("papers"), F.min("v").alias("low"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("p50"),
        at(F.floor(F.lit(0.95) * (n - 1))).alias("p95"), F.max("v").alias("high"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 3).alias("mean"),
    )


def findings(records: DataFrame, expected_schema: str = EXPECTED_SCHEMA) -> DataFrame:
    """(paper_id, severity, kind, detail): one row for each failed check of a record.

    All checks are one array of nullable structs, so a record is read once.  A record whose
    ``corrupt`` column is set could not be parsed and has that finding alone.
    """
    def blank(c: str) -> Column:
        return F.coalesce(strip(F.col(c)), F.lit("")) == ""

    def count(array: str, test) -> Column:
        return F.size(F.filter(F.coalesce(F.col(array), F.array()), test))

    def found(when: Column, severity: str, kind: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))

    n = F.coalesce(F.size("sections"), F.lit(0))
    empty = F.size(F.filter("sections", lambda s: F.coalesce(strip(s["text"]), F.lit("")) == ""))
    odd = F.filter("listings", lambda x: F.coalesce(x["language"].contains("\n") | (F.length(x["language"]) > LONG_LANGUAGE), F.lit(False)))
    counts = F.transform("residue_top", lambda r: r["count"])
    resolved = F.size(F.filter("citations", lambda c: F.coalesce(c["title"], F.lit("")) != ""))
    status = F.transform("figures", lambda f: F.coalesce(f["status"], F.lit("missing")))
    missing, failed = F.size(F.filter(status, lambda s: s == "missing")), F.size(F.filter(status, lambda s: s.isin(FAILED)))
    checks = [
        found(F.coalesce(F.col("schema_version"), F.lit("")) != expected_schema, "HIGH", "schema_mismatch", F.col("schema_version")),
        found(n <= 1, "HIGH", "too_few_sections", n),
        found((n > 0) & (empty / n > EMPTY_SHARE), "MED", "many_empty_sections", F.concat_ws("/", empty, n)),
        found(blank("title"), "HIGH", "empty_title", F.col("title_source")),
        found(blank("abstract"), "MED", "empty_abstract", F.col("abstract_source")),
        found(F.size(odd) > 0, "HIGH", "listing_language_is_content", F.get(odd, F.lit(0))["id"]),
        found(F.array_max(counts) >= RESIDUE_HIGH, "MED", "high_residue_command", F.get("residue_top", F.lit(0))["command"]),
        found((F.size("citations") > 0) & (resolved == 0), "LOW", "zero_citation_resolution", F.size("citations")),
        found((F.size("figures") > 0) & ~F.col("has_binary"), "LOW", "figures_without_binary", F.size("figures")),
        found(missing > 0, "LOW", "figures_missing_visual_extraction", F.concat_ws("/", missing, F.size("figures"))),
        found(failed > 0, "LOW", "figures_visual_extraction_failed", failed),
    ]
    bad = F.array(F.struct(F.lit("HIGH").alias("severity"), F.lit("unreadable_paper_json").alias("kind"), F.lit(None).cast("string").alias("detail")))
    return records.select("paper_id", F.explode(F.when(F.col("corrupt").isNotNull(), bad).otherwise(F.array_compact(F.array(*checks)))).alias("f")).select("paper_id", "f.*")


def finding_counts(found: DataFrame, examples: int = 5) -> DataFrame:
    """(severity, kind, n, place, examples): kinds by severity and size, with the first papers by id.

    Examples come from a ranked prefix, so a frequent kind never gathers all its papers.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    per_paper = found.groupBy("severity", "kind", "paper_id").agg(F.count("*").alias("n"))
    total = per_paper.groupBy("severity", "kind").agg(F.sum("n").alias("n"))
    parted = per_paper.withColumn("_part", F.pmod(F.xxhash64("paper_id"), F.lit(64)))
    few = parted.withColumn("_r", F.row_number().over(Window.partitionBy("severity", "kind", "_part").orderBy("paper_id"))).where(F.col("_r") <= examples)
    shown = few.groupBy("severity", "kind").agg(F.slice(F.array_sort(F.collect_list("paper_id")), 1, examples).alias("examples"))
    place = F.row_number().over(Window.orderBy(rank, F.desc("n"), "kind"))  # one row a kind
    return total.join(shown, ["severity", "kind"]).withColumn("place", place)


def status_counts(figures: DataFrame) -> DataFrame:
    """(paper_id, status, n), a null or empty status as missing."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("missing"))
    return figures.groupBy("paper_id", status.alias("status")).agg(F.count("*").alias("n"))


def figure_differences(records: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, figure_id, problem): figures of the record without a file, files without a figure, ids used twice."""
    key = ["paper_id", "figure_id"]
    parts = [
        records.select(*key).distinct().join(files.select(*key).distinct(), key, "left_anti").withColumn("problem", F.lit("no_file")),
        files.select(*key).distinct().join(records.select(*key).distinct(), key, "left_anti").withColumn("problem", F.lit("no_record")),
        records.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("duplicate_id").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, parts)
