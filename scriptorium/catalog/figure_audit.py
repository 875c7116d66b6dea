"""Queries that match figure files to records and assets, recover texts from LaTeX, and sum up an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog.common import register
from scriptorium.catalog.visuals import STATS, figures_of_turns
from scriptorium.operators import figure_audit as A
from scriptorium.operators import visuals as V
from scriptorium.sources.synthetic import escaped
from scriptorium.sources.tables import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as a figure file of its user's paper."""
    n = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("user_id").cast("string").alias("paper_id"), F.concat(F.lit("figures/fig-"), n, F.lit(".json")).alias("path"), F.concat(F.lit("fig-"), n, F.lit(".json")).alias("file"),
        F.concat(F.lit("fig:"), n).alias("figure_id"), F.concat(F.lit("label-"), n).alias("latex_label"), F.concat(F.lit("img/x"), n, F.lit(".bmp")).alias("src_ref"),
    )


@register("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 10 = 5 THEN event_id + 1000000000000 ELSE event_id END AS place FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL")
def figure_record_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the figures is known by each of file, path, id and label; some names are used twice, some by a later way too."""
    n, none = F.col("event_id"), F.lit(None).cast("string")
    files = _files(spark, sf_dir).where("event_id is not null and user_id is not null")
    record = files.select(
        "paper_id", n.alias("place"), F.when(n % 5 == 0, F.col("file")).when(n % 5 == 1, F.col("path")).otherwise("").alias("file"),
        F.when(n % 5 == 2, F.col("figure_id")).alias("figure_id"), F.when(n % 5 == 3, F.col("latex_label")).alias("latex_label"),
    )
    again = files.where(n % 10 == 5).select("paper_id", (n + 10**12).alias("place"), "file", none.alias("figure_id"), none.alias("latex_label"))
    lesser = files.where(n % 10 == 0).select("paper_id", (n + 10**12).alias("place"), F.lit("").alias("file"), none.alias("figure_id"), "latex_label")
    return A.match_records(files, record.unionByName(again).unionByName(lesser)).select("event_id", "place")


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'figures/fig-' || CAST(event_id AS VARCHAR) || '.pdf' WHEN 1 THEN 'figures/fig-' || CAST(event_id AS VARCHAR) || '.eps'
  WHEN 2 THEN 'figures/x' || CAST(event_id AS VARCHAR) || '.bmp' END AS asset_path FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL""")
def figure_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files beside a figure: two of its name, one, one of its reference's name, or one elsewhere."""
    n = F.col("event_id")
    files = _files(spark, sf_dir).where("event_id is not null and user_id is not null")
    beside = lambda head, end: F.concat(F.lit(f"figures/{head}"), n.cast("string"), F.lit(end))
    paths = (
        F.when(n % 4 == 0, F.array(beside("fig-", ".png"), beside("fig-", ".pdf"), beside("x", ".bmp"))).when(n % 4 == 1, F.array(beside("fig-", ".eps")))
        .when(n % 4 == 2, F.array(beside("x", ".bmp"))).otherwise(F.array(F.col("src_ref")))
    )
    return A.present_assets(files, files.select("paper_id", F.explode(paths).alias("path"))).select("event_id", "asset_path")


_SHOWN = r"""WITH d AS (SELECT doc_id, trim(regexp_replace(translate(text, '{}~^' || chr(92), '     '), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), w AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN doc_id % 6 = 3 THEN t || ' ' || t ELSE t END, '[][();]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM d)"""


@register(_SHOWN + """ SELECT doc_id, r.role, r.region, md5(t) AS shown FROM w, (VALUES ('prompt', 'latex_marker:user_input'), ('response', 'latex_marker:model_output')) r(role, region) WHERE doc_id % 6 = 0 AND t <> ''
UNION ALL SELECT doc_id, 'prompt', 'latex_mybox:first-prompt-' || CAST(doc_id AS VARCHAR), md5('First Prompt ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || t) FROM w WHERE doc_id % 3 = 1 AND t <> ''
UNION ALL SELECT doc_id, 'other', 'latex_figure_environment', md5(plain) FROM w WHERE (doc_id % 3 = 2 OR doc_id % 6 = 3) AND plain <> ''""")
def figure_latex_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in figures: marked parts, a box, or neither; odd ones have no label and are found by number."""
    n = F.col("doc_id")
    flat = F.trim(F.regexp_replace(escaped(F.col("text")), r"\s+", " "))
    odd = n % 2 != 0

    def part(name: str) -> Column:
        return F.concat(F.lit(f"% ===== {name} Begin =====\n"), flat, F.lit(f"\n% ===== {name} End =====\n"))

    body = (
        F.when(n % 3 == 0, F.concat(part("User Input"), part("GPT Output")))
        .when(n % 3 == 1, F.concat(F.lit("\\begin{mybox}{\\textbf{First Prompt "), n.cast("string"), F.lit("}}\n"), flat, F.lit("\n\\end{mybox}\n")))
        .otherwise(flat)
    )
    label = F.when(odd, F.lit("")).otherwise(F.concat(F.lit("\n\\label{fig:c"), n.cast("string"), F.lit("}")))
    tex = F.concat(F.lit("% \\begin{figure}\n% none\n% \\end{figure}\n\\begin{figure}[t]\n"), body, label, F.lit("\n\\end{figure}\n"))
    docs = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select(n.cast("string").alias("paper_id"), tex.alias("tex"))
    number = F.col("paper_id").cast("long")
    figures = docs.select("paper_id", F.when(number % 2 != 0, "fig:1").otherwise("fig:chat").alias("figure_id"), F.when(number % 2 == 0, F.concat(F.lit("fig:c"), "paper_id")).alias("latex_label"))
    seen = A.latex_fallback(docs, figures).select("paper_id", F.explode("visual_extraction.visible_text").alias("s"))
    return seen.select(F.col("paper_id").cast("long").alias("doc_id"), "s.role", "s.region", F.md5("s.text").alias("shown"))


@register(STATS + """, p AS (SELECT *, 'p' || CAST(conv_id % 97 AS VARCHAR) AS paper_id FROM bk), a AS (
  SELECT 'total' AS part, 'figures' AS key, count(*) AS n, 1 AS place FROM p UNION ALL SELECT 'total', 'strict', count(*) FILTER (list_has_any(buckets, """ + "[" + ", ".join(f"'{s}'" for s in V.STRICT) + "]" + """)), 2 FROM p
  UNION ALL SELECT 'total', 'issues', count(*) FILTER (buckets <> ['ok']), 3 FROM p
  UNION ALL SELECT 'status', status, count(*), row_number() OVER (ORDER BY count(*) DESC, status) FROM p GROUP BY status
  UNION ALL SELECT 'bucket', bucket, count(*), row_number() OVER (ORDER BY count(*) DESC, bucket) FROM (SELECT unnest(buckets) AS bucket FROM p) GROUP BY bucket
  UNION ALL SELECT * FROM (SELECT 'paper', paper_id, sum(len(buckets)), row_number() OVER (ORDER BY sum(len(buckets)) DESC, paper_id) AS place FROM p WHERE buckets <> ['ok'] GROUP BY paper_id) WHERE place <= 40
  UNION ALL SELECT bucket, f, n, place FROM (SELECT bucket, f, n, row_number() OVER (PARTITION BY bucket ORDER BY paper_id, f) AS place FROM (
    SELECT unnest(buckets) AS bucket, paper_id, 'fig-' || CAST(conv_id AS VARCHAR) || '.json' AS f, length(joined) AS n FROM p)) WHERE place <= 25 AND bucket IN (""" + ", ".join(f"'{b}'" for b in A.PRIORITY) + """)
) SELECT part, CAST(place AS BIGINT) AS place, key, CAST(n AS BIGINT) AS n FROM a""")
def figure_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of an audit of all conversations as figures of 97 papers; its top lists are a feature of the report."""
    n = F.col("conv_id")
    rows = V.buckets(figures_of_turns(spark, sf_dir)).select(
        F.concat(F.lit("p"), (n % 97).cast("string")).alias("paper_id"), F.concat(F.lit("fig-"), n.cast("string"), F.lit(".json")).alias("figure_file"),
        "status", "buckets", "strict", "text_chars", F.lit("").alias("asset_path"),
    )
    return A.summary(rows).select("part", F.col("place").cast("long").alias("place"), "key", F.col("n").cast("long").alias("n"))
