"""Queries on source trees and whole records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog.common import ENTITIES, LINES, TREE, register
from scriptorium.operators import entities as E
from scriptorium.operators import record as R
from scriptorium.plans.scratch import Scratch
from scriptorium.sources import files as S
from scriptorium.sources.folder_view import folder_rows
from scriptorium.sources.synthetic import bibliography, latex
from scriptorium.sources.tables import table

_ID = "CAST(doc_id AS VARCHAR)"


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source trees: some main files are named otherwise, inputs nest and repeat, two .bib files, images, a marker file."""
    d, n = F.col("doc_id").cast("string"), F.col("doc_id")

    def file(path, content, when: Column | None = None) -> Column:
        s = F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), (F.lit(content) if isinstance(content, str) else content).alias("text"))
        return s if when is None else F.when(when, s)

    main = F.concat(F.lit("\\documentclass{a}\n\\begin{document}\nA"), d, F.lit(" \\input{parts/one}\n% \\input{parts/two}\n\\include{parts/one}\\input{parts/none}\n\\end{document}\n"))
    files = F.array_compact(F.array(
        file(F.when(n % 3 == 0, "main.tex").otherwise("article.tex"), main), file("parts/one.tex", F.concat(F.lit("one"), d, F.lit(" \\input{parts/two.tex}"))), file("parts/two.tex", "two"),
        file("style/0-preamble.tex", "\\documentclass{b}\n\n\n\n\n\n"), file("zz.tex", "\\begin{document} short", n % 4 == 0), file("small.bib", "@misc{a, title={x}}"),
        file("refs/large.bib", F.concat(F.lit("@misc{a, title={y}}"), F.repeat(F.lit(" "), F.pmod(n, F.lit(5)).cast("int") * 10 + 1))),
        file("img/plot.png", "p", n % 2 == 0), file("img/plot.pdf", "p"), file("deep/img/other.JPG", "p"), file("deep/img/third.jpg", "p"), file(".complete", "", n % 5 != 0),
    ))
    rows = table(spark, sf_dir, "documents").select(d.alias("paper_id"), F.explode(files).alias("f"))
    return rows.select("paper_id", "f.path", F.length("f.text").cast("long").alias("size"), F.col("f.text").cast("binary").alias("content"))


@register(f"SELECT {_ID} AS paper_id, CASE WHEN doc_id % 3 = 0 THEN 'main.tex' ELSE 'article.tex' END AS main FROM documents")
def main_file_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.main_files(_trees(spark, sf_dir))


@register(f"""SELECT {_ID} AS paper_id, chr(92) || 'documentclass{{a}}' || chr(10) || chr(92) || 'begin{{document}}' || chr(10) || 'A' || {_ID} || ' one' || {_ID} || ' two' || chr(10) || '% ' || chr(92) || 'input{{parts/two}}' || chr(10) || chr(10) || chr(92) || 'end{{document}}' || chr(10) AS tex FROM documents""")
def flattened_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flattened(_trees(spark, sf_dir))


@register(f"SELECT {_ID} AS paper_id, f AS file, CAST(p AS INTEGER) AS place FROM documents, (VALUES ('refs/large.bib', 1), ('small.bib', 2)) b(f, p)")
def bib_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bib_files(_trees(spark, sf_dir)).select("paper_id", "file", "place")


@register(f"SELECT {_ID} AS paper_id FROM documents WHERE doc_id % 5 = 0")
def trees_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested papers without a complete cached tree."""
    requested = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"))
    return S.missing(requested, _trees(spark, sf_dir))


@register(f"""SELECT {_ID} AS paper_id, ref, path FROM documents, (VALUES ('img/plot', 'img/plot.pdf'), ('./img/plot.pdf', 'img/plot.pdf'), ('other.JPG', 'deep/img/other.JPG'), ('figs/third', 'deep/img/third.jpg'), ('nothing', NULL)) r(ref, path)""")
def asset_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = _trees(spark, sf_dir)
    asked = F.explode(F.array(*map(F.lit, ["img/plot", "./img/plot.pdf", "other.JPG", "figs/third", "nothing"]))).alias("ref")
    refs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), asked)
    return S.resolve_assets(refs, trees.select("paper_id", "path"))


_COUNTS = ENTITIES + """, k AS (SELECT doc_id, count(*) FILTER (kind = 'figure') AS f, count(*) FILTER (kind = 'table') AS t, count(*) FILTER (kind = 'equation') AS e, count(*) FILTER (kind = 'algorithm') AS a, count(*) FILTER (kind = 'listing') AS l FROM en GROUP BY 1
), s AS (SELECT doc_id, paper_id, count(*) AS n, count(*) FILTER (i >= 20) AS x, string_agg(section_id, ',' ORDER BY i) AS ids FROM sec GROUP BY 1, 2
), c AS (SELECT doc_id, count(DISTINCT key) AS n, count(DISTINCT key) FILTER (CAST(substr(key, 2) AS INTEGER) < 80) AS ok FROM ct GROUP BY 1
), fn AS (SELECT doc_id, count(*) AS n FROM pl WHERE i % 8 = 5 GROUP BY 1)"""


@register(_COUNTS + """ SELECT s.paper_id, s.n AS n_sections, s.x AS n_appendix_sections, coalesce(f, 0) AS n_figures, coalesce(f, 0) AS n_figure_src_refs, CAST(0 AS BIGINT) AS n_figures_with_body, coalesce(t, 0) AS n_tables, coalesce(e, 0) AS n_equations,
  coalesce(a, 0) AS n_algorithms, coalesce(l, 0) AS n_listings, coalesce(fn.n, 0) AS n_footnotes, c.n AS n_citations, round(c.ok / c.n, 3) AS citation_resolution_rate, CAST(0 AS BIGINT) AS residue_section_count, s.ids AS section_ids
  FROM s LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN fn USING (doc_id)""")
def paper_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records, reduced to what the golden files hold."""
    records = R.digest(latex(spark, sf_dir), bibliography(spark))
    return R.fingerprint(records).drop("title", "abstract_source", "n_authors", "section_titles").withColumn("section_ids", F.array_join("section_ids", ","))


@register(_COUNTS + """ SELECT paper_id, v.part, CAST(v.files AS BIGINT) AS files FROM (SELECT s.paper_id, s.n, k.* FROM s LEFT JOIN k USING (doc_id)) r,
  LATERAL (VALUES ('README.md', 1), ('paper.json', 1), ('references.json', 1), ('footnotes.json', 1), ('sections', n), ('figures', coalesce(f, 0)), ('tables', 2 * coalesce(t, 0)), ('equations', 2 * coalesce(e, 0)), ('algorithms', 2 * coalesce(a, 0)), ('listings', 2 * coalesce(l, 0))) v(part, files) WHERE v.files > 0""")
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each kind the folder of each paper has."""
    records = Scratch(spark, "records").keep(R.digest(latex(spark, sf_dir), bibliography(spark)))
    return folder_rows(records).groupBy("paper_id", F.substring_index("path", "/", 1).alias("part")).agg(F.countDistinct("path").alias("files"))


@register(TREE + """ SELECT paper_id, CAST(count(*) AS BIGINT) AS sections, min(title) AS first_title FROM sec GROUP BY 1""")
def paper_record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to JSON and back."""
    from scriptorium.sources.records import field, json_of

    records = R.digest(latex(spark, sf_dir))
    text = records.select("paper_id", json_of(F.struct("sections")).alias("j"))
    parsed = text.select("paper_id", F.from_json("j", f"sections {field('sections').simpleString()}").alias("r"))
    return parsed.select("paper_id", F.size("r.sections").cast("long").alias("sections"), F.array_min(F.transform("r.sections", lambda s: s["title"])).alias("first_title"))


@register(LINES + """ SELECT paper_id, 'lst:f' || CAST(i AS VARCHAR) AS label, 'Cap ' || CAST(i AS VARCHAR) AS caption FROM ln WHERE i % 3 = 0""")
def listing_float_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and caption of a float go to the first code block in it, and to no other."""
    code = "\\begin{lstlisting}\nx\n\\end{lstlisting}\n"
    def one(x: Column, i: Column) -> Column:
        n = i.cast("string")
        inside = F.concat(F.lit("\\begin{listing}\n" + code + code + "\\caption{Cap "), n, F.lit("}\\label{lst:f"), n, F.lit("}\n\\end{listing}\n" + code))
        return F.when(i % 3 == 0, inside).otherwise(F.lit(code))

    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("paper_id"), F.array_join(F.transform(F.split("text", "\n"), one), "\n").alias("tex"))
    return E.float_attributes(docs).select("paper_id", "label", "caption")


@register(LINES + """, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ln WHERE i % 4 = 1)
SELECT paper_id, 'fig:d' || paper_id || 'i' || CAST(i AS VARCHAR) AS name, true AS found FROM f UNION ALL SELECT paper_id, 'fig:' || CAST(n AS VARCHAR), true FROM f UNION ALL SELECT DISTINCT paper_id, 'fig:none', false FROM ln""")
def label_to_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The environment around a label, or the figure of a number."""
    docs = latex(spark, sf_dir)
    figures = E.figures(docs)
    names = figures.select("paper_id", F.explode(F.array("label", F.concat(F.lit("fig:"), F.col("ordinal") + 1))).alias("name")).unionByName(docs.select("paper_id", F.lit("fig:none").alias("name")))
    return R.bind_labels(docs, names).select("paper_id", "name", F.col("env_start").isNotNull().alias("found"))
