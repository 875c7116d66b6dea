"""Queries on sections, markers, citations and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog.common import ENTITIES, LINES, PLACED, PLAIN, TREE, register
from scriptorium.operators import citations as C
from scriptorium.operators import entities as E
from scriptorium.operators import link as L
from scriptorium.operators import markers as M
from scriptorium.operators import sections as S
from scriptorium.sources.synthetic import escaped, latex
from scriptorium.sources.tables import table


def _joined(c: str, sep: str = ","):
    return F.array_join(c, sep).alias(c)


@register(TREE + """ SELECT paper_id, section_id, parent_id, title, CAST(level AS BIGINT) AS level, CAST(ord AS BIGINT) AS "order", i >= 20 AS is_appendix FROM sec""")
def sections_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section of every paper with its place in the tree and its appendix scope."""
    s = S.sections(latex(spark, sf_dir))
    return s.select("paper_id", "section_id", "parent_id", "title", F.col("level").cast("long").alias("level"), F.col("order").cast("long").alias("order"), "is_appendix")


@register(TREE + """ SELECT paper_id, section_id, CAST(level AS BIGINT) AS level, CAST(n AS BIGINT) AS ordinal FROM sec""")
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.section_tree(latex(spark, sf_dir))
    return t.select("paper_id", "section_id", F.col("level").cast("long").alias("level"), F.col("ordinal").cast("long").alias("ordinal"))


@register(PLACED + """ SELECT paper_id, section_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS graphics FROM pl GROUP BY 1, 2""")
def section_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between a heading and the next one: source lines (each has one closing cite) and graphics."""
    s = S.sections(latex(spark, sf_dir))
    count = lambda p: F.size(F.regexp_extract_all("raw", F.lit(p), F.lit(0))).cast("long")
    return s.select("paper_id", "section_id", count(r"\\cite\{k\d+(?:, k\d+)?\}(?! \\\\)").alias("lines"), count(r"\\includegraphics").alias("graphics"))


@register(LINES + """ SELECT paper_id, CAST(count(*) AS BIGINT) AS sections, CAST(sum(CASE WHEN i >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS appendix_sections FROM ln WHERE i % 5 IN (0, 3) OR i % 11 = 7 GROUP BY 1""")
def appendix_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sections(latex(spark, sf_dir))
    return s.groupBy("paper_id").agg(F.count("*").alias("sections"), F.sum(F.col("is_appendix").cast("long")).alias("appendix_sections"))


@register(PLACED + """ SELECT paper_id, section_id, string_agg(key, ',' ORDER BY i, pos) AS cites, CAST(count(*) AS BIGINT) AS n FROM ct GROUP BY 1, 2""")
def cite_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.marked_sections(S.sections(latex(spark, sf_dir)))
    return m.select("paper_id", "section_id", _joined("cites"), F.size("cites").cast("long").alias("n")).where("n > 0")


@register(PLACED + """ SELECT paper_id, section_id, string_agg('fig:d' || paper_id || 'i' || CAST(i - 1 AS VARCHAR), ',' ORDER BY i) AS refs FROM pl WHERE i % 4 = 2 GROUP BY 1, 2""")
def ref_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.marked_sections(S.sections(latex(spark, sf_dir)))
    return m.where(F.size("refs") > 0).select("paper_id", "section_id", _joined("refs"))


@register(PLACED + """ SELECT paper_id, section_id, 'fn:' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS VARCHAR) AS footnote_id, 'Note ' || paper_id || ' ' || CAST(i AS VARCHAR) AS text FROM pl WHERE i % 8 = 5""")
def footnotes_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.footnotes(M.marked_documents(latex(spark, sf_dir)))


@register(PLACED + """ SELECT paper_id, key, CAST(count(*) AS BIGINT) AS "count", arg_min(section_id, ord) AS first_context FROM ct GROUP BY 1, 2""")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.citations(M.marked_sections(S.sections(latex(spark, sf_dir))))
    return c.select("paper_id", "key", "count", "first_context")


@register(PLACED + """, d AS (SELECT DISTINCT paper_id, key, section_id, ord FROM ct) SELECT paper_id, key, string_agg(section_id, ',' ORDER BY ord) AS cited_in FROM d GROUP BY 1, 2""")
def citation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.citations(M.marked_sections(S.sections(latex(spark, sf_dir))))
    return c.select("paper_id", "key", _joined("cited_in"))


@register(PLACED + """, c AS (SELECT paper_id, key, count(*) AS n FROM ct GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, key) AS place FROM c)
SELECT paper_id, CAST(place AS BIGINT) AS place, key, CAST(n AS BIGINT) AS "count" FROM r WHERE place <= 5""")
def top_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most cited keys of each paper, as a report shows them."""
    from pyspark.sql import Window

    c = C.citations(M.marked_sections(S.sections(latex(spark, sf_dir))))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("count"), "key"))
    return c.withColumn("place", place).where("place <= 5").select("paper_id", F.col("place").cast("long").alias("place"), "key", "count")


@register(ENTITIES + """ SELECT paper_id, entity_id, 'Cap ' || CAST(i AS VARCHAR) || ' of ' || paper_id AS caption, 'img/d' || paper_id || 'i' || CAST(i AS VARCHAR) || '.png' AS src_refs, '' AS body_tex FROM en WHERE kind = 'figure'""")
def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = E.figures(latex(spark, sf_dir))
    return f.select("paper_id", E.canonical_id("fig", F.col("label"), F.col("ordinal")).alias("entity_id"), "caption", _joined("src_refs"), "body_tex")


@register(ENTITIES + """ SELECT paper_id, entity_id, 'Tab ' || CAST(i AS VARCHAR) AS caption, 'k' || CAST(i % 5 AS VARCHAR) AS cites_inside, CAST(3 AS BIGINT) AS tex_lines FROM en WHERE kind = 'table'""")
def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.tables(latex(spark, sf_dir))
    return t.select("paper_id", E.canonical_id("tab", F.col("label"), F.col("ordinal")).alias("entity_id"), "caption", _joined("cites_inside"), F.col("tex_lines").cast("long").alias("tex_lines"))


@register(ENTITIES + """ SELECT paper_id, entity_id, 'x_{' || CAST(i AS VARCHAR) || '}=1' AS raw_tex FROM en WHERE kind = 'equation'""")
def equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.equations(latex(spark, sf_dir)).select("paper_id", E.canonical_id("eq", F.col("label"), F.col("ordinal")).alias("entity_id"), "raw_tex")


@register(ENTITIES + """ SELECT paper_id, entity_id, 'Alg ' || CAST(i AS VARCHAR) AS caption FROM en WHERE kind = 'algorithm'""")
def algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.algorithms(latex(spark, sf_dir)).select("paper_id", E.canonical_id("alg", F.col("label"), F.col("ordinal")).alias("entity_id"), "caption")


@register(ENTITIES + """ SELECT paper_id, entity_id AS label, 'python' AS language, 'print(' || CAST(i AS VARCHAR) || ')' AS code FROM en WHERE kind = 'listing'""")
def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.listings(latex(spark, sf_dir)).select("paper_id", "label", "language", "code")


@register(ENTITIES + """ SELECT paper_id, kind, entity_id, section_id AS defined_in, is_appendix FROM en""")
def entity_binding_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = latex(spark, sf_dir)
    return L.bind(E.entities(docs), S.sections(docs)).select("paper_id", "kind", "entity_id", "defined_in", "is_appendix")


@register(ENTITIES + """ SELECT paper_id, kind, CAST(count(*) AS BIGINT) AS n, min(entity_id) AS least, max(entity_id) AS most FROM en GROUP BY 1, 2""")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entities(latex(spark, sf_dir)).groupBy("paper_id", "kind").agg(F.count("*").alias("n"), F.min("entity_id").alias("least"), F.max("entity_id").alias("most"))


@register(PLACED + """ SELECT paper_id, 'fig:d' || paper_id || 'i' || CAST(i - 1 AS VARCHAR) AS entity_id, section_id AS referenced_in FROM pl WHERE i % 4 = 2""")
def referenced_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = latex(spark, sf_dir)
    r = L.referenced_in(E.entities(docs), M.marked_sections(S.sections(docs)))
    return r.select("paper_id", "entity_id", _joined("referenced_in"))


@register(PLACED + """ SELECT paper_id, section_id, string_agg('[#fig:d' || paper_id || 'i' || CAST(i - 1 AS VARCHAR) || ']', '' ORDER BY i) AS markers FROM pl WHERE i % 4 = 2 GROUP BY 1, 2""")
def ref_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = latex(spark, sf_dir)
    r = L.rewrite_refs(M.marked_documents(docs), E.entities(docs))
    return r.select("paper_id", "section_id", F.array_join(F.regexp_extract_all("marked", F.lit(r"\[#[^\]]*\]"), F.lit(0)), "").alias("markers")).where("markers <> ''")


@register(PLACED + """ SELECT key, CAST(count(DISTINCT paper_id) AS BIGINT) AS papers, CAST(count(*) AS BIGINT) AS mentions FROM ct GROUP BY 1""")
def cross_paper_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many papers, and how often, each key is cited."""
    c = C.citations(M.marked_sections(S.sections(latex(spark, sf_dir))))
    return c.groupBy("key").agg(F.count("*").alias("papers"), F.sum("count").alias("mentions"))


@register(PLACED + """, s AS (SELECT DISTINCT doc_id, paper_id, section_id, is_appendix FROM pl) SELECT section_id, CAST(count(*) AS BIGINT) AS papers FROM s WHERE NOT is_appendix GROUP BY 1""")
def cross_paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many papers have a body section of each id, by titles that hold an x."""
    s = S.sections(latex(spark, sf_dir)).where(~F.col("is_appendix") & F.lower("title").contains("x"))
    return s.groupBy("section_id").agg(F.count("*").alias("papers"))


def _built(spark: SparkSession, sf_dir: str, one) -> DataFrame:
    """(paper_id, tex): each line of a document as ``one`` builds it from its number, followed by the line itself."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("paper_id"), "text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(one(i.cast("string"), i), F.lit("\n"), escaped(x)))
    return docs.select("paper_id", F.array_join(lines, "\n").alias("tex"))


_WRAPPED = "\\textbf{\\emph{\\textit{{"


@register(LINES + r""", h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS stop, max(i) OVER (PARTITION BY doc_id) AS last FROM ln WHERE i % 3 = 0 OR i % 3 = 1)
SELECT l.paper_id, 'sec:' || CAST(h.n AS VARCHAR) AS section_id, 'H' || CAST(h.i AS VARCHAR) AS title,
  md5(string_agg(regexp_replace(""" + PLAIN.replace("body", "l.body") + r""", '([%$&#_])', '\\\1', 'g'), chr(10) ORDER BY l.i)) AS slice
FROM h JOIN ln l ON l.doc_id = h.doc_id AND l.i >= h.i AND (h.stop IS NULL OR l.i < h.stop) GROUP BY 1, 2, 3""")
def deep_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with braces five deep, and the text of each section."""
    def one(n, i):
        return F.when(i % 3 != 2, F.concat(F.lit("\\section{" + _WRAPPED + "H"), n, F.lit("}" * 5))).otherwise(F.lit(""))

    s = S.sections(_built(spark, sf_dir, one))
    # A line without a heading begins with an empty one.
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"^\n", ""), r"\n\z", ""), r"\n\n", "\n")
    return s.select("paper_id", "section_id", "title", F.md5(text).alias("slice"))


_INNER = "\\begin{tabular}{c}1\\end{tabular}"


@register(LINES + r""" SELECT paper_id, 'tab:' || CAST(i AS VARCHAR) AS label, 'Cap ' || CAST(i AS VARCHAR) AS caption, '\begin{tabular}{ll}a & \begin{tabular}{c}1\end{tabular} & ' || CAST(i AS VARCHAR) || '\end{tabular}' AS raw_tex FROM ln WHERE i % 4 = 1""")
def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tabular within a tabular ends where the outer one does; the caption's braces are five deep."""
    def one(n, i):
        built = F.concat(F.lit("\\begin{table}\\caption{" + _WRAPPED + "Cap "), n, F.lit("}" * 5 + "\\label{tab:"), n, F.lit("}\\begin{tabular}{ll}a & " + _INNER + " & "), n, F.lit("\\end{tabular}\\end{table}"))
        return F.when(i % 4 == 1, built).otherwise(F.lit(""))

    return E.tables(_built(spark, sf_dir, one)).select("paper_id", "label", "caption", "raw_tex")


@register(LINES + r""" SELECT paper_id, 'fig:' || CAST(i AS VARCHAR) AS label, 'Cap ' || CAST(i AS VARCHAR) AS caption,
  CASE WHEN i % 8 = 1 THEN '\fbox{\parbox{3cm}{User: a question of paper ' || paper_id || ' that is shown as text, line ' || CAST(i AS VARCHAR) || '}}' ELSE '' END AS body_tex FROM ln WHERE i % 4 = 1""")
def figure_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that are text keep it; of a figure with a graphic and layout nothing is left."""
    def one(n, i):
        body = F.when(i % 8 == 1, F.concat(F.lit("\\fbox{\\parbox{3cm}{User: a question of paper "), F.col("paper_id"), F.lit(" that is shown as text, line "), n, F.lit("}}"))).otherwise(F.lit("\\centering\\includegraphics{a.png}"))
        built = F.concat(F.lit("\\begin{figure}"), body, F.lit("\\caption{" + _WRAPPED + "Cap "), n, F.lit("}" * 5 + "\\label{fig:"), n, F.lit("}\\end{figure}"))
        return F.when(i % 4 == 1, built).otherwise(F.lit(""))

    return E.figures(_built(spark, sf_dir, one)).select("paper_id", "label", "caption", "body_tex")


@register(LINES + r""", f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, b) AS n FROM ln, LATERAL (VALUES (0), (1)) t(b) WHERE i % 3 = 0 OR b = 0)
SELECT paper_id, CAST(i AS BIGINT) AS line, CAST(b AS BIGINT) AS block, CASE WHEN i % 3 = 0 AND b = 0 THEN 'lst:f' || CAST(i AS VARCHAR)
  ELSE 'lst:' || CAST(sum(CASE WHEN i % 3 = 0 AND b = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i, b) AS VARCHAR) END AS label,
  CASE WHEN i % 3 = 0 AND b = 0 THEN 'Cap ' || CAST(i AS VARCHAR) ELSE '' END AS caption FROM f""")
def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and captions of code blocks in listing floats and outside, as whole records have them."""
    def one(n, i):
        code = lambda b: F.concat(F.lit("\\begin{lstlisting}\n"), n, F.lit(f" {b}\n\\end{{lstlisting}}\n"))
        held = F.concat(F.lit("\\begin{listing}\n"), code(0), code(1), F.lit("\\caption{Cap "), n, F.lit("}\\label{lst:f"), n, F.lit("}\n\\end{listing}"))
        return F.when(i % 3 == 0, held).otherwise(code(0))

    found = E.listings(_built(spark, sf_dir, one))
    place = F.split("code", " ")
    return found.select("paper_id", place[0].cast("long").alias("line"), place[1].cast("long").alias("block"), "label", "caption")
