"""Queries on front matter and landing pages, over papers and pages built by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog.common import register
from scriptorium.operators import frontmatter as P
from scriptorium.sources.tables import table


def _fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, tex): front matter whose form depends on doc_id; the abstract is long enough for every tier."""
    d, n = F.col("doc_id").cast("string"), F.col("doc_id")
    lit = F.lit
    body = F.concat(lit("We study case "), d, lit(" "), F.repeat(lit("with ordinary words "), 12), lit("and \\emph{stop}."))
    abstract = (
        F.when(n % 4 == 0, F.concat(lit("\\begin{abstract}\n"), body, lit("\n\\end{abstract}\n")))
        .when(n % 4 == 1, F.concat(lit("\\shortabstract{no}\\setabstract{"), body, lit("}\n")))
        .when(n % 4 == 2, F.concat(lit("\\maketitle\n\nBy the author of all this.\n\n"), body, lit("\n\n")))
        .otherwise(lit(""))
    )
    who = (
        F.when(n % 5 == 0, F.concat(lit("\\institution{Place "), d, lit("}\\institution{PLACE "), d, lit("}\n\\email{a@openai.com}")))
        .when(n % 5 == 1, F.concat(lit("\\icmlaffiliation{x}{Lab "), d, lit("$^1$}")))
        .when(n % 5 == 2, F.concat(lit("\\institute{First "), d, lit(" \\and Second "), d, lit(".}")))
        .when(n % 5 == 3, F.concat(lit("\\author{Ann Roe \\\\ University of "), d, lit(" \\and b@ibm.com}")))
        .otherwise(lit("\\author{Ann Roe}"))
    )
    tex = F.concat(
        lit("\\documentclass{a}\n\\titlerunning{A running head that is longer than all of the others, by far}\n\\title{Short "), d,
        lit("}\n\\icmltitle{The {\\bf longer} name of~"), d, lit("\\thanks{Funded by {x}}}\n"), who, lit("\n\\begin{document}\n"), abstract, lit("\\section{One}\nText.\n"),
    )
    return table(spark, sf_dir, "documents").select(d.alias("paper_id"), tex.alias("tex"))


_ID = "CAST(doc_id AS VARCHAR)"
_BODY = f"'We study case ' || {_ID} || ' ' || repeat('with ordinary words ', 12) || 'and stop.'"


@register(f"SELECT {_ID} AS paper_id, 'The longer name of ' || {_ID} AS title FROM documents")
def title_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.titles(_fronts(spark, sf_dir)).select("paper_id", "title")


@register(f"""SELECT {_ID} AS paper_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE {_BODY} END AS abstract,
['abstract_env', 'abstract_cmd', 'between_maketitle_section', 'none'][CAST(doc_id % 4 AS INTEGER) + 1] AS abstract_source FROM documents""")
def abstract_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.abstracts(_fronts(spark, sf_dir)).select("paper_id", "abstract", "abstract_source")


@register(f"""SELECT {_ID} AS paper_id,
CASE doc_id % 5 WHEN 0 THEN 'Place ' || {_ID} || '|OpenAI' WHEN 1 THEN 'Lab ' || {_ID} WHEN 2 THEN 'First ' || {_ID} || '|Second ' || {_ID}
  WHEN 3 THEN 'University of ' || {_ID} || '|IBM' ELSE 'individual' END AS affiliations,
['acmart_institution+email', 'icml', 'llncs_institute', 'authorblock+email', 'individual'][CAST(doc_id % 5 AS INTEGER) + 1] AS affiliations_source FROM documents""")
def affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.affiliations(_fronts(spark, sf_dir)).select("paper_id", F.array_join("affiliations", "|").alias("affiliations"), "affiliations_source")


def _landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with citation tags before their own content; every seventh page has no author."""
    p, n = F.col("page_id").cast("string"), F.col("page_id")

    def meta(name: str, *content) -> Column:
        return F.concat(F.lit(f'<meta name="citation_{name}" content="'), *(F.lit(c) if isinstance(c, str) else c for c in content), F.lit('"/>\n'))

    head = F.concat(
        meta("title", "Page &amp; title\n  ", p), F.when(n % 7 == 0, "").otherwise(F.concat(meta("author", "Doe", p, ", Jane"), meta("author", "Team&nbsp;", p))),
        meta("date", "2024/01/", p), meta("online_date", "2024/02/", p), meta("abstract", "A &lt;b&gt; ", p), F.lit("[v1] then [v"), (n % 3 + 1).cast("string"), F.lit("]\n"),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat(head, "html").alias("html"))


@register("""WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS p, page_id % 7 <> 0 AS known FROM pages)
SELECT page_id, CASE WHEN known THEN 'Page & title ' || p END AS title, CASE WHEN known THEN 'Jane Doe' || p || '|Team ' || p END AS authors, CASE WHEN known THEN 'A <b> ' || p END AS abstract,
  CASE WHEN known THEN '2024-01-' || p END AS published, CASE WHEN known THEN '2024-02-' || p END AS updated FROM p""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.landing_pages(_landing(spark, sf_dir)).select("page_id", "title", F.array_join("authors", "|").alias("authors"), "abstract", "published", "updated")


@register("SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN 'v' || CAST(page_id % 3 + 1 AS VARCHAR) END AS version FROM pages")
def page_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.landing_pages(_landing(spark, sf_dir)).select("page_id", "version")


@register(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '') AS heading,
nullif(regexp_extract(html, '(?i)<html[^>]*?\slang=["'']?([A-Za-z-]+)', 1), '') AS lang, array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1), '|') AS links FROM pages""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.raw_pages(table(spark, sf_dir, "pages")).select("page_id", "title", "heading", "lang", F.array_join("links", "|").alias("links"))
