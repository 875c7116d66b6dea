"""One nested record for each paper, assembled from the tables of its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.operators import bib as B
from scriptorium.operators import citations as C
from scriptorium.operators import clean as D
from scriptorium.operators import entities as E
from scriptorium.operators import frontmatter as P
from scriptorium.operators import link as L
from scriptorium.operators import markers as M
from scriptorium.operators import quality as Q
from scriptorium.plans.scratch import Scratch

SCHEMA_VERSION = "0.5"
KINDS = {"figures": "figure", "tables": "table", "equations": "equation", "algorithms": "algorithm", "listings": "listing"}
#: Fields of each kind beside id, latex_label, text, defined_in, is_appendix and referenced_in.
FIELDS = {
    "figures": ["caption", "src_refs", "body_tex"], "tables": ["env", "caption", "raw_tex", "tex_lines", "cites_inside"], "equations": ["env", "raw_tex"],
    "algorithms": ["caption", "raw_tex"], "listings": ["language", "caption", "code", "line_labels"],
}


def collected(rows: DataFrame, name: str, order: list[Column], fields: list[Column]) -> DataFrame:
    """(paper_id, name): a paper's rows as an ordered array of structs."""
    packed = F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("r")))
    return rows.groupBy("paper_id").agg(F.transform(F.array_sort(packed, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: x["r"]).alias(name))


def entity_text(caption: Column | None, body: Column) -> Column:
    """``Caption: ...`` and the body with an empty line between; what is blank is left out."""
    some = lambda c: F.when(strip(c) != "", c)
    head = F.concat(F.lit("Caption: "), some(caption)) if caption is not None else F.lit(None)
    return F.concat_ws("\n\n", head, some(body))


def _kind(blocks: DataFrame, sections: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    kind = KINDS[name]
    found = E.of_kind(blocks, kind).withColumn("entity_id", E.canonical_id(E.PREFIX[kind], F.col("label"), F.col("ordinal")))
    if name == "figures":
        # Markers first, so that keys in a figure's text are not lost to cleaning.
        found = D.denoise(found.withColumn("_m", M.mark_refs(M.mark_cites(F.col("body_tex")))), "_m", "_body").drop("_m")
    body = {"figures": "_body", "listings": "code"}.get(name, "raw_tex")
    out = L.bind(found.withColumn("text", entity_text(F.col("caption") if "caption" in found.columns and name != "equations" else None, F.col(body))), sections)
    used = L.referenced_in(found.select("paper_id", "entity_id", "label"), marked)
    out = out.join(used, ["paper_id", "entity_id"], "left").withColumn("referenced_in", F.coalesce("referenced_in", F.array().cast("array<string>")))
    fields = [F.col("entity_id").alias("id"), F.col("label").alias("latex_label"), *(F.col(c) for c in FIELDS[name]), F.col("text"), F.col("defined_in"), F.col("is_appendix"), F.col("referenced_in")]
    return collected(out, name, [F.col("ordinal")], fields)


def digest(docs: DataFrame, bib_files: DataFrame | None = None, landing: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One record for each (paper_id, tex).

    bib_files: (file, size, content), for all papers alike, or with a paper_id.  landing: (paper_id, html), used for authors and dates
    and where the text has no title or abstract.  Texts, marked sections and
    environments are written once, as every part reads them.  All parts are keyed by paper_id; what a task gathers is
    one paper.
    """
    scratch = scratch or Scratch(docs.sparkSession, "digest")
    docs = scratch.keep(docs.select("paper_id", "tex"), "docs")
    marked = scratch.keep(M.marked_documents(docs), "marked")
    blocks = scratch.keep(E.all_blocks(docs), "blocks")
    ids = scratch.keep(E.entities_of(blocks), "ids")
    sections = scratch.keep(D.denoise(L.rewrite_refs(marked, ids), "marked").drop("marked"), "sections")

    front = P.affiliations(P.abstracts(P.titles(docs))).drop("tex")
    if landing is not None:
        page = P.landing_pages(landing).select("paper_id", F.struct("title", "authors", "abstract", "published", "updated", "version").alias("page"))
        front = front.join(page, "paper_id", "left")
    else:
        front = front.withColumn("page", F.lit(None).cast("struct<title:string,authors:array<string>,abstract:string,published:string,updated:string,version:string>"))

    def chosen(own: str) -> tuple[Column, Column]:
        mine, other = F.nullif(F.col(own), F.lit("")), F.nullif(F.col("page")[own], F.lit(""))
        return F.coalesce(mine, other, F.lit("")), F.when(mine.isNotNull(), "title_cmd").when(other.isNotNull(), "arxiv_api").otherwise("none")

    title, title_source = chosen("title")
    abstract, abstract_source = chosen("abstract")
    metadata = F.struct(
        title.alias("title"), abstract.alias("abstract"), F.coalesce(F.col("page.authors"), F.array().cast("array<string>")).alias("authors"), F.col("affiliations"),
        title_source.alias("title_source"), F.when(abstract_source == "title_cmd", F.col("abstract_source")).otherwise(abstract_source).alias("abstract_source"),
        F.when(F.col("page.authors").isNotNull(), "arxiv_api").otherwise("none").alias("authors_source"), F.col("affiliations_source"),
        F.col("page.version").alias("arxiv_version"), F.col("page.published").alias("published"), F.col("page.updated").alias("updated"),
    )
    out = front.select("paper_id", F.lit(SCHEMA_VERSION).alias("schema_version"), metadata.alias("metadata"))

    section_fields = [F.col("section_id").alias("id"), F.col("title"), F.col("level"), F.col("parent_id"), F.col("order"), F.col("is_appendix"), F.col("text"), F.length("text").alias("char_count"), F.col("cites"), F.col("refs")]
    parts = [collected(sections, "sections", [F.col("order")], section_fields)]
    parts += [_kind(blocks, sections, marked, name) for name in KINDS]
    cited = C.citations(marked)
    if bib_files is not None:
        cited = C.resolve(cited, B.entries(bib_files))
    else:
        cited = cited.withColumns({"title": F.lit(None).cast("string"), "authors": F.array().cast("array<string>"), "year": F.lit(None).cast("string"), "venue": F.lit(None).cast("string"), "bib_raw": F.lit(None).cast("string")})
    parts.append(collected(cited, "citations", [-F.col("count"), F.col("key")], [F.col(c) for c in ("key", "count", "cited_in", "first_context", "title", "authors", "year", "venue", "bib_raw")]))
    notes = M.footnotes(marked)
    parts.append(collected(notes, "footnotes", [F.substring("footnote_id", 4, 10).cast("int")], [F.col("footnote_id").alias("id"), F.col("text")]))
    left = Q.residue(sections.select("paper_id", "section_id", "order", "text"))
    parts.append(collected(left, "residue_top", [F.col("place")], [F.col("command"), F.col("n").alias("count")]))
    parts.append(Q.residue_sections(sections))
    # Each part is stored: joined as plans, all of them were planned anew after each stage.
    for p in [scratch.keep(p, "part") for p in parts]:
        out = out.join(p, "paper_id", "left")
    for name in ["sections", *KINDS, "citations", "footnotes", "residue_top"]:
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    warnings = F.struct("residue_top", F.coalesce("residue_section_count", F.lit(0)).alias("residue_section_count"))
    return out.withColumn("warnings", warnings).drop("residue_top", "residue_section_count")


def fingerprint(records: DataFrame) -> DataFrame:
    """Counts, the share of resolved citations, and section ids and titles of each record."""
    size = lambda c: F.size(c).cast("long")
    resolved = F.size(F.filter("citations", lambda c: c["title"].isNotNull()))
    return records.select(
        "paper_id", F.col("metadata.title").alias("title"), F.col("metadata.abstract_source").alias("abstract_source"), size("metadata.authors").alias("n_authors"),
        size("sections").alias("n_sections"), size(F.filter("sections", lambda s: s["is_appendix"])).alias("n_appendix_sections"), size("figures").alias("n_figures"),
        F.aggregate("figures", F.lit(0), lambda a, f: a + F.size(f["src_refs"])).cast("long").alias("n_figure_src_refs"),
        size(F.filter("figures", lambda f: f["body_tex"] != "")).alias("n_figures_with_body"), size("tables").alias("n_tables"), size("equations").alias("n_equations"),
        size("algorithms").alias("n_algorithms"), size("listings").alias("n_listings"), size("footnotes").alias("n_footnotes"), size("citations").alias("n_citations"),
        F.round(F.when(F.size("citations") > 0, resolved / F.size("citations")).otherwise(0.0), 3).alias("citation_resolution_rate"),
        F.col("warnings.residue_section_count").cast("long").alias("residue_section_count"),
        F.transform("sections", lambda s: s["id"]).alias("section_ids"), F.transform("sections", lambda s: s["title"]).alias("section_titles"),
    )


def paper_id_of(folder: str) -> str:
    """The last part of a path that is no generic name."""
    generic = {"arxiv-to-prompt", "source", "tex", "main"}
    parts = [p for p in folder.split("/") if p not in ("", ".")]
    return next((p for p in reversed(parts) if p not in generic), parts[-1] if parts else "paper")


def bind_labels(tex: DataFrame, labels: DataFrame) -> DataFrame:
    """(paper_id, name, env_start, env_stop): the figure around each label, else the figure of that number.

    labels: (paper_id, name).  A figure environment holds a label if it begins before and ends
    after it; a name that ends in a number and is no label takes the figure of that number.
    """
    figures = E.blocks(tex, "figure").select("paper_id", "ordinal", F.col("position").alias("env_start"), F.col("stop").alias("env_stop"), F.regexp_extract_all("body", F.lit(E.LABEL), F.lit(1)).alias("inside"))
    by_label = figures.withColumn("name", F.explode(F.array_distinct("inside"))).groupBy("paper_id", "name").agg(F.min(F.struct("env_start", "env_stop")).alias("hit"))
    by_number = figures.select("paper_id", (F.col("ordinal") + 1).cast("string").alias("number"), F.struct("env_start", "env_stop").alias("numbered"))
    asked = labels.withColumn("number", F.regexp_extract("name", r"(\d+)$", 1))
    met = asked.join(by_label, ["paper_id", "name"], "left").join(by_number, ["paper_id", "number"], "left")
    return met.withColumn("env", F.coalesce("hit", "numbered")).select("paper_id", "name", "env.env_start", "env.env_stop")
