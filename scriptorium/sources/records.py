"""Stored records: schemas and tolerant readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTITY = "id string, latex_label string, text string, defined_in string, is_appendix boolean, referenced_in array<string>"
VISUAL = (
    "struct<schema_version:string,status:string,asset_path:string,asset_sha256:string,model:string,backend:string,extracted_at:string,figure_role:string,"
    "visible_text:array<struct<text:string,region:string,role:string,confidence:string,truncated:boolean>>,"
    "safety_relevant_content:array<struct<kind:string,text:string,confidence:string,notes:string,truncated:boolean>>,"
    "summary:string,uncertain:array<string>,warnings:array<string>>"
)
FIELDS = {
    "schema_version": "string", "paper_id": "string", "source_kind": "string",
    "metadata": "struct<title:string,abstract:string,authors:array<string>,affiliations:array<string>,title_source:string,abstract_source:string,authors_source:string,affiliations_source:string,arxiv_version:string,published:string,updated:string>",
    "sections": "array<struct<id:string,title:string,level:int,parent_id:string,order:int,is_appendix:boolean,text:string,char_count:int,cites:array<string>,refs:array<string>>>",
    "figures": f"array<struct<{_ENTITY}, caption string, src_refs array<string>, body_tex string, visual_extraction {VISUAL}>>",
    "tables": f"array<struct<{_ENTITY}, env string, caption string, raw_tex string, tex_lines int, cites_inside array<string>>>",
    "equations": f"array<struct<{_ENTITY}, env string, raw_tex string>>",
    "algorithms": f"array<struct<{_ENTITY}, caption string, raw_tex string>>",
    "listings": f"array<struct<{_ENTITY}, language string, caption string, code string, line_labels array<string>>>",
    "citations": "array<struct<key:string,count:int,cited_in:array<string>,first_context:string,title:string,authors:array<string>,year:string,venue:string,bib_raw:string>>",
    "footnotes": "array<struct<id:string,text:string>>",
    "warnings": "struct<residue_top:array<struct<command:string,count:int>>,residue_section_count:int>",
}
CORRUPT = "_corrupt_record"


def paper_schema() -> str:
    return ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def read_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Records of ``*/digest/paper.json`` below ``folder``; files that are no JSON have ``_corrupt_record`` and their slug."""
    raw = spark.read.schema(f"{paper_schema()}, {CORRUPT} string").json(f"{folder}/*/digest/paper.json", multiLine=True, columnNameOfCorruptRecord=CORRUPT)
    return raw.withColumn("slug", F.regexp_extract("_metadata.file_path", r"([^/]+)/digest/paper\.json$", 1))


def read_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Figure files of all papers: slug, file, and the figure's fields."""
    raw = spark.read.schema(f"{_ENTITY}, caption string, src_refs array<string>, visual_extraction {VISUAL}, {CORRUPT} string").json(f"{folder}/*/digest/figures/*.json", multiLine=True, columnNameOfCorruptRecord=CORRUPT)
    return raw.withColumns({"slug": F.regexp_extract("_metadata.file_path", r"([^/]+)/digest/figures/[^/]+$", 1), "file": F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)})


def audit_view(papers: DataFrame, with_binary: DataFrame | None = None) -> DataFrame:
    """What the findings read of stored records; with_binary: (slug) of papers that have image files."""
    found = papers.withColumn("has_binary", F.lit(True))
    if with_binary is not None:
        found = papers.join(with_binary.select("slug").distinct().withColumn("has_binary", F.lit(True)), "slug", "left").withColumn("has_binary", F.coalesce("has_binary", F.lit(False)))
    return found.select(
        F.col("slug").alias("paper_id"), F.col(CORRUPT).alias("corrupt"), "schema_version", "sections", F.col("metadata.title").alias("title"), F.col("metadata.title_source").alias("title_source"),
        F.col("metadata.abstract").alias("abstract"), F.col("metadata.abstract_source").alias("abstract_source"), "listings", F.col("warnings.residue_top").alias("residue_top"), "citations",
        F.transform("figures", lambda f: F.struct(f["id"].alias("id"), f["visual_extraction"]["status"].alias("status"))).alias("figures"), "has_binary",
    )


def upsert_visuals(papers: DataFrame, visuals: DataFrame) -> DataFrame:
    """``papers`` with new visual extractions, (paper_id, figure_id, visual_extraction), on all figures of that id."""
    kind = papers.schema["figures"].dataType.elementType["visual_extraction"].dataType
    table = visuals.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("figure_id", F.col("visual_extraction").cast(kind)))).alias("_new"))
    fresh = F.transform("figures", lambda f: f.withField("visual_extraction", F.coalesce(F.try_element_at("_new", f["id"]), f["visual_extraction"])))
    return papers.join(table, "paper_id", "left").withColumn("figures", F.when(F.col("_new").isNull(), F.col("figures")).otherwise(fresh)).drop("_new")


def field(name: str) -> T.DataType:
    return T._parse_datatype_string(FIELDS[name])


def json_of(row: Column) -> Column:
    """JSON with explicit nulls."""
    return F.to_json(row, {"ignoreNullFields": "false"})
