"""A paper's folder: Markdown sections, entity files, JSON, and an overview, as rows and as files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import slug, strip
from scriptorium.sources.records import json_of

# File endings of code by language.
EXTENSIONS = {
    "python": ".py", "py": ".py", "javascript": ".js", "js": ".js", "typescript": ".ts", "ts": ".ts", "bash": ".sh", "shell": ".sh", "sh": ".sh",
    "json": ".json", "yaml": ".yaml", "yml": ".yaml", "xml": ".xml", "html": ".html", "css": ".css", "c": ".c", "cpp": ".cpp", "c++": ".cpp",
    "rust": ".rs", "go": ".go", "java": ".java", "ruby": ".rb", "tex": ".tex", "latex": ".tex", "sql": ".sql", "r": ".r", "matlab": ".m",
}
KINDS = {"figures": "fig", "tables": "tab", "equations": "eq", "algorithms": "alg", "listings": "lst"}


def section_file(section_id: Column, title: Column) -> Column:
    """``sec:2.1`` and "Data" to ``02.01-data.md``."""
    numbers = F.transform(F.split(F.regexp_replace(section_id, "^sec:", ""), r"\."), lambda x: F.lpad(x, F.greatest(F.lit(2), F.length(x)), F.lit("0")))
    return F.concat(F.array_join(numbers, "."), F.lit("-"), slug(title), F.lit(".md"))


def entity_file(prefix: str, entity_id: Column) -> Column:
    """``fig:Overview`` to ``fig-overview``."""
    return F.concat(F.lit(prefix + "-"), slug(F.regexp_replace(entity_id, "^[^:]*:", "")))


def extension(language: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(language, F.lit("")))), F.lit(".txt"))


def yaml_text(c: Column) -> Column:
    """A string, quoted where plain text would be ambiguous."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(c, r'([\\"])', r"\\$1"), F.lit('"'))
    return F.when(c.rlike(r"""[:#\n"'\[\]{}|>]|^ | $"""), quoted).otherwise(c)


def front_matter(fields: dict[str, tuple[str, Column]]) -> Column:
    """YAML front matter of (kind, column) by name; kinds are text, plain and list."""
    def value(kind: str, c: Column) -> Column:
        if kind == "list":
            return F.concat(F.lit("["), F.array_join(F.transform(c, yaml_text), ", "), F.lit("]"))
        return F.coalesce(yaml_text(c) if kind == "text" else c.cast("string"), F.lit("null"))

    lines = [F.concat(F.lit(f"{k}: "), value(*v)) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def _sections(records: DataFrame) -> DataFrame:
    s = records.select("paper_id", F.explode("sections").alias("s")).select("paper_id", "s.*")
    head = front_matter({
        "id": ("text", F.col("id")), "title": ("text", F.col("title")), "level": ("plain", F.col("level")), "parent_id": ("text", F.col("parent_id")), "order": ("plain", F.col("order")),
        "is_appendix": ("plain", F.col("is_appendix")), "char_count": ("plain", F.col("char_count")), "cites": ("list", F.col("cites")), "refs": ("list", F.col("refs")),
    })
    title = F.concat(F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "), F.col("title"))
    return s.select("paper_id", F.concat(F.lit("sections/"), section_file(F.col("id"), F.col("title"))).alias("path"), F.concat_ws("\n\n", head, title, F.col("text")).alias("content"))


def _entities(records: DataFrame, kind: str) -> list[DataFrame]:
    e = records.select("paper_id", F.explode(kind).alias("e")).withColumn("base", entity_file(KINDS[kind], F.col("e.id")))
    body = {"figures": None, "listings": "code"}.get(kind, "raw_tex")
    if kind == "figures":
        has = strip(F.col("e.body_tex")) != ""
        name = F.when(has, F.concat("base", F.lit(".txt")))
        files = e.where(has).select("paper_id", F.concat(F.lit("figures/"), name).alias("path"), F.col("e.text").alias("content"))
        meta = F.col("e").withField("content_file", name)
    else:
        name = F.concat("base", extension(F.col("e.language")) if kind == "listings" else F.lit(".tex"))
        files = e.select("paper_id", F.concat(F.lit(kind + "/"), name).alias("path"), F.col(f"e.{body}").alias("content"))
        meta = F.col("e").withField("content_file", name).dropFields(body)
    return [files, e.select("paper_id", F.concat(F.lit(kind + "/"), F.col("base"), F.lit(".json")).alias("path"), json_of(meta).alias("content"))]


def _with_files(records: DataFrame) -> DataFrame:
    """Records whose sections and entities name their files."""
    out = records.withColumn("sections", F.transform("sections", lambda s: s.withField("file", F.concat(F.lit("sections/"), section_file(s["id"], s["title"])))))

    def named(kind: str, prefix: str):
        def one(e: Column) -> Column:
            tail = F.lit(".json") if kind == "figures" else extension(e["language"]) if kind == "listings" else F.lit(".tex")
            return e.withField("file", F.concat(F.lit(kind + "/"), entity_file(prefix, e["id"]), tail))

        return one

    for kind, prefix in KINDS.items():
        out = out.withColumn(kind, F.transform(kind, named(kind, prefix)))
    return out


def _caption(kind: str, e: Column) -> Column:
    """What the overview says of an entity: its caption, else its environment."""
    if kind == "equations":
        return e["env"]
    return F.coalesce(F.nullif(e["caption"], F.lit("")), e["env"] if kind == "tables" else F.lit(""))


def _overview(full: DataFrame) -> DataFrame:
    """README.md: provenance, abstract, outline, entities, most cited keys, counts."""
    short = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    appendix = lambda x: F.when(x["is_appendix"], " *(appendix)*").otherwise("")
    lines = lambda array: F.array_join(array, "\n")
    m = "metadata."
    outline = F.transform("sections", lambda s: F.concat(F.repeat(F.lit("  "), s["level"]), F.lit("- [`"), s["id"], F.lit("` — "), s["title"], F.lit("]("), s["file"], F.lit(")"), appendix(s)))
    parts = [
        F.concat(F.lit("# "), F.coalesce(F.nullif(m + "title", F.lit("")), "paper_id")),
        F.concat(F.lit("> Paper ID: `"), F.col("paper_id"), F.lit("`\n> Schema: v"), F.col("schema_version")),
        F.lit("`paper.json` is the whole record; the other files show the same data one item at a time."),
        F.when(F.col(m + "abstract") != "", F.concat(F.lit("## Abstract\n\n"), short(F.col(m + "abstract"), 400))),
        F.concat(F.lit("## Outline\n\n"), lines(outline)), F.lit("## Entity index"),
    ]

    def listed(kind: str):
        return lambda e: F.concat(F.lit("- `"), e["id"], F.lit("` — "), short(_caption(kind, e), 80), F.lit(" → ["), e["file"], F.lit("]("), e["file"], F.lit(")"), appendix(e))

    for kind in KINDS:
        parts.append(F.when(F.size(kind) > 0, F.concat(F.lit(f"### {kind.capitalize()} ("), F.size(kind), F.lit(")\n\n"), lines(F.transform(kind, listed(kind))))))
    known = F.size(F.filter("citations", lambda c: c["title"].isNotNull()))
    top = F.transform(F.slice("citations", 1, 5), lambda c: F.concat(F.lit("- `[@"), c["key"], F.lit("]` ("), c["count"], F.lit("× cited)"), F.coalesce(F.concat(F.lit(" — "), c["title"]), F.lit(""))))
    parts.append(F.when(F.size("citations") > 0, F.concat(F.lit("### Citations ("), F.size("citations"), F.lit(" keys, "), known, F.lit(" resolved)\n\n"), lines(top))))
    sources = [F.concat(F.lit(f"- `{s}`: `"), F.col(m + s), F.lit("`")) for s in ("title_source", "abstract_source", "authors_source")]
    parts.append(F.concat(F.lit("## Provenance\n\n"), F.concat_ws("\n", *sources)))
    counts = [F.concat(F.lit(f"- {k}: "), F.size(k)) for k in ("sections", *KINDS, "citations", "footnotes")]
    parts.append(F.concat(F.lit("## Counts\n\n"), F.concat_ws("\n", *counts)))
    return full.select("paper_id", F.lit("README.md").alias("path"), F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("content"))


def folder_rows(records: DataFrame) -> DataFrame:
    """(paper_id, path, content) of every file of every paper; records should be stored, as they are read for each kind."""
    full = _with_files(records)
    parts = [_sections(records), *(f for kind in KINDS for f in _entities(records, kind))]
    parts.append(records.select("paper_id", F.lit("references.json").alias("path"), F.to_json("citations", {"ignoreNullFields": "false"}).alias("content")))
    parts.append(records.select("paper_id", F.lit("footnotes.json").alias("path"), F.to_json("footnotes", {"ignoreNullFields": "false"}).alias("content")))
    parts.append(full.select("paper_id", F.lit("paper.json").alias("path"), json_of(F.struct("*")).alias("content")))
    return reduce(DataFrame.unionByName, [*parts, _overview(full)])


def asset_copies(assets: DataFrame) -> DataFrame:
    """(paper_id, path, target) for resolved figure assets (paper_id, entity_id, place, ref, path).

    A figure's single image takes its base name; of several each has its place behind it, and
    unresolved ones leave gaps.
    """
    many = F.count("*").over(Window.partitionBy("paper_id", "entity_id")) > 1
    base = entity_file("fig", F.col("entity_id"))
    tail = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    target = F.concat(F.lit("figures/"), base, F.when(many, F.concat(F.lit("-"), F.col("place") + 1)).otherwise(""), tail)
    return assets.withColumn("target", target).where("path is not null").select("paper_id", "path", "target")


def write_folder_view(records: DataFrame, folder: str) -> DataFrame:
    """Write all files below ``folder``/<paper_id>/ and return (paper_id, files).

    ``folder`` must be one that all executors share.  Writing a file replaces it, so a
    repeated task does no harm.  Nothing is written before the result is used.
    """
    root = folder.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            papers = batch.column("paper_id").to_pylist()
            for paper, path, content in zip(papers, batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = os.path.join(root, paper, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(content or "")
                os.replace(part, target)
            yield pa.RecordBatch.from_arrays([pa.array(papers, pa.string())], names=["paper_id"])

    return folder_rows(records).mapInArrow(run, "paper_id string").groupBy("paper_id").agg(F.count("*").alias("files"))
