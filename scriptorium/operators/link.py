"""Links between entities and sections: as-of binding, back references, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bind(entities: DataFrame, sections: DataFrame) -> DataFrame:
    """``entities`` with defined_in and is_appendix of the deepest section that contains them.

    That is the last section that starts at or before the entity, so one window over the
    union of both answers it (a backward as-of join); before the first heading it is null.
    """
    marks = sections.select("paper_id", F.col("start").alias("at"), F.lit(0).alias("tag"), F.struct("section_id", "is_appendix").alias("section"), F.lit(None).cast(entities.select(F.struct("*")).schema[0].dataType).alias("entity"))
    rows = entities.select("paper_id", F.col("position").alias("at"), F.lit(1).alias("tag"), F.lit(None).cast(marks.schema["section"].dataType).alias("section"), F.struct("*").alias("entity"))
    upto = Window.partitionBy("paper_id").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(rows).withColumn("last", F.last("section", ignorenulls=True).over(upto)).where("tag = 1")
    return found.select("entity.*", F.col("last.section_id").alias("defined_in"), F.coalesce("last.is_appendix", F.lit(False)).alias("is_appendix"))


def referenced_in(entities: DataFrame, marked: DataFrame) -> DataFrame:
    """(paper_id, entity_id, referenced_in): sections that name the id first, then those that name the label."""
    used = marked.select("paper_id", "section_id", "order", F.explode_outer(F.array_distinct("refs")).alias("name")).where("name is not null")
    names = entities.select("paper_id", "entity_id", F.explode(F.array(F.struct(F.lit(1).alias("priority"), F.col("entity_id").alias("name")), F.struct(F.lit(2).alias("priority"), F.col("label").alias("name")))).alias("n")).select("paper_id", "entity_id", "n.*").where("name is not null")
    met = used.join(names, ["paper_id", "name"]).groupBy("paper_id", "entity_id", "section_id", "order").agg(F.min("priority").alias("priority"))
    return met.groupBy("paper_id", "entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "order", "section_id"))), lambda s: s["section_id"]).alias("referenced_in"))


_KINDS = ["figure", "table", "equation", "algorithm", "listing"]


def label_ids(entities: DataFrame) -> DataFrame:
    """(paper_id, label, entity_id); of kinds that share a label the last one wins."""
    rank = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind"))
    return entities.where("label is not null").groupBy("paper_id", "label").agg(F.max_by("entity_id", F.struct(rank, "ordinal")).alias("entity_id"))


def rewrite_refs(marked: DataFrame, entities: DataFrame) -> DataFrame:
    """``marked`` with refs and the markers in the text turned to canonical ids; unknown names stay."""
    table = label_ids(entities).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "entity_id"))).alias("ids"))
    out = marked.join(table, "paper_id", "left")

    def known(name: Column) -> Column:
        return F.coalesce(F.try_element_at("ids", name), name)

    pattern = r"\[#[^\[\]]*+\]"
    parts, found = F.split("marked", pattern, -1), F.regexp_extract_all("marked", F.lit(pattern), F.lit(0))
    out = out.withColumn("g", parts).withColumn("m", found)

    def one(match: Column) -> Column:
        names = F.transform(F.split(F.substring(match, F.lit(2), F.length(match) - 2), "; "), lambda n: F.concat(F.lit("#"), known(F.substring(n, F.lit(2), F.length(n)))))
        return F.concat(F.lit("["), F.array_join(names, "; "), F.lit("]"))

    text = F.array_join(F.flatten(F.transform("g", lambda g, i: F.when(i < F.size("m"), F.array(g, one(F.get("m", i)))).otherwise(F.array(g)))), "")
    return out.withColumn("marked", text).withColumn("refs", F.transform("refs", known)).drop("g", "m", "ids")
