"""Queries on the quality of records and on figure enrichment, over conversations, events and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog.common import register
from scriptorium.operators import quality as Q
from scriptorium.operators import visuals as V
from scriptorium.sources.tables import table


def figures_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a figure: all its turns, whole, are the visible texts, some refused, some cut off."""
    c, n = F.col("conv_id"), F.col("conv_id")
    text = F.when((F.col("turn") == 0) & (n % 6 == 0), F.concat(F.lit("I'm sorry, I cannot help. "), F.col("text"))).otherwise(F.col("text"))
    text = F.when(n % 7 == 0, F.concat(text, F.lit("..."))).otherwise(text)
    role = F.when(F.col("role") == "assistant", "Response").when(F.col("role") == "user", "prompt").otherwise("odd")
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("text"), role.alias("role")))), lambda x: F.struct(x["text"].alias("text"), x["role"].alias("role")))
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and text is not null").groupBy(c).agg(items.alias("items"))
    status = F.when(n % 11 == 1, "vlm_failed").when(n % 11 == 2, "no_visible_text").otherwise("ok")
    return rows.select(
        c.alias("conv_id"), (n % 13 != 0).alias("has_visual"), F.when(n % 13 == 0, "").otherwise(status).alias("status"), (n % 5 != 0).alias("asset_exists"), (n % 17 != 0).alias("has_paper_visual"),
        F.when(n % 17 == 0, None).when(n % 19 == 0, "other").otherwise(F.when(n % 13 == 0, "").otherwise(status)).alias("paper_status"),
        F.when(n % 13 == 0, None).when(n % 11 == 3, F.array().cast("array<struct<text:string,role:string>>")).otherwise(F.col("items")).alias("visible_text"),
        F.lit(None).cast("array<struct<text:string,kind:string,notes:string>>").alias("safety_relevant_content"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("uncertain"),
    )


_REFUSAL = V.REFUSAL.replace("'", "''")
_TRUNCATED = V.TRUNCATED.replace("'", "''")
_TURNS = """
WITH c0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t, r) AS place FROM (
    SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN x || '...' ELSE x END AS t, CASE WHEN role = 'assistant' THEN 'Response' WHEN role = 'user' THEN 'prompt' ELSE 'odd' END AS r
    FROM (SELECT *, CASE WHEN turn = 0 AND conv_id % 6 = 0 THEN 'I''m sorry, I cannot help. ' || text ELSE text END AS x FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL))
), ids AS (SELECT DISTINCT conv_id FROM c0), c AS (SELECT * FROM c0 WHERE conv_id % 13 <> 0 AND conv_id % 11 <> 3)"""
STATS = _TURNS + f""", st AS (
  SELECT conv_id, count(*) AS items, coalesce(string_agg(t, chr(10) ORDER BY place) FILTER (t <> ''), '') AS joined, string_agg(t, chr(10) ORDER BY place) AS whole,
    bool_or(length(t) >= CASE WHEN r = 'response' THEN 700 ELSE 2400 END - 20 OR regexp_matches(t, '(\\.\\.\\.|…)\\s*$')) AS cut FROM c GROUP BY 1
), x AS (
  SELECT ids.conv_id, coalesce(items, 0) AS items, coalesce(joined, '') AS joined, coalesce(cut, false) OR regexp_matches(coalesce(joined, ''), '{_TRUNCATED}') AS cut,
    regexp_matches(coalesce(joined, ''), '{_REFUSAL}') AS refused, trim(regexp_replace(coalesce(whole, ''), '{_REFUSAL}', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS beside,
    ids.conv_id % 13 <> 0 AS has, CASE WHEN ids.conv_id % 13 = 0 THEN '' WHEN ids.conv_id % 11 = 1 THEN 'vlm_failed' WHEN ids.conv_id % 11 = 2 THEN 'no_visible_text' ELSE 'ok' END AS status
  FROM ids LEFT JOIN st USING (conv_id)
), b AS (SELECT *, list_filter([
    CASE WHEN NOT has THEN 'missing_visual_extraction' WHEN status <> '' AND status <> 'ok' THEN 'status_' || status END,
    CASE WHEN has AND status = 'ok' AND items = 0 THEN 'ok_empty_visible_text' END, CASE WHEN has AND conv_id % 5 = 0 THEN 'asset_file_missing_now' END,
    CASE WHEN has AND conv_id % 17 = 0 THEN 'paper_json_missing_visual_extraction' WHEN has AND conv_id % 19 = 0 THEN 'paper_json_status_mismatch' END,
    CASE WHEN refused AND length(joined) < 450 AND length(beside) < 180 AND items <= 3 THEN 'refusal_like_only_or_too_short' WHEN refused THEN 'contains_refusal_text_rich_context' END,
    CASE WHEN cut THEN 'possible_truncated_text' END], lambda q: q IS NOT NULL) AS found FROM x
), bk AS (SELECT *, CASE WHEN len(found) = 0 THEN ['ok'] ELSE found END AS buckets FROM b)"""
_STRICT = "[" + ", ".join(f"'{s}'" for s in V.STRICT) + "]"


@register(STATS + f" SELECT conv_id, array_to_string(buckets, ',') AS buckets, list_has_any(buckets, {_STRICT}) AS strict, CAST(length(joined) AS BIGINT) AS chars FROM bk")
def figure_text_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.buckets(figures_of_turns(spark, sf_dir)).select("conv_id", F.array_join("buckets", ",").alias("buckets"), "strict", F.col("text_chars").cast("long").alias("chars"))


@register(STATS + " SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(buckets) AS bucket FROM bk) GROUP BY 1")
def figure_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bucket_counts(V.buckets(figures_of_turns(spark, sf_dir)), [])


@register("""WITH w AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'response' WHEN role = 'user' THEN 'prompt' ELSE 'other' END AS role, trim(text) AS whole, CASE WHEN role = 'assistant' THEN 700 ELSE 2400 END AS most FROM conversations WHERE text IS NOT NULL
), t AS (SELECT *, CASE WHEN length(whole) > most THEN rtrim(left(whole, most)) || chr(10) || '[truncated: visible text continues in figure]' ELSE whole END AS text FROM w
), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, lower(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY turn) AS again FROM t WHERE text <> '')
SELECT conv_id, CAST(count(*) AS BIGINT) AS items, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) FILTER (role = 'response') AS BIGINT) AS responses FROM d WHERE again = 1 GROUP BY 1""")
def visible_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as visible texts, each twice: roles mapped, long texts cut, repeats dropped."""
    role = F.when(F.col("role") == "assistant", "Response").when(F.col("role") == "user", "PROMPT").otherwise("odd")
    rows = table(spark, sf_dir, "conversations").where("text is not null").withColumn("x", F.explode(F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("k")), F.struct(F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("text"), F.lit(1).alias("k")))))
    items = F.transform(F.array_sort(F.collect_list(F.struct("x.k", "turn", "x.text", role.alias("role")))), lambda x: F.struct(x["text"].alias("text"), x["role"].alias("role")))
    out = V.normalize_visible(rows.groupBy("conv_id").agg(items.alias("visible_text")), blanks=r" +\z").where(F.size("visible_text") > 0)
    total = F.aggregate("visible_text", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    return out.select("conv_id", F.size("visible_text").cast("long").alias("items"), total.alias("chars"), F.size(F.filter("visible_text", lambda x: x["role"] == "response")).cast("long").alias("responses"))


@register("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 5 = 4 THEN NULL ELSE 'ok' END AS status FROM events WHERE props IS NOT NULL AND event_id % 5 < 5")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with fences, words around, missing and trailing commas; every fifth is the bare object."""
    p, n = F.col("props"), F.col("event_id")
    inner = F.regexp_extract(p, r"^\{(.*)\}$", 1)
    answer = (
        F.when(n % 5 == 0, F.concat(F.lit("```json\n{\"status\": \"ok\", "), inner, F.lit(",}\n```")))
        .when(n % 5 == 1, F.concat(F.lit("Here it is: {"), inner, F.lit("\n\"status\": \"ok\"} - done")))
        .when(n % 5 == 2, F.concat(F.lit("{\"status\": \"ok\",, "), inner, F.lit("}")))
        .when(n % 5 == 3, F.concat(F.lit("{"), inner, F.lit(", \"visible_text\": [1, 2,]\n\"status\": \"ok\"}")))
        .otherwise(p)
    )
    fixed = table(spark, sf_dir, "events").where("props is not null").select("event_id", V.json_object(answer).alias("j"))
    return fixed.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.status").alias("status"))


@register("""SELECT event_id, CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'ok' WHEN event_id % 7 = 0 THEN 'asset_missing' WHEN event_id % 5 = 0 THEN 'unsupported_asset' WHEN event_id % 11 = 0 THEN 'render_failed'
WHEN event_id % 3 = 0 THEN 'no_visible_text' WHEN event_id % 13 = 0 THEN 'vlm_failed' ELSE 'ok' END AS status FROM events""")
def figure_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    status = V.outcome(n % 7 != 0, F.when(n % 5 == 0, "svg").otherwise("PNG"), n % 11 != 0, n % 3 != 0, F.when(n % 13 != 0, "ok"), n % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@register("SELECT CAST(user_id AS VARCHAR) AS paper_id, CAST(event_id AS VARCHAR) AS figure_id FROM events WHERE event_id % 3 = 1 OR event_id % 3 = 2 AND event_id % 2 = 0")
def figures_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to do: a third is done, a third has another asset since, of the rest some failed."""
    n = F.col("event_id")
    figures = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("paper_id"), n.cast("string").alias("figure_id"), F.sha2(n.cast("string"), 256).alias("asset_sha256"), n.alias("n"))
    prior = figures.select("paper_id", "figure_id", F.when(F.col("n") % 3 == 1, F.lit("old")).otherwise(F.col("asset_sha256")).alias("asset_sha256"), F.when((F.col("n") % 3 == 2) & (F.col("n") % 2 == 0), "render_failed").otherwise("ok").alias("status"))
    return V.work_left(figures.drop("n"), prior, retry_failed=True).select("paper_id", "figure_id")


@register("SELECT CAST(user_id AS VARCHAR) AS paper_id, CASE WHEN event_type = 'view' THEN 'missing' ELSE event_type END AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def figure_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 2 == 0, "")).otherwise(F.col("event_type"))
    return Q.status_counts(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("paper_id"), status.alias("status")))


@register("""SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'fig:1' AS figure_id, problem FROM documents, (VALUES ('no_file', 3), ('no_record', 5), ('duplicate_id', 7)) p(problem, m)
WHERE doc_id % m = 0 AND (problem <> 'duplicate_id' OR doc_id % 5 <> 0) AND (problem <> 'no_file' OR doc_id % 5 <> 0) AND (problem <> 'no_record' OR doc_id % 3 <> 0)""")
def figure_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    base = table(spark, sf_dir, "documents").select(n.cast("string").alias("paper_id"), F.lit("fig:1").alias("figure_id"), n)
    records = base.where(n % 5 != 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.when(n % 7 == 0, 1).otherwise(0))))
    return Q.figure_differences(records.select("paper_id", "figure_id"), base.where(n % 3 != 0).select("paper_id", "figure_id"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose faults follow from doc_id."""
    n = F.col("doc_id")

    def some(when: Column, value) -> Column:
        return F.when(when, F.lit(None) if value is None else F.lit(value))

    sections = F.transform(F.sequence(F.lit(1), (n % 10 + 1).cast("int")), lambda i: F.struct(F.when(i * 2 <= n % 10, " ").otherwise("text").alias("text")))
    status = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(F.lit("fig").alias("id"), F.when(n % 13 == i, None).when(n % 17 == i, "vlm_failed").otherwise("ok").alias("status")))
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("paper_id"), some(n % 50 == 0, "{bad").alias("corrupt"), F.when(n % 7 == 0, "0.3").otherwise("0.5").alias("schema_version"), sections.alias("sections"),
        F.when(n % 9 == 0, " ").otherwise("T").alias("title"), F.lit("none").alias("title_source"), some(n % 8 != 0, "A").alias("abstract"), F.lit("none").alias("abstract_source"),
        F.array(F.struct(F.lit("lst:1").alias("id"), F.when(n % 21 == 0, "a\nb").otherwise("python").alias("language"))).alias("listings"),
        F.array(F.struct(F.lit("\\x").alias("command"), (n % 30).cast("int").alias("count"))).alias("residue_top"), F.array(F.struct(F.when(n % 6 == 0, None).otherwise("t").alias("title"))).alias("citations"),
        status.alias("figures"), (n % 12 != 0).alias("has_binary"),
    )


_FINDINGS = """WITH f AS (
  SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS paper_id, p.severity, p.kind FROM documents, (VALUES ('HIGH', 'unreadable_paper_json'), ('HIGH', 'schema_mismatch'), ('HIGH', 'too_few_sections'), ('MED', 'many_empty_sections'), ('HIGH', 'empty_title'), ('MED', 'empty_abstract'),
    ('HIGH', 'listing_language_is_content'), ('MED', 'high_residue_command'), ('LOW', 'zero_citation_resolution'), ('LOW', 'figures_without_binary'), ('LOW', 'figures_missing_visual_extraction'), ('LOW', 'figures_visual_extraction_failed')) p(severity, kind)
), k AS (SELECT * FROM f WHERE CASE WHEN kind = 'unreadable_paper_json' THEN n % 50 = 0 WHEN n % 50 = 0 THEN false WHEN kind = 'schema_mismatch' THEN n % 7 = 0 WHEN kind = 'too_few_sections' THEN n % 10 = 0
  WHEN kind = 'many_empty_sections' THEN (n % 10 // 2) * 10 > 3 * (n % 10 + 1) WHEN kind = 'empty_title' THEN n % 9 = 0 WHEN kind = 'empty_abstract' THEN n % 8 = 0 WHEN kind = 'listing_language_is_content' THEN n % 21 = 0
  WHEN kind = 'high_residue_command' THEN n % 30 >= 25 WHEN kind = 'zero_citation_resolution' THEN n % 6 = 0 WHEN kind = 'figures_without_binary' THEN n % 12 = 0 WHEN kind = 'figures_missing_visual_extraction' THEN n % 13 IN (1, 2)
  ELSE n % 17 = 1 AND n % 13 <> 1 OR n % 17 = 2 AND n % 13 <> 2 END)"""


@register(_FINDINGS + " SELECT paper_id, severity, kind FROM k")
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.findings(_audited(spark, sf_dir)).select("paper_id", "severity", "kind")


@register(_FINDINGS + """ SELECT severity, kind, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(paper_id))[1:3], ',') AS examples,
  CAST(row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MED' THEN 1 ELSE 2 END, count(*) DESC, kind) AS BIGINT) AS place FROM k GROUP BY 1, 2""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Q.finding_counts(Q.findings(_audited(spark, sf_dir)), 3)
    return r.select("severity", "kind", "n", F.array_join("examples", ",").alias("examples"), F.col("place").cast("long").alias("place"))
