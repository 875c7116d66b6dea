"""Figure enrichment: what an extractor returned, normalized and audited; calls to extractors are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import strip, word_count
from scriptorium.functions.udfs import first_places
from scriptorium.operators.quality import FAILED

# Roles, kinds, limits and marks of the enrichment records.
ROLES = ["prompt", "response", "model_response", "label", "axis", "legend", "ui_text", "annotation", "other"]
ANSWER_ROLES = ["response", "model_response"]
SAFETY_KINDS = ["jailbreak_prompt", "injected_instruction", "target_query", "model_response", "credential_or_identifier", "ui_state", "other"]
GENERATED = ["generated output", "harmful output", "model output", "model response", "response generated", "generated under"]
MAX_TEXT, MAX_ANSWER, MAX_SAFETY, MAX_SAFETY_ITEMS = 2400, 700, 1200, 5
CAPS = {"visible_text": 2400, "summary": 2400, "safety_relevant_content": 1200}
UNREADABLE = ["", "[unreadable]", "<unreadable>", "unreadable"]
CUT_MARK = "\n[truncated: visible text continues in figure]"
REFUSAL = (
    r"(?i)\b(i\s*(?:am|'m|’m)\s+sorry|i\s+apologize|sorry[, ]|i\s+can(?:not|'t|’t)|cannot\s+(?:assist|help|fulfill|provide|comply)|"
    r"can(?:not|'t|’t)\s+(?:assist|help|fulfill|provide|comply)|unable\s+to\s+(?:assist|help|fulfill|provide|comply)|content\s+policy|harmful\s+request|unsafe\s+request)\b"
)
TRUNCATED = r"(?i)(\.\.\.|…|\[truncated\]|<truncated>|truncated due to|cut off)"
STRICT = [
    "missing_visual_extraction", "status_no_visible_text", "status_asset_missing", "status_vlm_failed", "status_render_failed", "status_codex_prompt_failed",
    "ok_empty_visible_text", "refusal_like_only_or_too_short",
]
ASSET_TYPES = ["pdf", "png", "jpg", "jpeg"]


def text_items(df: DataFrame) -> DataFrame:
    """``df`` (visible_text, safety_relevant_content, summary, uncertain) with items: struct(source, role, text)."""
    def item(source: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def several(name: str, role: str) -> Column:
        found = F.transform(name, lambda x: item(name, x[role], x["text"]))
        return F.coalesce(found, F.array().cast("array<struct<source:string,role:string,text:string>>"))

    single = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), item(n, F.lit(""), F.col(n))) for n in ("summary", "uncertain"))))
    return df.withColumn("items", F.concat(several("visible_text", "role"), several("safety_relevant_content", "kind"), single))


def statistics(df: DataFrame) -> DataFrame:
    """``df`` with items and text_chars, text_words, refusal_markers (sorted, distinct), maybe_truncated, beside (text without refusals)."""
    out = text_items(df)
    out = out.withColumn("_joined", F.array_join(F.filter(F.transform("items", lambda x: x["text"]), lambda t: t != ""), "\n"))
    def cap(x: Column) -> Column:
        by_source = F.when(x["source"].isin("visible_text", "summary"), MAX_TEXT).when(x["source"] == "safety_relevant_content", MAX_SAFETY)
        return F.when(x["role"].isin(ANSWER_ROLES), F.least(F.coalesce(by_source, F.lit(MAX_ANSWER)), F.lit(MAX_ANSWER))).otherwise(by_source)

    cut = F.exists("items", lambda x: F.coalesce(F.length(x["text"]) >= cap(x) - 20, F.lit(False)) | x["text"].rlike(r"(?:\.\.\.|…)\s*$"))
    whole = F.array_join(F.transform("items", lambda x: x["text"]), "\n")
    return out.withColumns({
        "text_chars": F.length("_joined"), "text_words": word_count(F.col("_joined")),
        "refusal_markers": F.array_sort(F.array_distinct(F.regexp_extract_all("_joined", F.lit(REFUSAL), F.lit(1)))),
        "maybe_truncated": F.col("_joined").rlike(TRUNCATED) | cut, "beside": strip(F.regexp_replace(whole, REFUSAL, "")),
    }).drop("_joined")


def buckets(df: DataFrame) -> DataFrame:
    """``df`` with buckets and strict.

    Reads has_visual, status, asset_exists, paper_status (null without a record), has_paper_visual
    and the item columns.
    """
    out = statistics(df)
    has, status = F.col("has_visual"), F.col("status")
    refused = F.size("refusal_markers") > 0
    poor = (F.col("text_chars") < 450) & (F.length("beside") < 180) & (F.size("items") <= 3)
    named = F.array_compact(F.array(
        F.when(~has, "missing_visual_extraction").when((status != "") & (status != "ok"), F.concat(F.lit("status_"), status)),
        F.when(has & (status == "ok") & (F.coalesce(F.size("visible_text"), F.lit(0)) <= 0), "ok_empty_visible_text"),
        F.when(has & ~F.col("asset_exists"), "asset_file_missing_now"),
        F.when(has & ~F.col("has_paper_visual"), "paper_json_missing_visual_extraction").when(has & ~F.col("paper_status").eqNullSafe(status), "paper_json_status_mismatch"),
        F.when(refused & poor, "refusal_like_only_or_too_short").when(refused, "contains_refusal_text_rich_context"),
        F.when(F.col("maybe_truncated"), "possible_truncated_text"),
    ))
    out = out.withColumn("buckets", F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("ok"))))
    return out.withColumn("strict", F.arrays_overlap("buckets", F.array(*map(F.lit, STRICT))))


def bucket_counts(classified: DataFrame, by: list[str]) -> DataFrame:
    return classified.select(*by, F.explode("buckets").alias("bucket")).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def _capped(text: Column, limit: Column, blanks: str = r"(?U)\s+$") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, F.lit(1), limit), blanks, ""), F.lit(CUT_MARK))).otherwise(text)


def _first_of_each(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Items that no earlier one equals in kind and in text, white space and case aside."""
    key = F.transform(column, lambda x: F.concat(x[kind], F.lit("\u0000"), F.lower(F.trim(F.regexp_replace(x["text"], r"(?U)\s+", " ")))))
    kept = F.transform("_first", lambda i: F.get(column, i))
    # Behind an explode, as a later filter by the items would go below and find all of them anew for each one.
    return df.withColumn("_first", first_places(key)).withColumn(column, F.explode_outer(F.array(kept))).drop("_first")


def normalize_visible(df: DataFrame, column: str = "visible_text", blanks: str = r"(?U)\s+$") -> DataFrame:
    """Trimmed texts, known roles, cut at the limit, without unreadable ones and repeats.

    blanks: a pattern of what goes from the end of a text that was cut.
    """
    items = F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))
    items = F.transform(items, lambda x: x.withField("text", strip(F.coalesce(x["text"], F.lit("")))).withField("role", F.lower(F.coalesce(x["role"], F.lit("other")))))
    items = F.filter(items, lambda x: ~F.lower(x["text"]).isin(UNREADABLE))

    def one(x: Column) -> Column:
        role = F.when(x["role"].isin(ROLES), x["role"]).otherwise("other")
        limit = F.when(role.isin(ANSWER_ROLES), MAX_ANSWER).otherwise(MAX_TEXT)
        return x.withField("truncated", F.length(x["text"]) > limit).withField("text", _capped(x["text"], limit, blanks)).withField("role", role)

    return _first_of_each(df.withColumn(column, F.transform(items, one)), column, "role")


def normalize_safety(df: DataFrame, column: str = "safety_relevant_content") -> DataFrame:
    """The same for safety items; output of models goes, five stay at most."""
    items = F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    said = lambda x: F.exists(F.array(*map(F.lit, GENERATED)), lambda g: low(x["notes"]).contains(g))
    items = F.filter(items, lambda x: ~((low(x["kind"]) == "model_response") | (low(x["kind"]).isin("injected_instruction", "other") & said(x))))
    items = F.transform(items, lambda x: x.withField("text", strip(F.coalesce(x["text"], F.lit("")))).withField("kind", F.when(low(x["kind"]).isin(SAFETY_KINDS), low(x["kind"])).otherwise("other")))
    items = F.transform(F.filter(items, lambda x: ~F.lower(x["text"]).isin(UNREADABLE)), lambda x: x.withField("truncated", F.length(x["text"]) > MAX_SAFETY).withField("text", _capped(x["text"], F.lit(MAX_SAFETY))))
    out = _first_of_each(df.withColumn(column, items), column, "kind")
    return out.withColumn(column, F.slice(column, 1, MAX_SAFETY_ITEMS))


def final_status(status: Column, visible: Column) -> Column:
    """An ok without any text is no_visible_text."""
    return F.when((status == "ok") & (F.size(visible) <= 0), "no_visible_text").otherwise(status)


_KEYS = '"(?:status|figure_role|visible_text|safety_relevant_content|summary|uncertain)"'
_REPAIRS = [
    (r",(\s*[}\]])", "$1"), (r"\}\s*\n\s*\{", "},\n{"), (r"\]\s*\n\s*" + '"', '],\n"'), (r"\}\s*\n\s*" + '"', '},\n"'),
    (rf"({_KEYS}\s*:)", ",$1"), (r"\{\s*,", "{"), (r",\s*,", ","),
]


def json_object(answer: Column) -> Column:
    """The JSON object in an extractor's answer, or null: as it is, the part between braces, or either one repaired."""
    plain = F.regexp_replace(strip(answer), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    fixed = []
    for c in (plain, inner):
        for pattern, by in _REPAIRS:
            c = F.regexp_replace(c, pattern, by)
        fixed.append(c)
    able = F.filter(F.array(plain, inner, *fixed), lambda c: F.from_json(c, "map<string,string>", {"allowUnquotedControlChars": "true"}).isNotNull())
    return F.get(able, F.lit(0))


def work_left(figures: DataFrame, prior: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Figures (paper_id, figure_id, asset_sha256) that no prior record of the same asset settles."""
    done = prior.where(~F.col("status").isin(FAILED)) if retry_failed else prior
    return figures.join(done.select("paper_id", "figure_id", "asset_sha256").distinct(), ["paper_id", "figure_id", "asset_sha256"], "left_anti")


def outcome(asset: Column, kind: Column, rendered: Column, gate: Column, extracted: Column, fallback: Column) -> Column:
    """The status of a figure by the steps in turn; a fallback text makes a missing asset ok.

    gate: whether local text is enough to be worth a call.  extracted: the extractor's status.
    """
    return (
        F.when(~asset & fallback, "ok").when(~asset, "asset_missing").when(~F.lower(kind).isin(ASSET_TYPES), "unsupported_asset")
        .when(~rendered, "render_failed").when(~gate, "no_visible_text").otherwise(F.coalesce(extracted, F.lit("vlm_failed")))
    )


def text_signal(text: Column, min_chars: int = 12, min_words: int = 3) -> Column:
    """Whether embedded or recognised text is enough: characters without blanks, and words."""
    plain = F.coalesce(text, F.lit(""))
    return (F.length(F.regexp_replace(plain, r"\s+", "")) >= min_chars) & (F.size(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9]+"), F.lit(0))) >= min_words)
