"""Texts of figure environments, matches of figure files, and reports, case by case."""

import json
import os

from pyspark.sql import functions as F

from scriptorium.functions import kernels as K
from scriptorium.operators import figure_audit as A


def test_marked_parts():
    tex = "\\node {\n% ===== User Input Begin =====\nPlease \\textbf{go}.\n% ===== User Input End =====\n};\n% == GPT  Output Begin ==\nYes.\n% == GPT  Output End ==\n% = Left Begin =\n"
    assert K.visible_segments(tex) == [("Please go.", "latex_marker:user_input", "prompt", "high"), ("Yes.", "latex_marker:model_output", "response", "high")]
    # A mark without its end does not hide later ones; a mark inside another part is no part.
    tex = "% = A Begin =\nx\n% = B Begin =\ny\n% = C Begin =\nz\n% = C End =\n% = B End =\n"
    assert [s[1] for s in K.visible_segments(tex)] == ["latex_marker:b"]


def test_boxes_and_whole():
    boxes = "\\begin{mybox}{\\textbf{A {deep {Prompt}}}}\nOne.\n\\end{mybox}\\begin{mybox}Two.\\end{mybox}\\begin{mybox}open"
    assert [(s[0], s[2]) for s in K.visible_segments(boxes)] == [("A deep Prompt\n\nOne.", "prompt"), ("Two.", "other")]
    assert K.visible_segments("\\centering (some; text) [x]") == [("some text x", "latex_figure_environment", "other", "medium")]
    assert K.visible_segments("") == [] and K.visible_segments("% a comment") == []


def test_environment_by_label_then_number(spark):
    tex = "% \\begin{figure}\n% out\n% \\end{figure}\n\\begin{figure}[t]\nfirst one\n\\end{figure}\n\\begin{figure*}\nsecond one\\label{fig:b}\n\\end{figure*}"
    docs = spark.createDataFrame([("p", tex), ("q", None)], "paper_id string, tex string")
    figures = spark.createDataFrame([("p", "fig:1", None), ("p", "fig:9", "fig:b"), ("p", "fig:7", "none"), ("q", "fig:1", None)], "paper_id string, figure_id string, latex_label string")
    got = {r["figure_id"]: r["visual_extraction"] for r in A.latex_fallback(docs, figures).collect()}
    assert {k: v["visible_text"][0]["text"] for k, v in got.items()} == {"fig:1": "first one", "fig:9": "second one"}
    assert got["fig:1"]["status"] == "ok" and got["fig:1"]["figure_role"] == "other" and got["fig:1"]["safety_relevant_content"] == []
    assert A.latex_fallback(docs.limit(0), figures.limit(0)).count() == 0


def test_matches_and_assets_with_nulls(spark):
    files = spark.createDataFrame([("p", "figures/a.json", None, "fig:a", None, None), ("p", "figures/b.json", "", None, None, "x/b.gif")], "paper_id string, path string, file string, figure_id string, latex_label string, src_ref string")
    figures = spark.createDataFrame([("p", 0, None, "fig:a", None), ("p", 1, "fig:a", None, None), ("q", 2, None, "fig:a", None)], "paper_id string, place int, file string, figure_id string, latex_label string")
    assert {r["path"]: r["place"] for r in A.match_records(files, figures).collect()} == {"figures/a.json": 1, "figures/b.json": None}
    listing = spark.createDataFrame([("p", "figures/b.gif"), ("q", "figures/a.pdf")], "paper_id string, path string")
    assert {r["path"]: r["asset_path"] for r in A.present_assets(files, listing).collect()} == {"figures/a.json": None, "figures/b.json": "figures/b.gif"}


def test_reports(spark, tmp_path):
    rows = [("p", f"f{i}.json", f"fig:{i}", "ok", ["ok"] if i % 2 else ["possible_truncated_text", "contains_refusal_text_rich_context"], False, 10 + i, 2, ["sorry"], True, None) for i in range(60)]
    shape = "paper_id string, figure_file string, figure_id string, status string, buckets array<string>, strict boolean, text_chars int, text_words int, refusal_markers array<string>, maybe_truncated boolean, asset_path string"
    classified = spark.createDataFrame(rows, shape)
    A.write_reports(classified, str(tmp_path))
    read = spark.read.csv(f"{tmp_path}/truncated_review.csv", header=True)
    assert read.count() == 30 and read.where(F.col("buckets") == "possible_truncated_text;contains_refusal_text_rich_context").count() == 30
    assert spark.read.csv(f"{tmp_path}/figure_text_audit.csv", header=True).count() == 60 and spark.read.csv(f"{tmp_path}/strict_issues.csv", header=True).count() == 0
    assert spark.read.json(f"{tmp_path}/figure_text_audit.json").count() == 60
    [part] = [f for f in os.listdir(tmp_path / "SUMMARY.md") if f.startswith("part-")]
    text = (tmp_path / "SUMMARY.md" / part).read_text()
    assert text.startswith("\n## total\n\n- figures: 60\n- strict: 0\n- issues: 30\n") and text.count("status=`ok`") == 25 and "- `p`: 60" in text
    assert json.loads(A.summary(classified.limit(0)).toJSON().first())["n"] == 0
