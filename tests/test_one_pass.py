"""Each text is read once: plans in which a costly step stands once, and kernels whose time follows the text's length."""

import re
import time

import pytest

from scriptorium import registry
from scriptorium.functions import kernels as K
from scriptorium.functions import rules as R

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def calls(spark, name, udf):
    return len(re.findall(rf"\b{udf}\(", plan(spark, name)))


@pytest.mark.parametrize("name", ["section_tree", "sections_outline", "section_slices", "cross_paper_sections", "deep_headings"])
def test_headings_are_found_once(spark, name):
    assert calls(spark, name, "headings") == 1


def test_time_of_headings_follows_length():
    def seconds(n):
        text = "\n".join(f"\\section{{A {{b}} {i}}} x \\subsection{{{{c}}}} y {{" for i in range(n))
        at = time.perf_counter()
        assert len(K.headings(text)) == 2 * n
        return time.perf_counter() - at

    assert seconds(20_000) < 30 * max(seconds(2_000), 0.01)


ENTITIES = ["canonical_ids", "entity_binding_asof", "referenced_in", "ref_rewrite", "figures", "tables", "listings", "listing_records", "listing_float_attributes", "figure_bodies", "cross_paper_key_lookup"]


@pytest.mark.parametrize("name", ENTITIES)
def test_environments_are_found_once(spark, name):
    text = plan(spark, name)
    assert text.count("run(tex") == (name != "cross_paper_key_lookup")
    assert "regexp_extract_all(tex" not in text


def test_time_of_environments_follows_length():
    from scriptorium.operators.entities import ENVIRONMENTS

    names, tokens = {k: re.compile(v) for k, v in ENVIRONMENTS.items()}, K.environment_tokens("|".join(ENVIRONMENTS.values()))

    def seconds(n):
        text = "\\begin{listing}\\begin{minted}a\\end{minted}\\caption{a {b}}\\end{listing}\\begin{figure} never closed {" * n
        at = time.perf_counter()
        assert len(K.environments(text, names, tokens)) == 2 * n
        return time.perf_counter() - at

    assert seconds(10_000) < 30 * max(seconds(1_000), 0.01)


@pytest.mark.parametrize("name", ["denoise_text", "footnotes_numbered"])
def test_sections_are_marked_and_cleaned_by_one_kernel(spark, name):
    text = plan(spark, name)
    assert calls(spark, name, {"denoise_text": "cleaned_headings", "footnotes_numbered": "marked_headings"}[name]) == 1
    assert "regexp_extract_all" not in text and "Window" not in text


def test_time_of_cleaning_follows_length():
    def seconds(n):
        text = "\\section{A}" + "a \\cite{k1, k2} \\ref{f}\\footnote{n {x}} $x$ \\textbf{b}\n\\begin{figure}kept \\caption{c}\\end{figure}\n\\begin{lemma}a\\end{lemma} \\% {c}  d\n" * n
        at = time.perf_counter()
        assert R.cleaned_headings(text)[0][-1].count("[^fn:") == n
        return time.perf_counter() - at

    assert seconds(10_000) < 30 * max(seconds(1_000), 0.01)
