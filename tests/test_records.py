"""Trees to records to folders and back, audits, enrichment, ingestion, command line."""

import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from scriptorium.__main__ import arguments, main
from scriptorium.operators import quality as Q
from scriptorium.operators import record as R
from scriptorium.operators import visuals as V
from scriptorium.sources import files as S
from scriptorium.sources import records as J
from scriptorium.sources.folder_view import asset_copies, write_folder_view
from scriptorium.sources.remote import RemotePapers, polite
from scriptorium.sources.synthetic import latex
from scriptorium.streaming.ingest import ingest

TEX = r"""
\documentclass{article}
\newcommand{\us}{Our \emph{System}}
\title{A Study of \us}
\author{Ann Roe \\ University of Here}
\begin{document}
\begin{abstract}We study \us.\end{abstract} % comment
\section{Introduction}
Text \cite{a,b} and \cite{a}, see \ref{fig:one} and \Cref{one}.\footnote{Note \textbf{x}.}
\subsection[Short]{Details \& more}
\begin{figure}\fbox{\parbox{5cm}{A prompt of many words that says \cite{b} enough}}\caption{Cap}\label{figure:one}\end{figure}
\begin{figure}\includegraphics{plot}\includegraphics{missing}\end{figure}
\begin{lstlisting}[language=Python]
x = 1
\end{lstlisting}
\leftover here
\appendix
\section{Proofs}
\begin{equation}\label{eq:e}a=b\end{equation}
"""
BIB = "@article{a, title={Title A}, author={Doe, J and Roe, A}, year={2001}, journal={J}}\n@misc{z, title={Z}}"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees")
    for paper in ("p1", "p2"):
        os.makedirs(root / paper / "img")
        (root / paper / "main.tex").write_text(TEX)
        (root / paper / "refs.bib").write_text(BIB if paper == "p1" else "")
        (root / paper / "img" / "plot.pdf").write_bytes(b"%PDF")
    return str(root)


@pytest.fixture(scope="module")
def records(spark, tree):
    trees = S.scan_trees(spark, tree)
    return R.digest(S.prepared(S.flattened(trees)), S.bib_files(trees)).cache()


def test_record(records):
    r = {x["paper_id"]: x for x in records.collect()}["p1"].asDict(recursive=True)
    m = r["metadata"]
    assert m["title"] == "A Study of Our System" and m["abstract"] == "We study Our System." and m["affiliations"] == ["University of Here"]
    assert [(s["id"], s["title"], s["parent_id"], s["is_appendix"]) for s in r["sections"]] == [("sec:1", "Introduction", None, False), ("sec:1.1", "Details & more", "sec:1", False), ("sec:2", "Proofs", None, True)]
    assert r["sections"][0]["text"] == "Text [@a; @b] and [@a], see [#fig:one] and [#one].[^fn:1]" and r["sections"][0]["char_count"] == len(r["sections"][0]["text"])
    assert [(f["id"], f["defined_in"], f["src_refs"]) for f in r["figures"]] == [("fig:one", "sec:1.1", []), ("fig:2", "sec:1.1", ["plot", "missing"])]
    assert r["figures"][0]["text"].startswith("Caption: Cap\n\nA prompt of many words that says [@b]") and r["figures"][0]["referenced_in"] == ["sec:1"]
    assert [(c["key"], c["count"], c["title"], c["authors"]) for c in r["citations"]] == [("a", 2, "Title A", ["J Doe", "A Roe"]), ("b", 2, None, [])]
    assert r["listings"][0]["code"] == "x = 1" and r["equations"][0]["is_appendix"] and r["footnotes"] == [{"id": "fn:1", "text": "Note \\textbf{x}."}]
    assert r["warnings"] == {"residue_top": [{"command": "\\leftover", "count": 1}], "residue_section_count": 1}


def test_bibliography_stays_with_its_paper(records):
    assert [c["title"] for c in {x["paper_id"]: x for x in records.collect()}["p2"]["citations"]] == [None, None]


def test_folder_and_back(spark, records, tmp_path):
    out = str(tmp_path / "out")
    files = {r["paper_id"]: r["files"] for r in write_folder_view(records, out).collect()}
    found = sorted(os.path.relpath(os.path.join(d, f), f"{out}/p1") for d, _, names in os.walk(f"{out}/p1") for f in names)
    assert files["p1"] == len(found)
    assert {"README.md", "paper.json", "references.json", "footnotes.json", "sections/01-introduction.md", "sections/01.01-details-more.md", "figures/fig-one.json", "figures/fig-one.txt", "listings/lst-1.py"} <= set(found)
    paper = json.load(open(f"{out}/p1/paper.json"))
    assert paper["sections"][0]["file"] == "sections/01-introduction.md" and paper["sections"][0]["parent_id"] is None
    assert open(f"{out}/p1/sections/01.01-details-more.md").read().startswith('---\nid: "sec:1.1"\ntitle: Details & more\nlevel: 1\nparent_id: "sec:1"\n')
    readme = open(f"{out}/p1/README.md").read()
    assert "- [`sec:1` — Introduction](sections/01-introduction.md)" in readme and "- `[@a]` (2× cited) — Title A" in readme
    # The stored form of a corpus: <paper>/digest/...
    for p in ("p1", "p2"):
        os.makedirs(f"{out}/corpus/{p}")
        os.rename(f"{out}/{p}", f"{out}/corpus/{p}/digest")
    os.makedirs(f"{out}/corpus/p3/digest")
    open(f"{out}/corpus/p3/digest/paper.json", "w").write("{no json")
    papers = J.read_papers(spark, f"{out}/corpus")
    found = {(r["paper_id"], r["kind"]) for r in Q.findings(J.audit_view(papers, papers.select("slug").limit(0)), "0.5").collect()}
    assert ("p3", "unreadable_paper_json") in found and ("p1", "figures_without_binary") in found and ("p1", "figures_missing_visual_extraction") in found
    assert not any(k == "schema_mismatch" for _, k in found)
    assert J.read_figures(spark, f"{out}/corpus").count() == 4
    new = spark.createDataFrame([("p1", "fig:one", "ok")], "paper_id string, figure_id string, status string").select("paper_id", "figure_id", F.from_json(F.to_json(F.struct("status")), J.VISUAL.replace("struct<", "struct<", 1)).alias("visual_extraction"))
    merged = J.upsert_visuals(papers.where("paper_id is not null"), new)
    status = {(r["paper_id"], f["id"]): f["visual_extraction"] and f["visual_extraction"]["status"] for r in merged.collect() for f in r["figures"]}
    assert status[("p1", "fig:one")] == "ok" and status[("p1", "fig:2")] is None and status[("p2", "fig:one")] is None


def test_assets(spark, tree, records):
    refs = records.select("paper_id", F.explode("figures").alias("f")).select("paper_id", F.col("f.id").alias("entity_id"), F.posexplode("f.src_refs").alias("place", "ref"))
    found = S.resolve_assets(refs, S.scan_trees(spark, tree).select("paper_id", "path"))
    copies = {(r["paper_id"], r["path"], r["target"]) for r in asset_copies(found).collect()}
    assert ("p1", "img/plot.pdf", "figures/fig-2-1.pdf") in copies and len(copies) == 2


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "paper_id string, tex string")
    assert R.digest(docs).count() == 0
    bare = R.digest(spark.createDataFrame([("x", "no sections"), ("y", "")], "paper_id string, tex string")).collect()
    assert {len(r["sections"]) for r in bare} == {0} and len(bare) == 2


def test_archives(spark):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for name in ("main.tex", "../out.tex", "/abs.tex", "a/b.bib"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
        link = tarfile.TarInfo("link.tex")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    rows = S.unpack(spark.createDataFrame([("p", data.getvalue()), ("q", b"junk"), ("r", None)], "paper_id string, content binary")).collect()
    assert sorted((r["paper_id"], r["path"], bytes(r["content"])) for r in rows) == [("p", "a/b.bib", b"abc"), ("p", "main.tex", b"abc")]


def test_source_folder(spark):
    trees = spark.createDataFrame([("a", "raw/source/arxiv-to-prompt/m.tex"), ("a", "raw/source/a/m.tex"), ("b", "source/v1/m.tex"), ("c", "m.tex")], "paper_id string, path string")
    assert {r["paper_id"]: r["folder"] for r in S.source_folders(trees).collect()} == {"a": "raw/source/arxiv-to-prompt", "b": "source/v1"}


def test_polite_fetching():
    waits, answers = [], iter([(429, ""), (503, ""), (200, "page")])
    assert polite(lambda k: next(answers), "x", 3.0, wait=waits.append) == "page" and waits == [3.0, 6.0, 9.0]
    assert polite(lambda k: (404, ""), "x", 0, wait=waits.append) is None

    def broken(key):
        raise OSError

    assert polite(broken, "x", 0, wait=waits.append) is None


def test_remote_source(spark, tmp_path):
    spark.dataSource.register(RemotePapers)
    rows = spark.read.format("remote_papers").option("ids", '["a", "b"]').option("fetcher", "posixpath.splitext").option("spacing", "0").load()
    assert {r["paper_id"]: r["content"] for r in rows.collect()} == {"a": None, "b": None}


def test_distribution_rule(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 9)], "v int")
    r = Q.distributions(df, ["v"]).collect()[0]
    assert (r["low"], r["p50"], r["p95"], r["high"], r["mean"]) == (1, 2.5, 3, 9, 3.75)


def test_visible_text_limits(spark):
    df = spark.createDataFrame([([("  A  b", "Prompt"), ("a B", "prompt"), ("x" * 800, "response"), ("[unreadable]", None), ("q", "odd")],)], "visible_text array<struct<text:string,role:string>>")
    got = [(x["text"], x["role"], x["truncated"]) for x in V.normalize_visible(df).collect()[0]["visible_text"]]
    assert got == [("A  b", "prompt", False), ("x" * 700 + V.CUT_MARK, "response", True), ("q", "other", False)]


def test_safety_items(spark):
    rows = [("t1", "odd", ""), ("gone", "model_response", ""), ("gone", "other", "a Model Output"), ("t1", "OTHER", ""), *[(f"n{i}", "ui_state", "") for i in range(9)]]
    df = spark.createDataFrame([(rows,)], "safety_relevant_content array<struct<text:string,kind:string,notes:string>>")
    got = [(x["text"], x["kind"]) for x in V.normalize_safety(df).collect()[0]["safety_relevant_content"]]
    assert got == [("t1", "other"), ("n0", "ui_state"), ("n1", "ui_state"), ("n2", "ui_state"), ("n3", "ui_state")]


def test_text_signal(spark):
    df = spark.createDataFrame([("one two three four",), ("ab cd",), (None,)], "t string")
    assert [r[0] for r in df.select(V.text_signal(F.col("t"))).collect()] == [True, False, False]


def test_ingest_sees_each_file_once(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    docs.write.parquet(source)

    def papers(batch):
        batch.sparkSession.catalog.clearCache()
        from scriptorium.sources.synthetic import paper_text

        return paper_text(batch)

    assert ingest(spark, source, docs.schema, out, mark, papers, files_per_trigger=2) == 2
    whole = latex(spark, "/root/testdata/sf0.001")
    from scriptorium.operators.sections import sections

    assert spark.read.parquet(out).count() == sections(whole).count()
    assert ingest(spark, source, docs.schema, out, mark, papers) == 0


def test_command_line(tree, tmp_path, capsys):
    with pytest.raises(SystemExit):
        arguments(["-o", "x"])
    with pytest.raises(SystemExit):
        arguments(["-o", "x", "--trees", "a", "--local-folder", "b"])
    assert main(["-o", str(tmp_path / "o"), "--local-folder", tree + "/p1"]) == 0
    assert os.path.exists(tmp_path / "o" / "p1" / "paper.json")
